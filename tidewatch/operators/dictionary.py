"""Rates for dictionaries of thousands of patterns.

Patterns that are words, phrases or alternatives of them go into one automaton that finds all of them in one pass over
a text, whatever their number. Tasks add up hits by group before anything is shuffled. Patterns that need a regular
expression are counted as ``patterns.theme_rates`` does, a block of them in one aggregate, so both kinds keep
Spark's own rules for what matches.
"""

from __future__ import annotations

import json
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.functions.numbers import percent_text
from tidewatch.operators.patterns import Pattern, pattern_list, patterns, theme_rates

#: Signs with a meaning of their own in a regular expression.
META = frozenset("^$.[]{}()*+?")
#: Regular expressions counted in one aggregate.
REGEX_BLOCK = 100
LABELS = "array<struct<__tw_id: int, theme: string, label: string>>"


def literals(regex: str) -> list[str] | None:
    """The texts a pattern stands for, if it is a text or alternatives of texts; else nothing."""
    parts, chars = [""], iter(regex)
    for c in chars:
        if c in META:
            return None
        if c == "\\":
            c = next(chars, "")
            if not c or c.isalnum() or not c.isascii():
                return None
            parts[-1] += c
        elif c == "|":
            parts.append("")
        else:
            parts[-1] += c
    return parts if all(parts) else None


def _hits(entries: list[tuple[int, list[str], int]], keys: list[str]):
    """Arrow batches (keys, text) to (keys, number of the pattern, rows that hold it)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        owners = defaultdict(list)
        for at, (_, parts, _) in enumerate(entries):
            for part in parts:
                owners[part].append(at)
        if not owners:
            return
        automaton = ahocorasick.Automaton()
        for part, found in owners.items():
            automaton.add_word(part, found)
        automaton.make_automaton()
        for batch in batches:
            rows, numbers = [], []
            for row, text in enumerate(batch.column(len(keys)).to_pylist()):
                seen = {at for _, found in automaton.iter(text) for at in found} if text else ()
                for at in seen:
                    number, parts, least = entries[at]
                    if least <= 1 or text.count(parts[0]) >= least:
                        rows.append(row)
                        numbers.append(number)
            if rows:
                picked = pa.array(rows, pa.int64())
                table = pa.table([*[batch.column(i).take(picked) for i in range(len(keys))], pa.array(numbers, pa.int32())],
                                 names=[*keys, "__tw_id"])
                counted = table.group_by([*keys, "__tw_id"]).aggregate([([], "count_all")])
                yield from counted.select([*keys, "__tw_id", "count_all"]).rename_columns([*keys, "__tw_id", "hits"]).combine_chunks().to_batches()

    return run


def dictionary_rates(
    df: DataFrame, text: str, theme: str, keys: list[str], keep_zero: bool = True,
    dictionary: list[Pattern] | DataFrame | None = None, most: int = 1_000_000,
) -> DataFrame:
    """(keys, theme, label, hits, n, pct) as ``theme_rates``, for dictionaries of any usual size.

    ``dictionary`` is a list of (theme, label, regex, least) or a table of them; it is configuration and goes to
    every task, so more than ``most`` patterns raise ``ValueError``. Null texts count in n and hold no pattern; null
    keys are a group.
    """
    if isinstance(dictionary, DataFrame):
        wanted = dictionary.filter(F.col("theme") == theme)
        if wanted.limit(most + 1).count() > most:
            raise ValueError(f"more than {most} patterns")
        dictionary = pattern_list(wanted)
    chosen = patterns(theme) if dictionary is None else [p for p in dictionary if p[0] == theme]
    if len(chosen) > most:
        raise ValueError(f"more than {most} patterns")
    read = [(literals(p), least) for _, _, p, least in chosen]
    plain = [i for i, (parts, least) in enumerate(read) if parts and (least == 1 or least > 1 and len(parts) == 1)]
    rest = sorted(set(range(len(chosen))) - set(plain))
    columns = [*keys, "theme", "label", "hits", "n", "pct"]
    out = []
    if plain or not rest:
        schema = T.StructType([*[df.schema[k] for k in keys], T.StructField("__tw_id", T.IntegerType()), T.StructField("hits", T.LongType())])
        lowered = df.select(*keys, F.lower(F.col(text)).alias("__tw_text"))
        hits = lowered.mapInArrow(_hits([(i, *read[i]) for i in plain], keys), schema)
        told = json.dumps([{"__tw_id": i, "theme": chosen[i][0], "label": chosen[i][1]} for i in plain])
        groups = lowered.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
        named = groups.select(*keys, F.inline(F.from_json(F.lit(told), LABELS)), F.lit(0).cast("long").alias("hits"), "n")
        # Adding rows up, not joining them, keeps null keys together.
        both = named.unionByName(hits, allowMissingColumns=True).groupBy(*keys, "__tw_id").agg(
            F.max("theme").alias("theme"), F.max("label").alias("label"), F.sum("hits").alias("hits"), F.max("n").alias("n"))
        out.append(both.withColumn("pct", percent_text(F.col("hits"), F.col("n"))).select(columns))
    for start in range(0, len(rest), REGEX_BLOCK):
        block = [chosen[i] for i in rest[start:start + REGEX_BLOCK]]
        out.append(theme_rates(df, text, theme, keys, dictionary=block).select(columns))
    rates = out[0]
    for more in out[1:]:
        rates = rates.unionByName(more)
    return rates if keep_zero else rates.filter(F.col("hits") > 0)
