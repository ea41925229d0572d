"""Mixing sources to target weights by pivotal dependent rounding.

Every document has an expected number of copies, its source's target over its source's size. The whole
part is taken at once; the fraction is settled by dependent rounding: the largest document with an open
fraction exchanges mass (words) in a random direction with a partner made of the next largest ones, as
many as can settle it, whose fractions move together, each by its room, until one of them or the large one
is taken or left.
A document keeps its probability, and the mass taken stays the same in every exchange. Large documents
settle first, so a source misses its target by less than its last open document, which is its smallest
unless the open mass around a larger one is less than that one's own.

The exchanges form a reduction tree. Documents of a source are dealt to buckets of about ``FAN`` rows by a
seeded hash, each bucket settles all but one, the open ones of up to ``FAN`` buckets meet on the next
level, and so on: a hot source has many buckets, and no task ever sees more than a bucket. Each level is
stored in the shared folder. Draws come from hashes of the seed, the level and the rows, so reruns agree.

Nulls: a null text has size 0, a null source is a source of its own (the last), a null doc_id is hashed
like any other value. A document of size 0 takes part by an own draw, for it has no mass to exchange.
Repeated rows are separate documents; many of them with one id and size are spread over buckets by a
number of their own. Ties in size go by that hash. An empty table gives an empty result. Columns of the
input that are called like a column of the result (``copies``, ``taken``, ...) are replaced by ``plan``;
``mix`` returns the input's columns alone.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.rows import WORD, numbered, spread_repeats, text_of
from tidewatch.session import materialise

#: Rows of one bucket, and open rows that meet on the next level.
FAN = 1024
#: A fraction this close to 0 or 1 is settled; rounding of the steps is far below it.
TINY = 1e-9
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0


def word_count(text: str = "text"):
    return F.regexp_count(text_of(text), F.lit(WORD)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``sizes`` (source, source_size) with the ``target`` of each source, a row for each.

    Sources by code point, null last, weigh ``weights``, repeating, and share ``share`` times all sizes.
    A target stops at ``most`` times its source's size and what is over goes to the others by weight: that
    is one level of target per weight, found where the sources sorted by limit per weight stop being full.
    """
    ranked = sizes.selectExpr("*", "row_number() OVER (ORDER BY source IS NULL, source) - 1 AS __tw_n")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("__tw_n") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("__tw_w", weight).withColumn("__tw_cap", F.col("source_size") * F.lit(float(most)))
    after = "OVER (ORDER BY __tw_cap / __tw_w, __tw_n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
    before = "OVER (ORDER BY __tw_cap / __tw_w, __tw_n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    filled = ranked.selectExpr(
        "*", f"(sum(source_size) OVER () * {float(share)}D - coalesce(sum(__tw_cap) {before}, 0D)) / sum(__tw_w) {after} AS __tw_level")
    whole = "OVER (ORDER BY __tw_cap / __tw_w, __tw_n ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
    level = f"first(CASE WHEN __tw_level * __tw_w <= __tw_cap THEN __tw_level END, true) {whole}"
    return filled.selectExpr(
        *sizes.columns, f"least(__tw_cap, coalesce({level} * __tw_w, __tw_cap)) AS target")


def settle(open_p: np.ndarray, mass: np.ndarray, draws: np.ndarray) -> tuple[np.ndarray, int]:
    """Settle all fractions but one, the rows sorted from the largest mass down.

    Returns the fractions, 0 or 1 where settled, and the open place or -1. ``draws`` has one number per row;
    an exchange settles at least one row, so they suffice.
    """
    p = open_p.astype("float64", copy=True)
    open_rows = np.flatnonzero((p > 0.0) & (p < 1.0))
    used = 0
    while len(open_rows) > 1:
        first, rest = open_rows[0], open_rows[1:]
        # As many of the next largest as can take or give what settles the first one; all where none suffice.
        held = np.cumsum(mass[rest] * np.minimum(p[rest], 1.0 - p[rest]))
        rest = rest[: int(np.searchsorted(held, mass[first] * max(p[first], 1.0 - p[first]))) + 1]
        # Their fractions move by their room, against the first one's: mass times change is what is exchanged.
        room = np.minimum(p[rest], 1.0 - p[rest])
        pace = room * (mass[first] / (mass[rest] @ room))
        up = min(1.0 - p[first], float((p[rest] / pace).min()))
        down = min(p[first], float(((1.0 - p[rest]) / pace).min()))
        step = up if draws[used] * (up + down) < down else -down
        used += 1
        p[first] += step
        p[rest] -= step * pace
        near = open_rows[(p[open_rows] < TINY) | (p[open_rows] > 1.0 - TINY)]
        p[near] = np.rint(p[near])
        open_rows = open_rows[(p[open_rows] > 0.0) & (p[open_rows] < 1.0)]
    return p, int(open_rows[0]) if len(open_rows) else -1


def with_copies(rows: DataFrame, seed: int = 11, fan: int = FAN) -> DataFrame:
    """``rows`` (doc_id, size, source, source_size, target, __tw_count: rows of the source, and more) with ``copies``."""
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    identity = F.xxhash64(F.lit(seed), "doc_id", "size", "source")
    first = (
        spread_repeats(rows.withColumn("__tw_id", identity), "__tw_id", fan)
        .withColumn("__tw_base", F.floor(ratio).cast("long"))
        .withColumn("__tw_p", ratio - F.floor(ratio))
        .withColumn("__tw_groups", F.ceil(F.col("__tw_count") / F.lit(fan)).cast("long"))
    )
    schema = first.withColumn("__tw_bucket", F.lit(0).cast("long")).withColumn("copies", F.lit(None).cast("long")).schema

    def level_of(level: int):
        def work(group: pd.DataFrame) -> pd.DataFrame:
            group = group.sort_values(
                ["size", "__tw_id", "doc_id"], ascending=[False, True, True], kind="stable", ignore_index=True)
            rng = np.random.default_rng([seed, level, int(group["__tw_id"].iat[0]) & 0xFFFFFFFF, len(group)])
            draws = rng.random(len(group) + 1)
            p, mass = group["__tw_p"].to_numpy(copy=True), group["size"].to_numpy(dtype="float64")
            light = mass <= 0
            p[light] = draws[:-1][light] < p[light]
            p, at = settle(p, mass, draws[:-1])
            if at >= 0 and group["__tw_groups"].iat[0] <= 1:  # the last of its source
                p[at], at = float(draws[-1] < p[at]), -1
            copies = pd.array(group["__tw_base"].to_numpy() + np.rint(p).astype("int64"), dtype="Int64")
            if at >= 0:
                copies[at] = pd.NA
            return group.assign(
                __tw_p=p, copies=copies, __tw_groups=-(-group["__tw_groups"] // fan))
        return work

    largest = first.agg(F.max("__tw_groups")).first()[0] or 1
    level, current, settled = 0, first, []
    while True:
        bucket = F.pmod(F.xxhash64(F.lit(seed + level + 1), "__tw_id"), F.greatest("__tw_groups", F.lit(1)))
        done = materialise(
            current.withColumn("__tw_bucket", bucket).groupBy("source", "__tw_bucket")
            .applyInPandas(level_of(level), schema), f"mixing_{level}")
        settled.append(done.filter("copies IS NOT NULL"))
        if largest <= 1:
            break
        current, largest, level = done.filter("copies IS NULL").drop("copies"), -(-largest // fan), level + 1
    out = settled[0]
    for part in settled[1:]:
        out = out.unionByName(part)
    return out.drop("__tw_id", "__tw_base", "__tw_p", "__tw_groups", "__tw_bucket", "__tw_count")


def plan(rows: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = 11) -> DataFrame:
    """``rows`` (doc_id, source, size, and more) with source_size, target, copies and taken (words)."""
    stored = materialise(rows, "sizes")
    by_source = stored.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("__tw_count"))
    goals = targets(by_source, weights, share, most)
    joined = (
        stored.alias("r").join(goals.alias("g"), F.expr("r.source <=> g.source"))
        .select("r.*", "g.source_size", "g.target", "g.__tw_count")
    )
    return with_copies(joined, seed).withColumn("taken", F.col("copies") * F.col("size"))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = 11) -> DataFrame:
    """The mixed corpus: every document of ``docs`` as often as it is taken, all columns kept.

    Row numbers run without gaps within each stored partition, so what is taken is one array of small
    numbers per partition: about a byte per document. The texts meet it by its partition's number.
    """
    stored = numbered(docs, "__tw_row")
    rows = stored.select("doc_id", "source", word_count().alias("size"), "__tw_row")
    place = F.struct("__tw_row", F.col("copies").cast("tinyint").alias("copies"))
    taken = materialise(
        plan(rows, weights, share, most, seed)
        .groupBy(F.shiftright("__tw_row", 33).alias("__tw_part"))
        .agg(F.transform(F.array_sort(F.collect_list(place)), lambda x: x["copies"]).alias("__tw_c")), "taken")
    copies = F.expr("get(__tw_c, cast(__tw_row & 8589934591 AS int))")
    return (
        stored.withColumn("__tw_part", F.shiftright("__tw_row", 33)).join(taken, "__tw_part")
        .withColumn("__tw_c", copies.cast("int")).filter("__tw_c > 0")
        .withColumn("__tw_k", F.explode(F.sequence(F.lit(1), F.col("__tw_c"))))
        .drop("__tw_row", "__tw_part", "__tw_c", "__tw_k")
    )
