"""Removing passages that repeat, by overlapping windows of three lines.

Lines are cut at line feeds and compared exactly. Every run of three consecutive lines is a window, known
by a 128-bit hash. A window that occurs more than once keeps its first occurrence (by doc_id, then
position) and loses all later ones: their lines are removed, overlapping ones merged into one stretch. This
also holds within a document. Only DataFrame functions are used.

Texts with fewer than three lines have no window and stay as they are. A text may lose all its lines and is
empty then. Nulls: a null text stays null and has one empty line; a null doc_id comes after all others,
ordered by the text's hash. Rows equal in doc_id and text count as one document and get the same result.
An empty table gives an empty result.

Occurrences are counted by a pre-aggregated shuffle, of which only repeated windows return; the join that
finds later occurrences may be skewed by a hot passage, which adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.rows import text_key, text_of

WINDOW = 3


def windows(docs: DataFrame) -> DataFrame:
    """(doc_id, __tw_key, pos, h1, h2): one row for each window of each text of ``docs``."""
    lines = docs.select("doc_id", text_key().alias("__tw_key"), F.split(text_of(), "\n", -1).alias("l")).filter(
        F.size("l") >= WINDOW)
    hashed = lines.select(
        "doc_id", "__tw_key",
        F.transform("l", lambda x: F.xxhash64(x)).alias("a"),
        F.transform("l", lambda x: F.xxhash64(F.lit(WINDOW), x)).alias("b"))
    made = F.expr(
        f"transform(sequence(0, size(a) - {WINDOW}), i -> struct(i AS pos, "
        "xxhash64(a[i], a[i + 1], a[i + 2]) AS h1, xxhash64(b[i], b[i + 1], b[i + 2]) AS h2))")
    return hashed.select("doc_id", "__tw_key", F.explode(made).alias("w")).select("doc_id", "__tw_key", "w.*")


def later_windows(docs: DataFrame) -> DataFrame:
    """(doc_id, __tw_key, starts): where later occurrences of repeated windows start, sorted."""
    rows = windows(docs)
    place = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "__tw_key", "pos")
    repeated = (
        rows.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first")).filter("n > 1").drop("n"))
    later = rows.join(repeated, ["h1", "h2"]).filter(
        "NOT (first.doc_id <=> doc_id AND first.__tw_key = __tw_key AND first.pos = pos)")
    return later.groupBy("doc_id", "__tw_key").agg(F.sort_array(F.collect_set("pos")).alias("starts"))


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated passages cut from ``text``, and ``n_lines`` and ``n_removed`` (both long)."""
    found = later_windows(docs.select("doc_id", "text"))
    columns = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    joined = (
        docs.select(*columns, text_key().alias("__tw_key")).alias("d")
        .join(found.alias("f"), F.expr("d.doc_id <=> f.doc_id AND d.__tw_key = f.__tw_key"), "left")
        .select(*[F.col(f"d.`{c}`") for c in columns], "f.starts")
        .withColumn("__tw_l", F.split(text_of(), "\n", -1))
        .withColumn("__tw_from", F.expr(f"filter(starts, (x, i) -> i = 0 OR x - starts[i - 1] > {WINDOW})"))
        .withColumn("__tw_to", F.expr(
            f"transform(filter(starts, (x, i) -> i = size(starts) - 1 OR starts[i + 1] - x > {WINDOW}), x -> x + {WINDOW})"))
    )
    kept = F.expr(
        "flatten(transform(sequence(0, size(__tw_from)), k -> slice(__tw_l, "
        "if(k = 0, 0, get(__tw_to, k - 1)) + 1, "
        "if(k = size(__tw_from), size(__tw_l), get(__tw_from, k)) - if(k = 0, 0, get(__tw_to, k - 1)))))")
    removed = F.expr("aggregate(arrays_zip(__tw_from, __tw_to), 0L, (s, x) -> s + x.__tw_to - x.__tw_from)")
    return (
        joined
        .withColumn("text", F.when(F.col("starts").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")))
        .withColumn("n_lines", F.size("__tw_l").cast("long"))
        .withColumn("n_removed", F.coalesce(removed, F.lit(0)).cast("long"))
        .drop("starts", "__tw_l", "__tw_from", "__tw_to")
    )
