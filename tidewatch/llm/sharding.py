"""Sharding by a two-pass external shuffle.

Pass one scatters the rows over buckets by a seeded hash of doc_id and text; the number of buckets
follows the data, so that a bucket fits in memory. Pass two shuffles each bucket by Fisher-Yates. A row's
place in the whole order is its bucket's offset plus its place in the bucket. A shard is a stretch of that
order; stretches differ by one row at most, and slots count from 0 without gaps. So a bucket's rows go to one
shard, or to a few where the stretches are shorter, and are written in their shuffled order: every file of
a shard has ascending slots, and a shard has no more files than buckets that touch it.

Nulls: a null text counts as empty, a null doc_id is hashed like any other value. Rows equal in doc_id and
text are interchangeable; so many of them that they would overfill a bucket are spread by a number of
their own, and very long texts go to whichever bucket their hash names. An empty table gives an empty result. Columns of the
input that are called ``shard`` or ``slot`` are replaced; all others pass through.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.llm.rows import small_batches, spread_repeats, text_of
from tidewatch.session import work_path

#: Bytes of text that one bucket holds on average.
BUCKET_BYTES = 8_000_000
#: Rows with one doc_id and text that may share a bucket.
REPEATS = 1000
#: Fixed bytes that a row counts besides its text.
ROW_BYTES = 16


def row_bytes(text: str = "text"):
    return F.octet_length(text_of(text)).cast("long") + F.lit(ROW_BYTES)


def fisher_yates(n: int, seed: int, bucket: int) -> np.ndarray:
    """A uniformly random order of n rows: swap each place, from the last, with one not after it."""
    order = np.arange(n)
    draws = np.random.default_rng([seed, bucket]).integers(0, np.arange(n, 0, -1)) if n else []
    for i, j in zip(range(n - 1, 0, -1), draws):
        order[i], order[j] = order[j], order[i]
    return order


def shuffled(docs: DataFrame, seed: int = 7, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """All rows and columns of ``docs`` with ``__tw_place``: the row's place in a random order of all rows."""
    spark = docs.sparkSession
    small_batches(spark)
    known = docs.withColumn("__tw_id", F.xxhash64(F.lit(seed), "doc_id", text_of()))
    total = docs.agg(F.sum(row_bytes())).first()[0] or 0
    buckets = max(1, -(-int(total) // bucket_bytes))
    known = spread_repeats(known, "__tw_id", REPEATS)
    scattered = known.withColumn("__tw_bucket", F.pmod("__tw_id", F.lit(buckets)).cast("int"))
    schema = T.StructType([*scattered.schema.fields, T.StructField("__tw_place", T.LongType())])

    def shuffle_bucket(rows: pd.DataFrame, offset: pd.DataFrame) -> pd.DataFrame:
        # The start order must not depend on how the rows arrived.
        rows = rows.sort_values(["__tw_id", "doc_id"], kind="stable", ignore_index=True)
        rank = np.empty(len(rows), dtype="int64")
        rank[fisher_yates(len(rows), seed, int(rows["__tw_bucket"].iat[0]))] = np.arange(len(rows))
        return rows.assign(__tw_place=rank + int(offset["__tw_offset"].iat[0]))

    # Offsets: one row per bucket, so this ordered window sees total / bucket_bytes rows.
    counts = scattered.groupBy("__tw_bucket").agg(F.count(F.lit(1)).alias("__tw_n"))
    offsets = counts.selectExpr(
        "__tw_bucket AS __tw_at", "sum(__tw_n) OVER (ORDER BY __tw_bucket) - __tw_n AS __tw_offset")
    # The offsets meet their buckets in the same task, so the texts are shuffled once.
    return (
        scattered.groupBy("__tw_bucket").cogroup(offsets.groupBy("__tw_at"))
        .applyInPandas(shuffle_bucket, schema).drop("__tw_id", "__tw_bucket"))


def sharded(docs: DataFrame, shards: int = 40, seed: int = 7, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``docs`` with its ``shard`` (0 to shards - 1) and ``slot``; counts differ by one at most."""
    rows = docs.count()
    # The first ``longer`` shards hold one row more than the others.
    each, longer = divmod(rows, shards)
    place, head = F.col("__tw_place"), longer * (each + 1)
    early = place < F.lit(head)
    rest = place - F.lit(head)
    return (
        shuffled(docs, seed, bucket_bytes)
        .withColumn("shard", F.when(early, F.expr(f"__tw_place div {each + 1}")).otherwise(
            F.expr(f"(__tw_place - {head}) div {max(each, 1)} + {longer}")).cast("int"))
        .withColumn("slot", F.when(early, place % F.lit(each + 1)).otherwise(rest % F.lit(max(each, 1))).cast("long"))
        .drop("__tw_place")
    )


def write_shards(docs: DataFrame, path: str | None = None, **parameters) -> str:
    """Write the shards as Parquet, a folder for each; returns the path. Texts go with their rows, in their order."""
    out = path or work_path(docs.sparkSession, "shards")
    # The writer needs rows by shard; with the slot in the same sort, files come out in shuffled order.
    sharded(docs, **parameters).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(out)
    return out
