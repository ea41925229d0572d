"""Helpers shared by the text operators: texts, row keys, batches, hold-out rows, small reductions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.session import materialise

# Words are the longest runs of characters other than blank, tab, line feed, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows and bytes in one Arrow batch. Texts can be very long, so batches hold few of them.
BATCH_ROWS = 500
BATCH_BYTES = 8 << 20


def text_of(name: str = "text") -> Column:
    """The text; a null text counts as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bound the rows and bytes of an Arrow batch, so that a batch of long texts fits a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def text_key(name: str = "text") -> Column:
    """A 64-bit key of a text; with doc_id it names a row. Rows equal in both are one document."""
    return F.xxhash64(text_of(name))


def fold(column: str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; null for a null id."""
    return F.crc32(F.col(column).cast("string")) % F.lit(parts)


def held_out(column: str, parts: int, rest: int) -> Column:
    return F.coalesce(fold(column, parts) == F.lit(rest), F.lit(False))


def agreed_labels(labels: DataFrame, column: str) -> DataFrame:
    """One label 0 or 1 per doc_id. Null ids and labels, and ids whose labels disagree, are left out."""
    return (
        labels.filter(F.col("doc_id").isNotNull() & F.col(column).isin(0, 1))
        .groupBy("doc_id").agg(F.min(column).alias("__tw_low"), F.max(column).alias("__tw_high"))
        .filter("__tw_low = __tw_high").select("doc_id", F.col("__tw_low").cast("int").alias("__tw_label"))
    )


def numbered(df: DataFrame, name: str) -> DataFrame:
    """The table with a row number that stays fixed: it is stored before anyone reads it."""
    return materialise(df.withColumn(name, F.monotonically_increasing_id()), "numbered")


def spread_repeats(df: DataFrame, key: str, most: int) -> DataFrame:
    """``df`` with the 64-bit ``key`` of rows made distinct where more than ``most`` rows share one.

    Such rows are numbered: within each partition, then by the partitions' offsets. Rows of one key are
    interchangeable, so the result is the same set of rows however they are partitioned. Other rows pass as
    they are; without a hot key this costs one count per key.
    """
    hot = df.groupBy(key).agg(F.count(F.lit(1)).alias("__tw_n")).filter(F.col("__tw_n") > most).select(key)
    hot = materialise(hot, "hot_keys")
    if hot.isEmpty():
        return df
    stored = materialise(df.withColumn("__tw_part", F.spark_partition_id()), "with_parts")
    often = stored.join(hot, key, "left_semi")
    offsets = often.groupBy(key, "__tw_part").agg(F.count(F.lit(1)).alias("__tw_n")).selectExpr(
        key, "__tw_part", f"sum(__tw_n) OVER (PARTITION BY {key} ORDER BY __tw_part) - __tw_n AS __tw_from")
    numbers = often.selectExpr("*", f"row_number() OVER (PARTITION BY {key}, __tw_part ORDER BY {key}) AS __tw_n")
    told = numbers.join(offsets, [key, "__tw_part"]).withColumn(
        key, F.xxhash64(key, F.col("__tw_from") + F.col("__tw_n"))).select(*df.columns)
    return stored.join(hot, key, "left_anti").select(*df.columns).unionByName(told)


#: Bits of the map that ``possibly_in`` broadcasts: 16 MB, however many keys there are.
MAP_BITS = 1 << 27


def possibly_in(df: DataFrame, key: Column, members: DataFrame, name: str) -> DataFrame:
    """``df`` with a column ``name``, false only where the 64-bit ``key`` is in no row of ``members`` (one long column).

    Members set bits of a map of fixed size, which is broadcast, so that wide rows need not be shuffled to learn that
    they have no partner. With many members more rows are let through; a join that follows settles them.
    """
    member = (F.pmod(F.col(members.columns[0]), F.lit(MAP_BITS)) + 1).alias("__tw_x")
    maps = (
        members.select(member).groupBy(F.bitmap_bucket_number("__tw_x").alias("__tw_bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("__tw_x")).alias("__tw_bits")))
    placed = df.withColumn("__tw_x", F.pmod(key, F.lit(MAP_BITS)) + 1).withColumn("__tw_bucket", F.bitmap_bucket_number("__tw_x"))
    byte = F.conv(F.hex(F.expr("substring(__tw_bits, cast(bitmap_bit_position(__tw_x) div 8 + 1 as int), 1)")), 16, 10).cast("int")
    bit = F.expr("cast(bitmap_bit_position(__tw_x) % 8 as int)")
    return (
        placed.join(F.broadcast(maps), "__tw_bucket", "left")
        .withColumn(name, F.coalesce(F.getbit(byte, bit) == 1, F.lit(False))).drop("__tw_x", "__tw_bucket", "__tw_bits"))


def sum_vectors(df: DataFrame, partial_sums, length: int) -> np.ndarray:
    """Add up one vector per partition. ``partial_sums`` maps an iterator of Arrow batches to a vector.

    The vectors are added element by element in a Spark aggregate, so that the driver receives
    ``length`` numbers however many partitions there are; as Arrow columns, not as an object for each.
    """
    def emit(batches, partial_sums=partial_sums):
        vector = np.asarray(partial_sums(batches), dtype="float64")
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(len(vector), dtype="int32")), pa.array(vector)], names=["i", "v"])

    total = df.mapInArrow(emit, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros(length)
    out[total.column("i").to_numpy()] = total.column("v").to_numpy()
    return out

