"""Exact stratified split without a full sort.

Rows of a class are ordered by a seeded hash of their key and the first ones fill the quotas.
One pass counts rows per (class, hash bucket); the running totals of that small table say in
which bucket each quota ends. Only those buckets are ranked, which gives the hash at each
boundary, and every row is then placed by comparing its own hash with two boundaries per class.
No shuffle moves the rows themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.schema import KEY, LABEL
from tidewatch.settings import SplitParams


def seeded_hash(key: Column, seed: int) -> Column:
    return F.md5(F.concat(key.cast("string"), F.lit(f"-{seed}")))


def _largest_remainder(classes: DataFrame, count: str, draws: str, out: str) -> DataFrame:
    """Share ``draws`` between the classes in proportion to ``count`` (a handful of rows)."""
    everything = Window.partitionBy(F.lit(0))
    exact = F.col(count) * F.col(draws) / F.sum(count).over(everything)
    floored = classes.withColumn("_base", F.floor(exact)).withColumn("_rest", exact - F.col("_base"))
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc("_rest"), LABEL)
    missing = F.col(draws) - F.sum("_base").over(everything)
    extra = (F.row_number().over(order) <= missing).cast("bigint")
    return floored.withColumn(out, F.col("_base") + extra).drop("_base", "_rest")


def class_quotas(counts: DataFrame, params: SplitParams) -> DataFrame:
    """Per class the rows for train and validation, from the rows per class.

    Sizes follow the two-stage arithmetic: the held-out part is rounded up, then its second half.
    """
    held_share = 1 - (1.0 - (params.val_size + params.test_size))
    test_share = 1 - params.val_size / (params.val_size + params.test_size)
    everything = Window.partitionBy(F.lit(0))
    n = F.sum("n").over(everything)
    sized = counts.withColumn("_train", n - F.ceil(n * F.lit(held_share)))
    sized = _largest_remainder(sized, "n", "_train", "n_train").withColumn(
        "_held", F.col("n") - F.col("n_train")
    )
    held = F.sum("_held").over(everything)
    sized = sized.withColumn("_val", held - F.ceil(held * F.lit(test_share)))
    return _largest_remainder(sized, "_held", "_val", "n_val").select(LABEL, "n", "n_train", "n_val")


def split_limits(df: DataFrame, params: SplitParams = SplitParams()) -> DataFrame:
    """Per class the (hash, key) of the last train row and the last validation row.

    ``df`` is read twice over its key and label only; give it a stored table when its lineage is
    long.
    """
    hashed = df.select(KEY, LABEL, seeded_hash(F.col(KEY), params.seed).alias("_h")).withColumn(
        "_bucket", F.substring("_h", 1, params.bucket_digits)
    )
    totals = hashed.groupBy(LABEL, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    quotas = class_quotas(totals.groupBy(LABEL).agg(F.sum("_n").alias("n")), params)
    before = Window.partitionBy(LABEL).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    edges = (
        totals.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .join(quotas, LABEL)
        .withColumn(
            "_ends",
            F.array(
                F.struct(F.lit("train").alias("part"), F.col("n_train").alias("rank")),
                F.struct(F.lit("val").alias("part"), (F.col("n_train") + F.col("n_val")).alias("rank")),
            ),
        )
        .withColumn(
            "_ends",
            F.filter("_ends", lambda e: (e["rank"] > F.col("_start"))
                     & (e["rank"] <= F.col("_start") + F.col("_n"))),
        )
        .filter(F.size("_ends") > 0)
        .select(LABEL, "_bucket", "_start", "_ends")
    )
    in_bucket = Window.partitionBy(LABEL, "_bucket").orderBy("_h", KEY)
    # At most two buckets per class pass this join.
    boundary = (
        hashed.join(F.broadcast(edges), [LABEL, "_bucket"])
        .withColumn("_rank", F.col("_start") + F.row_number().over(in_bucket))
        .select(LABEL, "_h", KEY, "_rank", F.explode("_ends").alias("_end"))
        .filter(F.col("_rank") == F.col("_end.rank"))
        .groupBy(LABEL)
        .agg(
            F.max(F.when(F.col("_end.part") == "train", F.struct("_h", KEY))).alias("_last_train"),
            F.max(F.when(F.col("_end.part") == "val", F.struct("_h", KEY))).alias("_last_val"),
        )
    )
    # One row per class. A class with an empty quota has no boundary row for it.
    return quotas.join(boundary, LABEL, "left").select(LABEL, "_last_train", "_last_val")


def stratified_split(
    df: DataFrame, params: SplitParams = SplitParams(), limits: DataFrame | None = None
) -> DataFrame:
    """``df`` with a ``split`` column (train, val, test) of exact size per class."""
    limits = split_limits(df, params) if limits is None else limits
    here = F.struct(seeded_hash(F.col(KEY), params.seed).alias("_h"), F.col(KEY))
    part = (
        F.when(here <= F.col("_last_train"), F.lit("train"))
        .when(here <= F.col("_last_val"), F.lit("val"))
        .otherwise(F.lit("test"))
    )
    # One row per class.
    return df.join(F.broadcast(limits), LABEL).select(
        *[df[c] for c in df.columns], part.alias("split")
    )


def persist_split(df: DataFrame, path: str, params: SplitParams = SplitParams()) -> DataFrame:
    """Compute the split once, store it, and return the stored table."""
    stratified_split(df.select(KEY, LABEL), params).write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def split_summary(split: DataFrame) -> DataFrame:
    """Rows and churn share per split."""
    return split.groupBy("split").agg(
        F.count(F.lit(1)).alias("n"), F.bround(F.avg(LABEL) * 100, 6).alias("churn_pct")
    )


def class_counts(df: DataFrame) -> DataFrame:
    """Negatives, positives and their ratio."""
    return df.agg(
        F.count_if(F.col(LABEL) == 0).alias("negatives"),
        F.count_if(F.col(LABEL) == 1).alias("positives"),
    ).withColumn("ratio", F.bround(F.try_divide(F.col("negatives").cast("double"), F.col("positives")), 6))


def class_weights(df: DataFrame) -> DataFrame:
    """Per class the balanced weight n/(2*n_c), and the positive weight neg/pos for boosting."""
    per_class = df.groupBy(LABEL).agg(F.count(F.lit(1)).alias("n"))
    everything = Window.partitionBy(F.lit(0))
    n = F.sum("n").over(everything)
    pos = F.sum(F.when(F.col(LABEL) == 1, F.col("n"))).over(everything)
    neg = F.sum(F.when(F.col(LABEL) == 0, F.col("n"))).over(everything)
    return per_class.select(
        LABEL,
        (n.cast("double") / (2 * F.col("n"))).alias("balanced"),
        F.when(F.col(LABEL) == 1, neg.cast("double") / pos).otherwise(1.0).alias("positive_weight"),
    )
