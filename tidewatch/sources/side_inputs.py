"""Small JSON side tables: feature importances and class benchmarks."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.session import path_exists

IMPORTANCE_SCHEMA = "rank int, feature string, importance double"
BENCHMARK_SCHEMA = "position int, feature string, churned_mean double, retained_mean double"


def _ordered_entries(spark: SparkSession, path: str, value_type: str) -> DataFrame | None:
    if not path_exists(spark, path):
        warnings.warn(f"{path} not found; the prompt goes without it", stacklevel=3)
        return None
    return spark.read.text(path, wholetext=True).select(
        F.posexplode(F.from_json("value", f"map<string,{value_type}>")).alias("position", "feature", "entry")
    )


def load_importances(spark: SparkSession, path: str) -> DataFrame:
    """(rank, feature, importance) in file order; empty when the file is absent."""
    entries = _ordered_entries(spark, path, "double")
    if entries is None:
        return spark.createDataFrame([], IMPORTANCE_SCHEMA)
    return entries.select((F.col("position") + 1).alias("rank"), "feature", F.col("entry").alias("importance"))


def load_benchmarks(spark: SparkSession, path: str) -> DataFrame:
    """(position, feature, churned_mean, retained_mean); empty when the file is absent."""
    entries = _ordered_entries(spark, path, "struct<churned_mean:double,retained_mean:double>")
    if entries is None:
        return spark.createDataFrame([], BENCHMARK_SCHEMA)
    return entries.select("position", "feature", "entry.churned_mean", "entry.retained_mean")
