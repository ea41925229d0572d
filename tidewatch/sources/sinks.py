"""Writing tables and nested JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, fmt: str = "parquet") -> str:
    """Write a table; CSV gets a header row. Nothing but the columns is stored."""
    writer = df.write.mode("overwrite")
    if fmt == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.format(fmt).save(path)
    return path


def nested_metrics(metrics: DataFrame) -> DataFrame:
    """One JSON text, model -> split -> metric -> value, from the long metrics table.

    The table holds a few rows per model and split, so one group is enough.
    """
    per_split = metrics.groupBy("model", "split").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("metric", "value")))).alias("m")
    )
    per_model = per_split.groupBy("model").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("split", F.to_json("m").alias("m"))))).alias("m")
    )
    body = F.transform(
        F.map_entries("m"), lambda e: F.concat(F.lit('"'), e["key"], F.lit('": '), e["value"])
    )
    text = F.concat(F.lit('"'), F.col("model"), F.lit('": {'), F.array_join(body, ", "), F.lit("}"))
    return per_model.agg(
        F.concat(F.lit("{"), F.array_join(F.array_sort(F.collect_list(text)), ", "), F.lit("}")).alias("value")
    )


def benchmark_json(benchmarks: DataFrame) -> DataFrame:
    """One JSON text, feature -> {churned_mean, retained_mean}, in feature order."""
    entry = F.struct(
        "position", "feature",
        F.to_json(F.struct("churned_mean", "retained_mean")).alias("means"),
    )
    return _ordered_object(benchmarks, entry)


def importance_json(importances: DataFrame) -> DataFrame:
    """One JSON text, feature -> importance, in rank order."""
    entry = F.struct(
        F.col("rank").alias("position"), "feature", F.col("importance").cast("string").alias("means")
    )
    return _ordered_object(importances, entry)


def _ordered_object(df: DataFrame, entry) -> DataFrame:
    parts = F.transform(
        F.array_sort(F.collect_list(entry)),
        lambda e: F.concat(F.lit('"'), e["feature"], F.lit('": '), e["means"]),
    )
    return df.agg(F.concat(F.lit("{"), F.array_join(parts, ", "), F.lit("}")).alias("value"))


def write_json_text(text: DataFrame, path: str) -> str:
    """Store a one-row JSON text."""
    text.coalesce(1).write.mode("overwrite").text(path)
    return path
