"""Column cleaning and the facts behind it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.schema import CLIP_RANGES, DROPPED, KEY, LABEL


def drop_columns(df: DataFrame, names: list[str] = DROPPED) -> DataFrame:
    return df.drop(*names)


def clip(col: Column, low: float | None, high: float | None) -> Column:
    """Clamp to a range; null stays null (``greatest``/``least`` would skip it)."""
    out = F.when(F.lit(False), col)
    if low is not None:
        out = out.when(col < low, F.lit(low))
    if high is not None:
        out = out.when(col > high, F.lit(high))
    return out.otherwise(col)


def clip_ranges(df: DataFrame, ranges: dict[str, tuple] = CLIP_RANGES) -> DataFrame:
    return df.withColumns(
        {name: clip(F.col(name), *bounds) for name, bounds in ranges.items() if name in df.columns}
    )


def clean(df: DataFrame) -> DataFrame:
    return df.transform(drop_columns).transform(clip_ranges)


def split_label(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Features without the label, and the keyed label."""
    return df.drop(LABEL), df.select(KEY, LABEL)


def class_filter(df: DataFrame, value: int) -> DataFrame:
    return df.filter(F.col(LABEL) == value)


def rename_drop(df: DataFrame, renames: dict[str, str], drop: list[str]) -> DataFrame:
    return df.withColumnsRenamed(renames).drop(*drop)


def add_missing_columns(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Add typed null columns for those a table lacks."""
    return df.withColumns(
        {n: F.lit(None).cast(t) for n, t in columns.items() if n not in df.columns}
    )


def cast_label(df: DataFrame, name: str) -> DataFrame:
    return df.withColumn(name, F.col(name).cast("int"))


def value_counts(df: DataFrame, columns: list[str], *extra: Column) -> DataFrame:
    """Rows per (column, value) for many columns in one pass, combined map-side."""
    pairs = F.array(
        *[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns]
    )
    return (
        df.select(F.explode(pairs).alias("p"), *([LABEL] if LABEL in df.columns else []))
        .groupBy("p.column", "p.value")
        .agg(F.count(F.lit(1)).alias("n"), *extra)
    )


def audit_categories(df: DataFrame, columns: list[str]) -> DataFrame:
    """Churn rate by category value."""
    return value_counts(df, columns, F.sum(LABEL).alias("churned")).select(
        "column", "value", "n", F.bround(100.0 * F.col("churned") / F.col("n"), 6).alias("churn_pct")
    )


def audit_columns(df: DataFrame, numerics: list[str], categoricals: list[str]) -> DataFrame:
    """One row per column: distinct values, range, and the gap between the class means."""
    churned = F.col(LABEL) == 1
    stats = []
    for c in numerics:
        stats += [
            F.min(c).alias(f"lo_{c}"), F.max(c).alias(f"hi_{c}"),
            (F.avg(F.when(churned, F.col(c))) - F.avg(F.when(~churned, F.col(c)))).alias(f"gap_{c}"),
        ]
    ranges = df.agg(*stats).select(
        F.explode(
            F.array(*[
                F.struct(
                    F.lit(c).alias("column"), F.col(f"lo_{c}").alias("low"),
                    F.col(f"hi_{c}").alias("high"), F.bround(f"gap_{c}", 6).alias("mean_gap"),
                )
                for c in numerics
            ])
        ).alias("s")
    ).select("s.*", F.lit(None).cast("bigint").alias("n_distinct"))
    distinct = (
        value_counts(df.select(*categoricals), categoricals)
        .groupBy("column")
        .agg(F.count("value").alias("n_distinct"))
    )
    return ranges.unionByName(distinct, allowMissingColumns=True)
