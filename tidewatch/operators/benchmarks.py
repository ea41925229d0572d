"""Class means of every numeric feature."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.numbers import round_exact
from tidewatch.schema import LABEL, NUMERIC_NAMES


def _means(train: DataFrame, features: list[str]) -> DataFrame:
    """All class means in one aggregate over one scan; the result is a single row."""
    return train.agg(
        *[
            F.avg(F.when(F.col(LABEL) == y, F.col(c))).alias(f"{c}_{y}")
            for c in features
            for y in (1, 0)
        ]
    )


def population_benchmarks(train: DataFrame, features: list[str] = NUMERIC_NAMES) -> DataFrame:
    """(position, feature, churned_mean, retained_mean), one row per feature."""
    rows = F.array(
        *[
            F.struct(
                F.lit(i).alias("position"), F.lit(c).alias("feature"),
                F.col(f"{c}_1").alias("churned"), F.col(f"{c}_0").alias("retained"),
            )
            for i, c in enumerate(features)
        ]
    )
    return _means(train, features).select(F.inline(rows)).select(
        "position", "feature",
        round_exact(F.col("churned"), 3).alias("churned_mean"),
        round_exact(F.col("retained"), 3).alias("retained_mean"),
    )
