"""Imputation, scaling and one-hot encoding, fitted on train and applied to all."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import accumulate

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from tidewatch.schema import CATEGORICAL_NAMES, KEY, NUMERIC_NAMES


@dataclass(frozen=True)
class NumericFit:
    medians: dict[str, float]
    means: dict[str, float]
    stds: dict[str, float]


#: Equal parts into which a pass divides the interval that holds a column's median.
BINS = 1024


def _bin(value: Column, low: float, high: float) -> Column:
    """Which part of [low, high] a value lies in. Both ends are parts of their own, so that every pass narrows."""
    width = high / 2 - low / 2
    part = F.floor((value / 2 - F.lit(low / 2)) * F.lit(BINS / width if width else 0.0))
    return (
        F.when(value == F.lit(low), F.lit(-1)).when(value == F.lit(high), F.lit(BINS))
        .otherwise(F.least(F.greatest(part, F.lit(0)), F.lit(BINS - 1))).cast("int")
    )


def _histograms(df: DataFrame, spans: dict[str, tuple[float, float, int]]) -> dict[str, list[Row]]:
    """Per column the occupied parts of its interval in order: number of rows, least and largest value."""
    inside = []
    for c, (low, high, _) in spans.items():
        value = F.col(c).cast("double")
        cell = F.struct(F.lit(c).alias("feature"), _bin(value, low, high).alias("bin"), value.alias("value"))
        inside.append(F.when(value.between(F.lit(low), F.lit(high)), cell))
    rows = (
        df.select(F.explode(F.array_compact(F.array(*inside))).alias("v"))
        .groupBy("v.feature", "v.bin")
        .agg(F.count(F.lit(1)).alias("n"), F.min("v.value").alias("low"), F.max("v.value").alias("high"))
        .collect()  # BINS + 2 rows per column at most
    )
    found: dict[str, list[Row]] = {c: [] for c in spans}
    for r in sorted(rows, key=lambda r: (r["feature"], r["bin"])):
        found[r["feature"]].append(r)
    return found


def exact_medians(
    df: DataFrame, columns: list[str], margin: float = 2e-4, accuracy: int = 20000
) -> DataFrame:
    """Exact median per column (mean of the middle two), nulls skipped: (feature, median).

    A sketch gives a narrow bracket around each median and one wide aggregate counts the rows below it; where a
    bracket misses the middle, the column's whole range takes its place. Then each pass counts the values of every
    column's interval in ``BINS`` equal parts and goes on with the part that holds the middle, until that is one
    value. No column is collected, sorted or ranked, and no key stands for a whole column. ``df`` is read three
    times and once more for every further pass: give it a stored table.
    """
    ends = F.array(F.lit(0.5 - margin), F.lit(0.5 + margin))
    values = {c: F.col(c).cast("double") for c in columns}
    bracket = df.agg(*[F.percentile_approx(v, ends, accuracy).alias(c) for c, v in values.items()]).first()
    known = [c for c in columns if bracket[c] is not None]
    medians: dict[str, float | None] = {c: None for c in columns}
    spans: dict[str, tuple[float, float, int]] = {}
    middle: dict[str, tuple[int, int]] = {}
    if known:
        counts = df.agg(
            *[F.count(values[c]).alias(f"n_{c}") for c in known],
            *[F.count_if(values[c] < F.lit(bracket[c][0])).alias(f"b_{c}") for c in known],
            *[F.count_if(values[c] <= F.lit(bracket[c][1])).alias(f"u_{c}") for c in known],
            *[F.min(values[c]).alias(f"l_{c}") for c in known],
            *[F.max(values[c]).alias(f"h_{c}") for c in known],
        ).first()
        for c in known:
            n, below, upto = (counts[f"{k}_{c}"] for k in "nbu")
            middle[c] = ((n + 1) // 2, n // 2 + 1)
            holds = below < middle[c][0] and middle[c][1] <= upto
            spans[c] = (*bracket[c], below) if holds else (counts[f"l_{c}"], counts[f"h_{c}"], 0)
    while spans:
        narrowed = {}
        for c, parts in _histograms(df, spans).items():
            upto = [*accumulate((r["n"] for r in parts), initial=spans[c][2])]
            low, high = (next(i for i in range(len(parts)) if rank <= upto[i + 1]) for rank in middle[c])
            if low == high and parts[low]["low"] < parts[low]["high"]:
                narrowed[c] = (parts[low]["low"], parts[low]["high"], upto[low])
            else:  # one value, or the last of a part and the first of the next
                medians[c] = (parts[low]["high"] + parts[high]["low"]) / 2
        spans = narrowed
    return df.sparkSession.createDataFrame(list(medians.items()), "feature string, median double")


def modes(df: DataFrame, columns: list[str]) -> DataFrame:
    """Most frequent value per column, the smallest on ties: (feature, mode)."""
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("value")) for c in columns])
    return (
        df.select(F.explode(pairs).alias("p"))
        .groupBy("p.feature", "p.value")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("feature")
        .agg(
            F.min_by(
                "value", F.when(F.col("value").isNotNull(), F.struct(-F.col("n"), F.col("value")))
            ).alias("mode")
        )
    )


def fit_numeric(train: DataFrame, columns: list[str]) -> NumericFit:
    """Medians, and mean and population deviation after imputing; a constant column divides by 1.

    A column without any value is imputed with 0, so that the vector keeps its width.
    """
    medians = {r["feature"]: r["median"] or 0.0 for r in exact_medians(train, columns).collect()}
    filled = {c: F.coalesce(F.col(c), F.lit(medians[c])) for c in columns}
    row = train.agg(
        *[F.avg(x).alias(f"m_{c}") for c, x in filled.items()],
        *[F.stddev_pop(x).alias(f"s_{c}") for c, x in filled.items()],
    ).first()
    return NumericFit(
        medians,
        {c: row[f"m_{c}"] or 0.0 for c in columns},
        {c: row[f"s_{c}"] or 1.0 for c in columns},
    )


def scale(df: DataFrame, fit: NumericFit) -> DataFrame:
    return df.withColumns(
        {
            c: (F.coalesce(F.col(c), F.lit(fit.medians[c])) - F.lit(fit.means[c])) / F.lit(fit.stds[c])
            for c in fit.medians
        }
    )


NO_CATEGORY = "missing"


def _sql_text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _encoder_stages(filled: list[str]) -> list:
    # The extra slot for unseen values is the one the encoder drops: unseen becomes all zero.
    return [
        StringIndexer(
            inputCols=filled, outputCols=[f"{c}_index" for c in filled],
            stringOrderType="alphabetAsc", handleInvalid="keep",
        ),
        OneHotEncoder(
            inputCols=[f"{c}_index" for c in filled], outputCols=[f"{c}_hot" for c in filled],
            dropLast=True,
        ),
    ]


def _mode_transformer(train: DataFrame, columns: list[str]) -> SQLTransformer:
    # A column without any value becomes one category of its own.
    found = {r["feature"]: r["mode"] or NO_CATEGORY for r in modes(train, columns).collect()}
    parts = [f"coalesce(`{c}`, {_sql_text(found.get(c, NO_CATEGORY))}) AS `{c}_filled`" for c in columns]
    return SQLTransformer(statement=f"SELECT *, {', '.join(parts)} FROM __THIS__")


def fit_onehot(train: DataFrame, columns: list[str] = CATEGORICAL_NAMES) -> PipelineModel:
    filled = [f"{c}_filled" for c in columns]
    stages = [
        _mode_transformer(train, columns), *_encoder_stages(filled),
        VectorAssembler(inputCols=[f"{c}_hot" for c in filled], outputCol="features"),
    ]
    return Pipeline(stages=stages).fit(train)


def fit_preparation(
    train: DataFrame,
    numerics: list[str] = NUMERIC_NAMES,
    categoricals: list[str] = CATEGORICAL_NAMES,
) -> PipelineModel:
    """Impute and scale numerics, impute and one-hot categoricals, numeric block first.

    Every stage is a persistable pipeline stage; other columns pass through. ``train`` is read
    several times: give it a stored table.
    """
    fit = fit_numeric(train, numerics)
    scaled = [
        f"(coalesce(`{c}`, double('{fit.medians[c]!r}')) - double('{fit.means[c]!r}'))"
        f" / double('{fit.stds[c]!r}') AS `{c}_scaled`"
        for c in numerics
    ]
    filled = [f"{c}_filled" for c in categoricals]
    stages = [
        SQLTransformer(statement=f"SELECT *, {', '.join(scaled)} FROM __THIS__"),
        _mode_transformer(train, categoricals),
        *_encoder_stages(filled),
        VectorAssembler(
            inputCols=[f"{c}_scaled" for c in numerics] + [f"{c}_hot" for c in filled],
            outputCol="features",
        ),
    ]
    return Pipeline(stages=stages).fit(train)


def encoded_categories(model: PipelineModel) -> list[str]:
    """``Feature_value`` for every one-hot column, in vector order."""
    indexer = next(s for s in model.stages if hasattr(s, "labelsArray"))
    names = [c.removesuffix("_filled") for c in indexer.getInputCols()]
    return [f"{n}_{v}" for n, labels in zip(names, indexer.labelsArray) for v in labels]


def feature_names(model: PipelineModel, numerics: list[str] = NUMERIC_NAMES) -> list[str]:
    """Names of the encoded features: numerics unchanged, then the one-hot columns."""
    return [*numerics, *encoded_categories(model)]


def transform_prepared(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Apply the fitted preparation and drop its helper columns."""
    out = model.transform(df)
    return out.select(*df.columns, "features")


def onehot_long(model: PipelineModel, df: DataFrame) -> DataFrame:
    """The one-hot block as rows (key, feature, hot)."""
    names = F.array(*[F.lit(n) for n in encoded_categories(model)])
    hot = vector_to_array("features")
    pairs = F.arrays_zip(names.alias("feature"), hot.alias("hot"))
    return model.transform(df).select(KEY, F.inline(pairs))
