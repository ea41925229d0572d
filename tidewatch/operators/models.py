"""Two tree ensembles: fit, persist, score, importances."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions.numbers import round_exact
from tidewatch.operators import boosting, forest
from tidewatch.operators.boosting import BoostedModel, TreeModel
from tidewatch.operators.forest import ForestModel
from tidewatch.operators.split import class_weights
from tidewatch.schema import KEY, LABEL
from tidewatch.settings import BoostParams, ForestParams

MODELS = ["random_forest", "boosted_trees"]


def weighted(df: DataFrame, train: DataFrame, kind: str) -> DataFrame:
    """Add the class weight found on ``train`` (two values)."""
    rows = class_weights(train).collect()
    out = F.lit(1.0)
    for row in rows:
        out = F.when(F.col(LABEL) == row[LABEL], F.lit(row[kind])).otherwise(out)
    return df.withColumn("weight", out)


def fit_forest(train: DataFrame, params: ForestParams = ForestParams()) -> ForestModel:
    """Random forest with balanced class weights on a prepared, stored training table (see ``forest``)."""
    return forest.fit(weighted(train, train, "balanced"), params)


def fit_boosted(train: DataFrame, validation: DataFrame, params: BoostParams = BoostParams()) -> BoostedModel:
    """Boosted trees that stop after ``patience`` rounds without better validation log-loss (see ``boosting``)."""
    return boosting.fit(weighted(train, train, "positive_weight"), validation, params)


_CLASSES = {
    "preparation": PipelineModel,
    "random_forest": ForestModel,
    "boosted_trees": BoostedModel,
}


def save(model, path: str) -> str:
    """Persist a fitted preparation or ensemble."""
    if isinstance(model, TreeModel):
        return model.save(path)
    model.write().overwrite().save(path)
    return path


def load(kind: str, path: str):
    """Reload what ``save`` stored; ``kind`` is preparation, random_forest or boosted_trees."""
    return _CLASSES[kind].load(path)


def score_customers(prepared: DataFrame, model) -> DataFrame:
    """Add ``y_pred`` and ``y_proba`` (unrounded churn probability)."""
    out = model.transform(prepared)
    return out.select(
        *prepared.columns,
        F.col("prediction").cast("int").alias("y_pred"),
        vector_to_array("probability")[1].alias("y_proba"),
    )


def prediction_table(scored: DataFrame) -> DataFrame:
    return scored.select(KEY, F.col(LABEL).alias("y_true"), "y_pred", "y_proba")


def held_out_predictions(prepared: DataFrame, name: str, model) -> DataFrame:
    """(model, split, key, y_true, y_pred, y_proba) on validation and test."""
    held = prepared.filter(F.col("split") != "train").select(KEY, "split", LABEL, "features")
    return score_customers(held, model).select(
        F.lit(name).alias("model"), "split", KEY, F.col(LABEL).alias("y_true"), "y_pred", "y_proba"
    )


def feature_importances(
    spark: SparkSession, model, names: list[str], top: int = 10
) -> DataFrame:
    """(rank, feature, importance): the largest global importances, four decimals.

    The importances are one number per encoded feature, held by the model.
    """
    pairs = list(enumerate(zip(names, (float(v) for v in model.featureImportances.toArray()))))
    ordered = sorted(pairs, key=lambda p: (-p[1][1], p[0]))[:top]
    rows = [(rank, name, value) for rank, (_, (name, value)) in enumerate(ordered, 1)]
    df = spark.createDataFrame(rows, "rank int, feature string, importance double")
    return df.withColumn("importance", round_exact(F.col("importance"), 4))

