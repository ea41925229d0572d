"""Row-level column operators over scored customers."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.functions.labels import strength_label
from tidewatch.functions.numbers import each_number, fmt_number, round_scaled, value_text
from tidewatch.operators import cleaning
from tidewatch.plans import data
from tidewatch.plans.registry import query
from tidewatch.plans.scorecard import score
from tidewatch.schema import FEATURES, KEY, NUMERIC_NAMES


def scored(spark, folder):
    """Scored customers with their split. Scoring is row-local, so it stays lazy over the stored customers."""
    return score(data.customers(spark, folder))


def scored_table(spark, folder):
    """Scored customers as a stored stage, for queries that take the contributions apart.

    Lazy, the optimizer would copy the expression of the array into each of its fifty uses.
    """
    return data.stage(spark, folder, "scored", lambda: scored(spark, folder))


@query("churn_decision", "SELECT customer_id, churn_decision FROM x_scored")
def churn_decision(spark, folder):
    return scored(spark, folder).select(KEY, "churn_decision")


@query("risk_tier", "SELECT customer_id, risk_tier FROM x_scored")
def risk_tier(spark, folder):
    return scored(spark, folder).select(KEY, "risk_tier")


@query("round_outputs", """
SELECT customer_id, y_proba, """ + ", ".join(
    f"round_even(c_{i} * 10000, 0) / 10000 + 0.0 AS shap_{c}" for i, c in enumerate(NUMERIC_NAMES)
) + " FROM x_scored")
def round_outputs(spark, folder):
    df = scored(spark, folder)
    return df.select(
        KEY, "y_proba",
        *[round_scaled(F.col("contributions")[i], 4).alias(f"shap_{c}") for i, c in enumerate(NUMERIC_NAMES)],
    )


@query("rename_drop", "SELECT customer_id, y_pred AS rf_pred, y_proba AS rf_proba FROM x_scored")
def rename_drop(spark, folder):
    df = scored(spark, folder).select(KEY, "y_true", "y_pred", "y_proba")
    return cleaning.rename_drop(df, {"y_pred": "rf_pred", "y_proba": "rf_proba"}, ["y_true"])


@query("add_missing_columns", """
SELECT customer_id, y_true, CAST(NULL AS VARCHAR) AS qwen_decision, CAST(NULL AS VARCHAR) AS qwen_explanation,
       CAST(NULL AS VARCHAR) AS qwen_recommendation, CAST(NULL AS DOUBLE) AS qwen_time_sec FROM x_scored
""")
def add_missing_columns(spark, folder):
    columns = {f"qwen_{c}": "string" for c in ("decision", "explanation", "recommendation")}
    df = scored(spark, folder).select(KEY, "y_true")
    return cleaning.add_missing_columns(df, columns | {"qwen_time_sec": "double"})


@query("cast_label", 'SELECT customer_id, CAST(CAST("Churned" AS VARCHAR) AS INTEGER) AS y_true FROM x_features')
def cast_label(spark, folder):
    df = data.labelled(spark, folder).select(KEY, F.col("Churned").cast("string").alias("y_true"))
    return cleaning.cast_label(df, "y_true")


@query("value_text", "SELECT customer_id, " + ", ".join(
    f"coalesce(CAST(CAST(printf('%.2f', \"{c}\") AS DOUBLE) AS VARCHAR), 'missing') AS \"{c}\""
    for c in NUMERIC_NAMES) + ", coalesce(\"Signup_Quarter\", 'missing') AS \"Signup_Quarter\" FROM x_clean")
def value_texts(spark, folder):
    df = data.cleaned(spark, folder, [KEY, *NUMERIC_NAMES, "Signup_Quarter"])
    texts = each_number([F.col(c) for c in NUMERIC_NAMES], lambda x: value_text(x, "double"))
    return df.withColumn("_t", texts).select(
        KEY, *[F.get("_t", i).alias(c) for i, c in enumerate(NUMERIC_NAMES)],
        value_text(F.col("Signup_Quarter"), "string").alias("Signup_Quarter"),
    )


@query("fmt_number", "SELECT customer_id, " + ", ".join(
    f"coalesce(printf('%.{d}f', \"{c}\"), 'N/A') AS \"{c}_{d}\"" for c in NUMERIC_NAMES for d in (0, 2))
    + " FROM x_clean")
def fmt_numbers(spark, folder):
    df = data.cleaned(spark, folder, [KEY, *NUMERIC_NAMES])
    numbers = [F.col(c) for c in NUMERIC_NAMES]
    whole = each_number(numbers, lambda x: fmt_number(x, "double", 0))
    cents = each_number(numbers, lambda x: fmt_number(x, "double", 2))
    texts = {"_0": whole, "_2": cents}
    return df.withColumns(texts).select(
        KEY, *[F.get(f"_{d}", i).alias(f"{c}_{d}") for i, c in enumerate(NUMERIC_NAMES) for d in (0, 2)]
    )


@query("strength_label", "SELECT customer_id, " + ", ".join(
    f"CASE WHEN abs(c_{i}) >= 1.5 THEN 'dominant driver' WHEN abs(c_{i}) >= 0.5 THEN 'strong signal' "
    f"WHEN abs(c_{i}) >= CAST('0.15' AS DOUBLE) THEN 'moderate signal' ELSE 'weak signal' END AS \"{c}\""
    for i, c in enumerate(NUMERIC_NAMES)) + " FROM x_scored")
def strength_labels(spark, folder):
    df = scored(spark, folder)
    return df.select(
        KEY, *[strength_label(F.col("contributions")[i]).alias(c) for i, c in enumerate(NUMERIC_NAMES)]
    )


@query("preview", """
SELECT customer_id, "Age", "Membership_Years", y_proba, churn_decision, risk_tier FROM x_scored ORDER BY customer_id LIMIT 3
""")
def preview(spark, folder):
    df = scored(spark, folder)
    return df.select(KEY, *FEATURES[:2], "y_proba", "churn_decision", "risk_tier").orderBy(KEY).limit(3)

