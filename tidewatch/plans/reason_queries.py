"""Roll-up of contributions, ranking and phrasing of reasons."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.functions.numbers import each_number, value_text
from tidewatch.operators import reasons
from tidewatch.plans import data
from tidewatch.plans.columns_queries import scored_table
from tidewatch.plans.registry import block, query
from tidewatch.plans.scorecard import CATEGORIES, ENCODED
from tidewatch.schema import (
    CATEGORICAL_NAMES,
    DESCRIPTIONS,
    DIRECTIONS,
    FEATURES,
    KEY,
    NUMERIC_NAMES,
    feature_dimension,
)


def with_rolled(spark, folder, mode="abs"):
    return reasons.rollup_contributions(scored_table(spark, folder), ENCODED, mode=mode)


def with_reasons(spark, folder):
    df, names = with_rolled(spark, folder)
    return reasons.top_reasons(df, names)


def with_reason_columns(spark, folder):
    return with_reasons(spark, folder).transform(reasons.reason_columns)


def explained(spark, folder):
    """Customers with reasons, as a stored stage.

    Every text is stored once: the joined reasons and the columns by rank are read off the array of reasons.
    Contributions stay in the stored scores.
    """
    stored = data.stage(
        spark, folder, "explained",
        lambda: with_reasons(spark, folder).drop("contributions", "rolled"),
    )
    return reasons.reason_columns(stored)


def _rolled_sql(name: str, fold: str) -> None:
    terms = [f"c_{i} AS r_{i}" for i in range(len(NUMERIC_NAMES))]
    position = len(NUMERIC_NAMES)
    for j, c in enumerate(CATEGORICAL_NAMES):
        parts = [fold.format(f"c_{position + k}") for k in range(len(CATEGORIES[c]))]
        terms.append(f"0.0::DOUBLE + {' + '.join(parts)} AS r_{len(NUMERIC_NAMES) + j}")
        position += len(CATEGORIES[c])
    block(name, f"SELECT *, {', '.join(terms)} FROM x_scored")


_rolled_sql("x_rolled", "abs({})")
_rolled_sql("x_signed", "{}")
block("x_dim", "\nUNION ALL ".join(
    f"SELECT {i} AS position, '{c}' AS feature, '{DESCRIPTIONS[c]}' AS description, {DIRECTIONS.get(c, 0)} AS direction"
    for i, c in enumerate(FEATURES)
))
block("x_long", "\nUNION ALL ".join(
    f"SELECT customer_id, {i} AS position, '{c}' AS feature, r_{i} AS v, "
    + (f"coalesce(CAST(CAST(printf('%.2f', \"{c}\") AS DOUBLE) AS VARCHAR), 'missing')" if c in NUMERIC_NAMES
       else f"coalesce(\"{c}\", 'missing')") + " AS value FROM x_rolled"
    for i, c in enumerate(FEATURES)
))
block("x_top", """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY abs(v) DESC, position) AS k FROM x_long) WHERE k <= 5
""")
block("x_reason", """
SELECT customer_id, CAST(k AS INTEGER) AS k, x_top.feature, CAST(printf('%.4f', v) AS DOUBLE) + 0.0 AS shap_value, value AS feature_value,
       v, description, direction,
       CASE WHEN v > 0 AND direction = 1 THEN 'High ' || description || ' (' || value || ') increases churn risk'
            WHEN v > 0 AND direction = -1 THEN 'Low ' || description || ' (' || value || ') increases churn risk'
            WHEN v > 0 THEN description || ' = ' || value || ' increases churn risk'
            WHEN direction = 1 THEN 'Low ' || description || ' (' || value || ') reduces churn risk'
            WHEN direction = -1 THEN 'High ' || description || ' (' || value || ') reduces churn risk'
            ELSE description || ' = ' || value || ' reduces churn risk' END AS reason
FROM x_top JOIN x_dim ON x_dim.feature = x_top.feature
""")
block("x_reasons", """
SELECT *, reason || ' [SHAP=' || printf('%+.2f', v) || ', ' ||
       CASE WHEN abs(v) >= 1.5 THEN 'dominant driver' WHEN abs(v) >= 0.5 THEN 'strong signal'
            WHEN abs(v) >= CAST('0.15' AS DOUBLE) THEN 'moderate signal' ELSE 'weak signal' END || ']' AS reason_with_magnitude
FROM x_reason
""")
block("x_explained", """
SELECT x_scored.*, top_5_reasons, reason_1, reason_2, reason_3, reason_4, reason_5, f1, f2, f3
FROM x_scored JOIN (
  SELECT customer_id, string_agg(reason_with_magnitude, ' | ' ORDER BY k) AS top_5_reasons,
         max(CASE WHEN k = 1 THEN reason_with_magnitude END) AS reason_1, max(CASE WHEN k = 2 THEN reason_with_magnitude END) AS reason_2,
         max(CASE WHEN k = 3 THEN reason_with_magnitude END) AS reason_3, max(CASE WHEN k = 4 THEN reason_with_magnitude END) AS reason_4,
         max(CASE WHEN k = 5 THEN reason_with_magnitude END) AS reason_5,
         max(CASE WHEN k = 1 THEN feature END) AS f1, max(CASE WHEN k = 2 THEN feature END) AS f2, max(CASE WHEN k = 3 THEN feature END) AS f3
  FROM x_reasons GROUP BY customer_id) USING (customer_id)
""")


@query("rollup_onehot", """
SELECT DISTINCT x.feature AS encoded, CASE WHEN x.feature LIKE 'Gender\\_%' ESCAPE '\\' THEN 'Gender'
       WHEN x.feature LIKE 'Country\\_%' ESCAPE '\\' THEN 'Country' ELSE 'Signup_Quarter' END AS original
FROM (SELECT 'Gender_' || "Gender" AS feature FROM x_train UNION SELECT 'Country_' || "Country" FROM x_train
      UNION SELECT 'Signup_Quarter_' || "Signup_Quarter" FROM x_train) x WHERE x.feature IS NOT NULL
""")
def rollup_onehot(spark, folder):
    """Encoded names found in the training data, each with the first feature that prefixes it."""
    df = data.with_split(spark, folder, CATEGORICAL_NAMES).filter(F.col("split") == "train")
    pairs = F.array(*[F.concat(F.lit(f"{c}_"), F.col(c)) for c in CATEGORICAL_NAMES])
    encoded = df.select(F.explode(F.array_compact(pairs)).alias("encoded")).distinct()
    found = F.filter(
        F.array(*[F.lit(c) for c in FEATURES]),
        lambda o: (F.col("encoded") == o) | F.startswith(F.col("encoded"), F.concat(o, F.lit("_"))),
    )
    return encoded.withColumn("original", F.get(found, 0))


def _rolled_long(spark, folder, mode):
    df, names = with_rolled(spark, folder, mode)
    pairs = F.arrays_zip(F.array(*[F.lit(n) for n in names]).alias("feature"), F.col("rolled").alias("v"))
    return df.select(KEY, F.inline_outer(pairs)).select(KEY, "feature", F.col("v").alias("contribution"))


@query("rollup_contributions", "SELECT customer_id, feature, v AS contribution FROM x_long")
def rollup_contributions(spark, folder):
    return _rolled_long(spark, folder, "abs")


@query("rollup_signed", "\nUNION ALL ".join(
    f"SELECT customer_id, '{c}' AS feature, r_{i} AS contribution FROM x_signed"
    for i, c in enumerate(FEATURES)))
def rollup_signed(spark, folder):
    return _rolled_long(spark, folder, "signed")


@query("top5_reasons", "SELECT customer_id, k, feature, shap_value, feature_value, reason, reason_with_magnitude FROM x_reasons")
def top5_reasons(spark, folder):
    df = with_reasons(spark, folder)
    return df.select(KEY, F.posexplode_outer("reasons").alias("k", "r")).select(
        KEY, (F.col("k") + 1).alias("k"), "r.*"
    )


@query("reason_text", "SELECT customer_id, feature, reason FROM x_reasons")
def reason_text(spark, folder):
    df = with_reasons(spark, folder)
    return df.select(KEY, F.explode_outer("reasons").alias("r")).select(KEY, "r.feature", "r.reason")


@query("reason_with_magnitude", "SELECT customer_id, feature, reason_with_magnitude FROM x_reasons")
def reason_with_magnitude(spark, folder):
    df = with_reasons(spark, folder)
    return df.select(KEY, F.explode_outer("reasons").alias("r")).select(KEY, "r.feature", "r.reason_with_magnitude")


@query("join_reasons", "SELECT customer_id, top_5_reasons FROM x_explained")
def join_reasons(spark, folder):
    return with_reason_columns(spark, folder).select(KEY, "top_5_reasons")


@query("reason_columns", "SELECT customer_id, reason_1, reason_2, reason_3, reason_4, reason_5 FROM x_explained")
def reason_columns(spark, folder):
    return with_reason_columns(spark, folder).select(KEY, *[f"reason_{k}" for k in range(1, 6)])


@query("describe_feature", "SELECT customer_id, feature, description, direction FROM x_reasons")
def describe_feature(spark, folder):
    df = with_reasons(spark, folder).select(KEY, F.explode_outer("reasons.feature").alias("feature"))
    return reasons.describe_features(df, feature_dimension(spark))


def _encoded_sql() -> str:
    arms = []
    hot = [(c, v) for c in CATEGORICAL_NAMES for v in CATEGORIES[c]]
    for i, name in enumerate(ENCODED):
        base = reasons.base_feature(name)
        value = (
            f"coalesce(CAST(CAST(printf('%.2f', \"{name}\") AS DOUBLE) AS VARCHAR), 'missing')" if i < len(NUMERIC_NAMES)
            else "CASE WHEN \"{}\" = '{}' THEN '1.0' ELSE '0.0' END".format(*hot[i - len(NUMERIC_NAMES)])
        )
        arms.append(
            f"SELECT customer_id, {i} AS position, '{name}' AS feature, c_{i} AS v, {value} AS feature_value, "
            f"'{DESCRIPTIONS.get(base, name)}' AS description, {DIRECTIONS.get(base, 0)} AS direction FROM x_scored"
        )
    block("x_encoded", "\nUNION ALL ".join(arms))
    return """
SELECT customer_id, feature, CAST(printf('%.4f', v) AS DOUBLE) + 0.0 AS shap_value, feature_value,
       CASE WHEN direction = 0 THEN description || ' = ' || feature_value
            WHEN (v > 0) = (direction = 1) THEN 'High ' || description || ' (' || feature_value || ')'
            ELSE 'Low ' || description || ' (' || feature_value || ')' END
       || CASE WHEN v > 0 THEN ' increases churn risk' ELSE ' reduces churn risk' END AS reason
FROM (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY abs(v) DESC, position) AS k FROM x_encoded) WHERE k <= 3
"""


@query("top_n_encoded_reasons", _encoded_sql())
def top_n_encoded_reasons(spark, folder):
    hot = [(c, v) for c in CATEGORICAL_NAMES for v in CATEGORIES[c]]
    numbers = each_number([F.col(c) for c in NUMERIC_NAMES], lambda x: value_text(x, "double"))
    flags = F.array(*[F.when(F.col(c) == v, "1.0").otherwise("0.0") for c, v in hot])
    df = scored_table(spark, folder).withColumn("encoded_values", F.concat(numbers, flags))
    df = reasons.top_encoded_reasons(df, ENCODED)
    return df.select(KEY, F.inline_outer("encoded_reasons"))


@query("wide_attributions", "SELECT customer_id, " + ", ".join(
    f'round_even(c_{i} * 10000, 0) / 10000 + 0.0 AS "shap_{n}"' for i, n in enumerate(ENCODED)) + " FROM x_scored")
def wide_attributions(spark, folder):
    df = reasons.wide_attributions(scored_table(spark, folder), ENCODED)
    return df.select(KEY, *[f"shap_{n}" for n in ENCODED])


@query("enriched_scorecard", "SELECT customer_id, " + ", ".join(f'"{c}"' for c in FEATURES)
       + ", y_true, y_pred, y_proba, churn_decision, risk_tier, "
       + ", ".join(f'round_even(c_{i} * 10000, 0) / 10000 + 0.0 AS "shap_{n}"' for i, n in enumerate(ENCODED))
       + ", top_5_reasons, reason_1, reason_2, reason_3, reason_4, reason_5 FROM x_explained")
def enriched_scorecard(spark, folder):
    df = reasons.wide_attributions(with_reason_columns(spark, folder), ENCODED)
    return df.select(*enriched_layout(ENCODED))


def enriched_layout(encoded: list[str]) -> list[str]:
    """Features, predictions, attributions, reasons."""
    return [
        KEY, *FEATURES, "y_true", "y_pred", "y_proba", "churn_decision", "risk_tier",
        *[f"shap_{n}" for n in encoded], "top_5_reasons", *[f"reason_{k}" for k in range(1, 6)],
    ]

