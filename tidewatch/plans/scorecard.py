"""A fixed linear scorecard with additive contributions.

It stands in for a trained model where a query must be checked against SQL: same columns as the
scored customers, and contributions whose sum is the log-odds. Row-local, no fitted state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.labels import churn_decision, risk_tier
from tidewatch.functions.numbers import round_scaled
from tidewatch.plans.registry import block
from tidewatch.schema import CATEGORICAL_NAMES, KEY, LABEL, NUMERIC_NAMES

# Centre, scale and weight per numeric feature.
POINTS = {
    "Age": (47.0, 17.0, -0.3), "Membership_Years": (5.2, 0.5, 0.05),
    "Login_Frequency": (66.0, 9.0, -0.2), "Session_Duration_Avg": (50.0, 7.0, -0.35),
    "Pages_Per_Session": (0.7, 0.2, 0.15), "Cart_Abandonment_Rate": (40.0, 35.0, 0.45),
    "Wishlist_Items": (13.0, 4.0, -0.12), "Total_Purchases": (1.0, 2.0, -0.6),
    "Average_Order_Value": (250000.0, 50000.0, 0.25), "Days_Since_Last_Purchase": (250.0, 200.0, 0.9),
    "Discount_Usage_Rate": (54.0, 10.0, 0.1), "Returns_Rate": (33.0, 9.0, 0.3),
    "Email_Open_Rate": (20.0, 6.0, -0.15), "Customer_Service_Calls": (13.0, 4.0, 0.5),
    "Product_Reviews_Written": (13.0, 4.0, -0.1), "Social_Media_Engagement_Score": (660.0, 250.0, -0.08),
    "Mobile_App_Usage": (27.0, 4.0, -0.2), "Payment_Method_Diversity": (4.2, 0.8, 0.05),
    "Lifetime_Value": (2150000.0, 800000.0, -0.7), "Credit_Balance": (4500.0, 3000.0, -0.25),
}
CATEGORIES = {
    "Gender": ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"],
    "Country": sorted(f"NATION_{i}" for i in range(25)),
    "Signup_Quarter": ["Q1", "Q2", "Q3", "Q4"],
}
ENCODED = NUMERIC_NAMES + [f"{c}_{v}" for c in CATEGORICAL_NAMES for v in CATEGORIES[c]]
BIAS = -0.9
SHARE = 0.25


def _weight(i: int) -> float:
    return ((i * 7) % 5 - 2) / 10.0


def _hot():
    return [(c, v, _weight(i)) for c in CATEGORICAL_NAMES for i, v in enumerate(CATEGORIES[c])]


def score(df: DataFrame) -> DataFrame:
    """Add contributions, probability, decision, tier and a second model's prediction."""
    parts = [
        f"coalesce(double('{w}') * ((`{c}` - double('{m}')) / double('{s}')), 0D)"
        for c, (m, s, w) in POINTS.items()
    ]
    parts += [
        f"if(`{c}` <=> '{v}', double('{w * (1 - SHARE)!r}'), double('{-w * SHARE!r}'))"
        for c, v, w in _hot()
    ]
    scored = df.withColumn("contributions", F.expr(f"array({', '.join(parts)})"))
    terms = [f"double('{BIAS}')"] + [f"contributions[{i}]" for i in range(len(ENCODED))]
    scored = scored.withColumn("margin", F.expr(" + ".join(terms)))
    probability = 1.0 / (1.0 + F.exp(-F.col("margin")))
    second = 1.0 / (1.0 + F.exp(-(0.8 * F.col("margin") + 0.3 * ((F.col(KEY) % 7) - 3))))
    scored = scored.withColumns({"probability": probability, "second": second})
    pred = (F.col("probability") >= 0.5).cast("int")
    return scored.withColumns(
        {
            "y_true": F.col(LABEL),
            "y_pred": pred,
            "y_proba": round_scaled(F.col("probability"), 4),
            "churn_decision": churn_decision(pred),
            "risk_tier": risk_tier(F.col("probability")),
            "rf_pred": (F.col("second") >= 0.5).cast("int"),
            "rf_proba": round_scaled(F.col("second"), 4),
        }
    ).drop("margin", "second")


def _sql() -> None:
    cols = []
    for i, (c, (m, s, w)) in enumerate(POINTS.items()):
        cols.append(f"coalesce({w}::DOUBLE * ((\"{c}\" - {m}::DOUBLE) / {s}::DOUBLE), 0.0::DOUBLE) AS c_{i}")
    for j, (c, v, w) in enumerate(_hot()):
        cols.append(
            f"CASE WHEN \"{c}\" = '{v}' THEN CAST('{w * (1 - SHARE)!r}' AS DOUBLE) ELSE CAST('{-w * SHARE!r}' AS DOUBLE) END"
            f" AS c_{len(POINTS) + j}"
        )
    block("x_parts", f"SELECT *, {', '.join(cols)} FROM x_clean")
    total = " + ".join(["CAST('-0.9' AS DOUBLE)"] + [f"c_{i}" for i in range(len(ENCODED))])
    block("x_margin", f"SELECT *, {total} AS margin FROM x_parts")
    block("x_prob", """
SELECT *, 1.0::DOUBLE / (1.0::DOUBLE + exp(-margin)) AS probability,
       1.0::DOUBLE / (1.0::DOUBLE + exp(-(CAST('0.8' AS DOUBLE) * margin + CAST('0.3' AS DOUBLE) * (customer_id % 7 - 3)))) AS second
FROM x_margin""")
    block("x_scored", """
SELECT * EXCLUDE (margin, second), "Churned" AS y_true, CAST(probability >= 0.5 AS INTEGER) AS y_pred,
       round_even(probability * 10000, 0) / 10000 AS y_proba,
       CASE WHEN probability >= 0.5 THEN 'CHURN' ELSE 'RETAIN' END AS churn_decision,
       CASE WHEN probability >= 0.80 THEN 'Critical' WHEN probability >= 0.60 THEN 'High'
            WHEN probability >= 0.40 THEN 'Medium' ELSE 'Low' END AS risk_tier,
       CAST(second >= 0.5 AS INTEGER) AS rf_pred, round_even(second * 10000, 0) / 10000 AS rf_proba
FROM x_prob""")


_sql()
