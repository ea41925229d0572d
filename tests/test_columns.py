"""Rounding, text, clipping, tiers, reasons on their boundaries."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tidewatch.functions import prompts as P
from tidewatch.functions.labels import risk_tier, strength_label
from tidewatch.functions.numbers import (
    fixed_text,
    fmt_number,
    percent_text,
    round_exact,
    round_scaled,
    signed_text,
    value_text,
)
from tidewatch.functions.reasons import reason_text
from tidewatch.operators.cleaning import clip
from tidewatch.operators.reasons import base_feature, rollup_contributions, top_reasons
from tidewatch.schema import FEATURES, feature_kinds
from tidewatch.sources.tables import nan_to_null


def one(spark, values, kind, *columns):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [tuple(r)[1:] for r in df.select("i", *columns).orderBy("i").collect()]


def test_rounding_follows_the_binary_value(spark):
    rng = random.Random(1)
    values = [0.125, 2.675, 1.005, -2.675, 0.5, 1.5, -0.001, 1e12 + 0.125, 0.0, 35.0, 0.045, 1.115]
    values += [rng.choice([rng.random(), rng.uniform(-1e6, 1e6), rng.randrange(10**6) / 1000]) for _ in range(2000)]
    values += [k / 200 for k in range(-400, 400)]
    got = one(
        spark, values, "double", round_exact(F.col("x"), 2), fixed_text(F.col("x"), 2),
        signed_text(F.col("x"), 2), value_text(F.col("x"), "double"), round_scaled(F.col("x"), 2),
    )
    import numpy as np

    for v, (rounded, text, signed, shown, scaled) in zip(values, got):
        assert rounded == round(v, 2)
        assert text == f"{v:.2f}"
        if v != 0 and not text.startswith("-0.00"):
            assert signed == f"{v:+.2f}"
        assert shown == str(round(v, 2))
        assert scaled == np.round(v, 2)


def test_number_text_of_missing_and_text_values(spark):
    got = one(spark, [None, math.nan, 35.0, 1e16, 12345678.12], "double",
              fmt_number(F.col("x")), value_text(F.col("x"), "double"))
    assert got == [("N/A", "missing"), ("N/A", "missing"), ("35.00", "35.0"),
                   ("10000000000000000.00", "1e+16"), ("12345678.12", "12345678.12")]
    got = one(spark, [None, "abc", "2.5"], "string", fmt_number(F.col("x"), "string"))
    assert [g[0] for g in got] == ["N/A", "abc", "2.50"]


def test_percent_is_half_even(spark):
    got = one(spark, [27, 1, 5, 53, 157], "bigint", percent_text(F.col("x"), F.lit(200)))
    assert [g[0] for g in got] == [14, 0, 2, 26, 78]


def test_clip_keeps_null(spark):
    values = [None, -13.0, 0.0, 100.0, 143.7]
    got = one(spark, values, "double", clip(F.col("x"), 0.0, 100.0), clip(F.col("x"), 0.0, None))
    assert got == [(None, None), (0.0, 0.0), (0.0, 0.0), (100.0, 100.0), (100.0, 143.7)]
    df = spark.createDataFrame([(math.nan,), (1.0,)], "x double")
    assert {r[0] for r in nan_to_null(df).collect()} == {None, 1.0}


def test_tiers_and_strengths(spark):
    got = one(spark, [0.8, 0.79996, 0.6, 0.4, 0.39999, 0.0, 1.0], "double", risk_tier(F.col("x")))
    assert [g[0] for g in got] == ["Critical", "High", "High", "Medium", "Low", "Low", "Critical"]
    got = one(spark, [1.5, -1.5, 1.4999, -0.5, 0.15, -0.1499, 0.0], "double", strength_label(F.col("x")))
    assert [g[0].split()[0] for g in got] == ["dominant", "dominant", "strong", "strong", "moderate", "weak", "weak"]


@pytest.mark.parametrize("direction,rises,falls", [
    (1, "High D (v) increases churn risk", "Low D (v) reduces churn risk"),
    (-1, "Low D (v) increases churn risk", "High D (v) reduces churn risk"),
    (0, "D = v increases churn risk", "D = v reduces churn risk"),
])
def test_nine_phrases(spark, direction, rises, falls):
    text = reason_text(F.col("x"), F.lit(direction), F.lit("D"), F.lit("v"))
    assert [g[0] for g in one(spark, [0.3, 0.0, -0.3], "double", text)] == [rises, falls, falls]


def test_rollup_and_ranking(spark):
    encoded = ["Age", "Gender_a", "Gender_b", "Returns_Rate", "Mystery"]
    df = spark.createDataFrame(
        [(1, 30.0, "a", None, [-0.5, 0.2, -0.3, 0.5, 9.0])],
        "customer_id bigint, Age double, Gender string, Returns_Rate double, contributions array<double>",
    )
    rolled, names = rollup_contributions(df, encoded, FEATURES)
    assert names == ["Age", "Returns_Rate", "Gender", "Mystery"]
    assert rolled.first()["rolled"] == [-0.5, 0.5, 0.5, 9.0]
    signed = rollup_contributions(df, encoded, FEATURES, mode="signed")[0].first()["rolled"]
    assert signed[2] == pytest.approx(-0.1)
    reasons = top_reasons(rolled, names).first()["reasons"]
    assert [r["feature"] for r in reasons] == ["Age", "Returns_Rate", "Gender"]
    assert reasons[0]["reason_with_magnitude"] == "High Age (30.0) reduces churn risk [SHAP=-0.50, strong signal]"
    assert reasons[1]["reason"] == "High Returns rate (missing) increases churn risk"
    assert reasons[2]["reason"] == "Gender = a increases churn risk"
    assert [base_feature(n) for n in ("Country_X", "Signup_Quarter_Q1", "Age", "Other_1")] == [
        "Country", "Signup_Quarter", "Age", "Other_1"]


def test_panel_agreement(spark):
    rows = [("CHURN", "CHURN"), ("CHURN", "RETAIN"), ("RETAIN", "N/A"), ("N/A", "N/A")]
    df = spark.createDataFrame(rows, "a string, b string")
    got = [r[0] for r in df.select(P.panel_agreement(F.col("a"), F.col("b"))).collect()]
    assert got == [
        "Full agreement — both models predict CHURN",
        "Disagreement — XGBoost predicts CHURN, Random Forest predicts RETAIN",
        "Full agreement — both models predict RETAIN",
        "Disagreement — XGBoost predicts N/A, Random Forest predicts N/A",
    ]


def test_feature_kinds_checks_types(spark):
    assert feature_kinds(spark.createDataFrame([], "customer_id bigint, Age double, Gender string")) == (["Age"], ["Gender"])
    with pytest.raises(TypeError):
        feature_kinds(spark.createDataFrame([], "Age string"))
