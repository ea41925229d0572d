"""Split, preparation, metrics, guards, side files."""

import random

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tidewatch.functions.numbers import fixed_text, round_exact
from tidewatch.operators import metrics, prepare, split
from tidewatch.operators.patterns import seeded_sample
from tidewatch.operators.prompts import benchmark_texts, importance_text
from tidewatch.operators.replies import wide_replies
from tidewatch.schema import NUMERIC_NAMES
from tidewatch.session import work_path
from tidewatch.settings import SplitParams
from tidewatch.sources import guards, side_inputs, sinks


@pytest.mark.parametrize("n,positives,sizes", [(50000, 14450, (34999, 7500, 7501)), (5001, 1443, (3500, 750, 751)), (37, 5, (25, 6, 6))])
def test_split_sizes_and_ranks(spark, n, positives, sizes):
    df = spark.range(n).select(F.col("id").alias("customer_id"), (F.col("id") < positives).cast("int").alias("Churned"))
    got = split.stratified_split(df)
    found = {r["split"]: (r["n"], r["p"]) for r in got.groupBy("split").agg(F.count("*").alias("n"), F.sum("Churned").alias("p")).collect()}
    assert tuple(found[s][0] for s in ("train", "val", "test")) == sizes
    for count, pos in found.values():
        assert abs(pos - count * positives / n) <= 1
    assert got.select("customer_id").distinct().count() == n
    coarse = split.stratified_split(df, SplitParams(bucket_digits=1))
    assert got.exceptAll(coarse).count() == 0


def test_medians_and_modes(spark):
    df = spark.createDataFrame(
        [(1.0, 7.0, None, "b"), (2.0, 7.0, None, "a"), (3.0, 7.0, None, "c"), (4.0, 7.0, None, "a"), (None, 7.0, None, "b")],
        "a double, b double, c double, g string")
    got = {r[0]: r[1] for r in prepare.exact_medians(df, ["a", "b", "c"]).collect()}
    assert got == {"a": 2.5, "b": 7.0, "c": None}
    assert prepare.modes(df, ["g"]).first()["mode"] == "a"
    fit = prepare.fit_numeric(df.filter("a is not null"), ["a", "b"])
    assert fit.stds["b"] == 1.0 and fit.stds["a"] == pytest.approx(1.1180, abs=1e-4)


def test_median_of_a_skewed_column_matches_the_full_sort(spark):
    df = spark.range(60001).select(
        F.when(F.col("id") % 3 == 0, F.lit(5.0)).otherwise(F.pow(F.col("id") % 1009, F.lit(3)) + F.col("id") / 7).alias("x"),
        F.when(F.col("id") % 5 > 0, F.col("id").cast("double")).alias("y"))
    got = {r[0]: r[1] for r in prepare.exact_medians(df, ["x", "y"]).collect()}
    want = df.agg(F.median("x"), F.median("y")).first()
    assert (got["x"], got["y"]) == tuple(want)


def test_medians_by_repeated_histograms(spark, monkeypatch):
    """Brackets that miss, few bins, ties, even and odd counts, wide ranges and infinite ends."""
    rng = random.Random(3)
    rows = [(
        rng.lognormvariate(0, 40), rng.randint(0, 3) * 1.0, rng.choice([-1e308, 1e308, 0.5, 5e-324]),
        rng.choice([float("-inf"), float("inf"), -2.5, 2.0, 3.0]), None if rng.random() < 0.4 else rng.gauss(1e9, 1e-3), None)
        for _ in range(2001)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e double, f double")
    monkeypatch.setattr(prepare, "BINS", 8)

    def plain(i):
        values = sorted(r[i] for r in rows if r[i] is not None)
        n = len(values)
        return (values[(n - 1) // 2] + values[n // 2]) / 2 if n else None

    # A sketch of accuracy 2 and no margin: brackets miss the middle, and the whole range is taken.
    for margin, accuracy in ((2e-4, 20000), (0.0, 2)):
        got = {r[0]: r[1] for r in prepare.exact_medians(df, list("abcdef"), margin, accuracy).collect()}
        assert got == {c: plain(i) for i, c in enumerate("abcdef")}


def test_unseen_category_is_all_zero(spark):
    schema = "customer_id bigint, Gender string, Country string, Signup_Quarter string"
    train = spark.createDataFrame([(1, "m", "x", "Q1"), (2, "f", "y", "Q1"), (3, "f", None, None)], schema)
    model = prepare.fit_onehot(train)
    assert prepare.encoded_categories(model) == ["Gender_f", "Gender_m", "Country_x", "Country_y", "Signup_Quarter_Q1"]
    new = spark.createDataFrame([(9, "other", None, "Q1")], schema)
    hot = {r["feature"]: r["hot"] for r in prepare.onehot_long(model, new).collect()}
    assert hot == {"Gender_f": 0.0, "Gender_m": 0.0, "Country_x": 1.0, "Country_y": 0.0, "Signup_Quarter_Q1": 1.0}


# Published results: (tp, fp, fn, tn) with accuracy, precision, recall, F1 and AUC on hard labels.
PUBLISHED = [
    ((1788, 304, 379, 5029), (0.9089333333, 0.8546845124, 0.8251038302, 0.8396337168, None)),
    ((1747, 294, 421, 5039), (0.9046793761, 0.8559529642, 0.8058118081, 0.8301259206, None)),
    ((1819, 272, 348, 5061), (0.9173333333, 0.8699186992, 0.8394093216, 0.8543917332, None)),
    ((1790, 291, 378, 5042), (0.9108118917, 0.8601633830, 0.8256457565, 0.8425511885, None)),
    ((1613, 120, 555, 5213), (0.91, 0.9308, 0.744, 0.827, 0.8608)),
    ((1791, 294, 377, 5039), (0.9105, 0.859, 0.8261, 0.8422, 0.8855)),
]


def test_published_metrics_from_counts(spark):
    df = spark.createDataFrame([(i, *c) for i, (c, _) in enumerate(PUBLISHED)], "i int, tp bigint, fp bigint, fn bigint, tn bigint")
    got = metrics.from_counts(df).orderBy("i").collect()
    for row, (_, want) in zip(got, PUBLISHED):
        digits = 10 if want[4] is None else 4
        for name, value in zip(("accuracy", "precision", "recall", "f1"), want):
            assert round(row[name], digits) == value
        if want[4] is not None:
            assert round(row["hard_auc"], 4) == want[4]


def test_auc_ties_and_extremes(spark):
    rows = [("tied", 0, .5), ("tied", 1, .5), ("tied", 0, .5), ("good", 0, .1), ("good", 1, .9),
            ("bad", 0, .9), ("bad", 1, .1), ("single", 1, .4)]
    df = spark.createDataFrame(rows, "model string, y_true int, y_proba double")
    got = {r[0]: r[1] for r in metrics.roc_auc(df, ["model"]).collect()}
    assert got == {"tied": 0.5, "good": 1.0, "bad": 0.0, "single": None}
    big = spark.range(20000).select(
        (F.hash("id") % 3 == 0).cast("int").alias("y_true"),
        F.when(F.col("id") % 3 == 0, F.lit(0.25)).otherwise(F.round(F.rand(3), 5)).alias("y_proba"))
    rows = [(r[0], r[1]) for r in big.collect()]
    pos, neg = sorted(s for y, s in rows if y), sorted(s for y, s in rows if not y)
    import bisect
    wins = sum(bisect.bisect_left(neg, s) + (bisect.bisect_right(neg, s) - bisect.bisect_left(neg, s)) / 2 for s in pos)
    assert metrics.roc_auc(big, []).first()[0] == pytest.approx(wins / (len(pos) * len(neg)), abs=1e-12)


def test_reply_metrics_without_positive_or_valid_rows(spark):
    df = spark.createDataFrame(
        [("a", 1, "retain", "x", 2.0), ("a", 0, " Retain ", "[parse_error] y", 0.0), ("b", 1, None, None, 1.0)],
        "model string, y_true int, decision string, explanation string, time_sec double")
    rows = metrics.reply_metrics(df).collect()
    assert len(rows) == 1
    row = rows[0]
    assert (row["model"], row["n_evaluated"], row["precision"], row["avg_time_sec"], row["parse_failure_rate"]) == ("a", 2, 0.0, 1.0, 0.5)


def test_guards(spark, tmp_path):
    left = spark.createDataFrame([(1, 0), (2, 1), (3, 1)], "customer_id bigint, y_true int")
    right = spark.createDataFrame([(1, 0), (2, 0), (4, 1)], "customer_id bigint, y_true int")
    assert tuple(guards.violations(left, right).first()) == (1, 1, 1, 0, 0, 0)
    twice = left.union(left.filter("customer_id = 1"))
    assert tuple(guards.violations(left, twice).first()) == (0, 0, 0, 0, 1, -1)
    assert tuple(guards.violations(twice, left).first()) == (0, 0, 0, 1, 0, 1)
    for a, b in ((left, twice), (twice, left)):
        with pytest.raises(ValueError, match="repeated"):
            guards.aligned_join(a, b)
    guards.require_aligned(left, left)
    with pytest.raises(ValueError):
        guards.require_aligned(left, right)
    with pytest.raises(FileNotFoundError):
        guards.require_path(spark, str(tmp_path / "none"))
    assert guards.aligned_join(left, left.withColumn("z", F.lit(1))).count() == 3
    with pytest.raises(ValueError, match="not from the same customers"):
        guards.aligned_join(left, right)


def test_wide_replies_refuse_conflicts(spark):
    schema = "customer_id long, y_true int, model string, decision string, explanation string, recommendation string, time_sec double"
    row = lambda k, y, m: (k, y, m, "churn", "e", "r", 1.0)
    good = spark.createDataFrame([row(1, 0, "qwen"), row(1, 0, "gemma"), row(2, 1, "qwen")], schema)
    assert wide_replies(good, ["qwen", "gemma"]).count() == 2
    for more, what in ((row(2, 0, "gemma"), "labels differ"), (row(1, 0, "qwen"), "two replies")):
        with pytest.raises(Exception, match=what):
            wide_replies(good.union(spark.createDataFrame([more], schema)), ["qwen", "gemma"]).collect()


def test_rounding_at_any_magnitude(spark):
    rng = random.Random(4)
    values = [12345678901234.125, 12345678901234.375, 4503599627370495.5, 1125899906842624.125, 9007199254740993.0, 1e17, -12345678901234.125]
    values += [sign * rng.uniform(1, 9.99) * 10.0**e for e in range(9, 17) for sign in (1, -1) for _ in range(40)]
    values += [float(rng.randrange(2**51)) + 0.5 for _ in range(20)] + [k + 0.999 for k in (11258999068426.0, 1125899906842623.0)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for digits in (0, 1, 2, 3):
        rows = df.select("v", round_exact(F.col("v"), digits).alias("r"), fixed_text(F.col("v"), digits).alias("t")).collect()
        for row in rows:
            assert row.r == round(row.v, digits), (row.v, digits)
            assert row.t == f"{row.v:.{digits}f}", (row.v, digits)


def test_columns_without_values_can_be_fitted(spark):
    df = spark.createDataFrame(
        [(1, 1.0, None, "a", None), (2, None, None, None, None), (3, 3.0, None, "b", None)],
        "customer_id long, Age double, Returns_Rate double, Gender string, Country string")
    model = prepare.fit_preparation(df, ["Age", "Returns_Rate"], ["Gender", "Country"])
    assert prepare.feature_names(model, ["Age", "Returns_Rate"]) == ["Age", "Returns_Rate", "Gender_a", "Gender_b", "Country_missing"]
    out = prepare.transform_prepared(model, df).select(vector_to_array("features").alias("x")).collect()
    assert all(r.x[1] == 0.0 and r.x[4] == 1.0 for r in out)


def test_side_files_round_trip(spark, tmp_path):
    bench = spark.createDataFrame([(0, "Age", 35.788, 38.62), (1, "Returns_Rate", 7.0, 6.493)],
                                  "position int, feature string, churned_mean double, retained_mean double")
    path = sinks.write_json_text(sinks.benchmark_json(bench), str(tmp_path / "bench"))
    assert side_inputs.load_benchmarks(spark, path).orderBy("position").collect() == bench.collect()
    imp = spark.createDataFrame([(1, "Customer_Service_Calls", 0.1471), (2, "Social_Media_Engagement_Score", 0.05)],
                                "rank int, feature string, importance double")
    path = sinks.write_json_text(sinks.importance_json(imp), str(tmp_path / "imp"))
    loaded = side_inputs.load_importances(spark, path)
    assert loaded.orderBy("rank").collect() == imp.collect()
    assert importance_text(loaded).first()[0] == "Customer_Service_Calls=0.147  Social=0.050"
    with pytest.warns(UserWarning):
        assert side_inputs.load_importances(spark, str(tmp_path / "gone")).count() == 0
    with pytest.warns(UserWarning):
        empty = side_inputs.load_benchmarks(spark, str(tmp_path / "gone"))
    cols = ", ".join(f"cast(1 as double) as {c}" for c in NUMERIC_NAMES)
    df = spark.sql(f"select {cols}, 'Low Age (1) x' as reason_1, '' as reason_2, '' as reason_3")
    assert benchmark_texts(df, empty).first()["benchmark_lines"] == ""
    assert benchmark_texts(df, bench).first()["benchmark_lines"] == "  Age: customer=1.00 | avg churner=35.788 | avg retained=38.62"


def test_nested_metrics_json(spark):
    import json
    df = spark.createDataFrame([("m", "test", "f1", 0.5), ("m", "val", "f1", 0.25), ("k", "test", "f1", 1.0)],
                               "model string, split string, metric string, value double")
    assert json.loads(sinks.nested_metrics(df).first()[0]) == {"m": {"test": {"f1": 0.5}, "val": {"f1": 0.25}}, "k": {"test": {"f1": 1.0}}}


def test_sample_is_limited_before_the_shuffle(spark):
    df = spark.read.parquet(sinks.write_table(spark.range(1000).select(F.col("id").alias("customer_id"), F.lit("m").alias("model")), work_path(spark, "s")))
    sample = seeded_sample(df, ["model"], 20)
    assert "WindowGroupLimit" in sample._jdf.queryExecution().executedPlan().toString()
    assert sample.count() == 20
