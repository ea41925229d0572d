"""Fitted operators, files and the whole pipeline, as statements that SQL can check.

A trained model's numbers have no SQL; what must hold of them has. Each entry counts violations, or gives rows
that SQL derives without the model.
"""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tidewatch.functions import prompts as P
from tidewatch.operators import metrics, models, prompts, replies
from tidewatch.operators.generate import requests
from tidewatch.operators.prepare import transform_prepared
from tidewatch.plans import data, model_queries
from tidewatch.plans.metric_queries import predictions as scorecard_predictions
from tidewatch.plans.prompt_queries import benchmarks, importances
from tidewatch.plans.registry import block, query
from tidewatch.plans.reply_queries import answered, raw
from tidewatch.schema import CATEGORICAL_NAMES, FEATURES, KEY, LABEL, NUMERIC_NAMES, feature_kinds
from tidewatch.session import work_path
from tidewatch.settings import GenerationParams
from tidewatch.sources import side_inputs, sinks

# Classification reports


def _report_sql(counts: str, keys: list[str], digits: int) -> str:
    k = ", ".join(keys)
    share = "CASE WHEN {1} = 0 THEN 0 ELSE ({0})::DOUBLE / ({1}) END".format
    shown = f"CAST(printf('%.{digits}f', {{0}}) AS DOUBLE) AS {{0}}".format
    return f"""
SELECT {k}, label, {shown('precision')}, {shown('recall')}, {shown('f1')}, support FROM (
  SELECT {k}, unnest([
    {{'label': 'Retained', 'precision': p0, 'recall': r0, 'f1': f0, 'support': s0}},
    {{'label': 'Churned', 'precision': p1, 'recall': r1, 'f1': f1, 'support': s1}},
    {{'label': 'accuracy', 'precision': NULL, 'recall': NULL, 'f1': (tp + tn)::DOUBLE / s, 'support': s}},
    {{'label': 'macro avg', 'precision': (p0 + p1) / 2, 'recall': (r0 + r1) / 2, 'f1': (f0 + f1) / 2, 'support': s}},
    {{'label': 'weighted avg', 'precision': (p0 * s0 + p1 * s1) / s, 'recall': (r0 * s0 + r1 * s1) / s,
      'f1': (f0 * s0 + f1 * s1) / s, 'support': s}}], recursive := true)
  FROM (SELECT *, {share('2 * p0 * r0', 'p0 + r0')} AS f0, {share('2 * p1 * r1', 'p1 + r1')} AS f1
        FROM (SELECT *, tn + fp AS s0, fn + tp AS s1, tn + fp + fn + tp AS s, {share('tn', 'tn + fn')} AS p0,
                     {share('tn', 'tn + fp')} AS r0, {share('tp', 'tp + fp')} AS p1, {share('tp', 'tp + fn')} AS r1
              FROM {counts})))
"""


block("x_reply_confusion", """
SELECT model, count(*) FILTER (WHERE y = 0 AND p = 0) AS tn, count(*) FILTER (WHERE y = 0 AND p = 1) AS fp,
       count(*) FILTER (WHERE y = 1 AND p = 0) AS fn, count(*) FILTER (WHERE y = 1 AND p = 1) AS tp
FROM (SELECT model, y_true AS y, CAST(lower(trim(decision)) = 'churn' AS INTEGER) AS p FROM x_answered) GROUP BY model
""")
block("x_card_confusion", """
SELECT model, split, tn, fp, fn, tp FROM x_report_f
""")


def _reply_labels(spark, folder):
    return answered(spark, folder).select("model", "y_true", metrics.reply_label(F.col("decision")).alias("y_pred"))


@query("reply_classification_report", _report_sql("x_reply_confusion", ["model"], 4))
def reply_classification_report(spark, folder):
    return metrics.classification_report(_reply_labels(spark, folder), ["model"])


@query("classification_report_short", _report_sql("x_card_confusion", ["model", "split"], 2))
def classification_report_short(spark, folder):
    return metrics.classification_report(scorecard_predictions(spark, folder), ["model", "split"], digits=2)


# Preparation and models

_CATEGORIES = " UNION ALL ".join(
    f"""SELECT {i} AS f, '{c}' AS feature, "{c}" AS value FROM x_train WHERE "{c}" IS NOT NULL GROUP BY "{c}\""""
    for i, c in enumerate(CATEGORICAL_NAMES))
block("x_encoded_names", f"""
SELECT CAST({len(NUMERIC_NAMES)} + row_number() OVER (ORDER BY f, value) - 1 AS INTEGER) AS position, feature, value
FROM ({_CATEGORIES})
""")
_SCALED = ", ".join(f'("{c}" - m_{c}) / s_{c}' for c in NUMERIC_NAMES)
_FILLED = ", ".join(
    f"coalesce(\"{c}\", (SELECT mode FROM x_modes WHERE feature = '{c}')) AS \"{c}\"" for c in CATEGORICAL_NAMES)
_OWN = " ".join(f"WHEN '{c}' THEN \"{c}\"" for c in CATEGORICAL_NAMES)


@query("assembled_vector", f"""
SELECT customer_id, position, round_even(value, 6) + 0.0 AS value FROM (
  SELECT customer_id, unnest(range({len(NUMERIC_NAMES)}))::INTEGER AS position, unnest([{_SCALED}]) AS value FROM x_filled, x_scale
  UNION ALL
  SELECT customer_id, position, CASE WHEN CASE feature {_OWN} END = value THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END
  FROM (SELECT customer_id, {_FILLED} FROM x_clean), x_encoded_names)
""")
def assembled_vector(spark, folder):
    """The assembled vector of every customer, element by element."""
    ready = model_queries.fitted(spark, folder, "preparation")[1]
    df = transform_prepared(ready, data.customers(spark, folder))
    return df.select(KEY, F.posexplode(vector_to_array("features")).alias("position", "value")).withColumn(
        "value", F.bround("value", 6) + F.lit(0.0))


@query("encoded_names", f"""
SELECT unnest(range({len(NUMERIC_NAMES)}))::INTEGER AS position, unnest({NUMERIC_NAMES}) AS name
UNION ALL SELECT position, feature || '_' || value FROM x_encoded_names
""")
def encoded_names(spark, folder):
    rows = list(enumerate(model_queries.names(spark, folder)))
    return spark.createDataFrame(rows, "position int, name string")


@query("feature_lists", "SELECT unnest(" + str(FEATURES) + ") AS feature, unnest("
       + str(["numeric"] * len(NUMERIC_NAMES) + ["categorical"] * len(CATEGORICAL_NAMES)) + ") AS kind, (SELECT count(*) FROM customer) AS n_rows")
def feature_lists(spark, folder):
    """The feature lists found on the customer table, with its number of rows."""
    df = data.features(spark, folder)
    numeric, categorical = feature_kinds(df)
    kinds = [(n, "numeric") for n in numeric] + [(n, "categorical") for n in categorical]
    pairs = F.array(*[F.struct(F.lit(n).alias("feature"), F.lit(k).alias("kind")) for n, k in kinds])
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.inline(pairs), "n_rows").select("feature", "kind", "n_rows")


@query("saved_preparation", "SELECT count(*) AS n, CAST(0 AS BIGINT) AS differing FROM customer")
def saved_preparation(spark, folder):
    """Vectors of the preparation before and after it is saved and loaded again."""
    model = model_queries.fitted(spark, folder, "preparation")[1]
    again = models.load("preparation", models.save(model, work_path(spark, "saved")))
    table = data.customers(spark, folder)
    a, b = (transform_prepared(m, table).select(KEY, vector_to_array("features").alias(n)) for m, n in ((model, "a"), (again, "b")))
    return a.join(b, KEY).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("a") != F.col("b")).alias("differing"))


@query("model_checks", """
SELECT model, split, count(*) AS n, CAST(0 AS BIGINT) AS foreign_rows, CAST(0 AS BIGINT) AS bad_probability, CAST(0 AS BIGINT) AS bad_decision
FROM x_split, (SELECT unnest(['random_forest', 'boosted_trees']) AS model) WHERE split <> 'train' GROUP BY model, split
""")
def model_checks(spark, folder):
    """Predictions of both ensembles: keys, splits and labels those of the split; sound probabilities."""
    tables = [model_queries.predictions(spark, folder, kind) for kind in models.MODELS]
    truth = data.customers(spark, folder).select(KEY, F.col("split").alias("_split"), F.col(LABEL).alias("_y"))
    df = tables[0].unionByName(tables[1]).join(truth, KEY, "left")
    p = F.col("y_proba")
    return df.groupBy("model", "split").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(~(F.col("_split").eqNullSafe(F.col("split")) & F.col("_y").eqNullSafe(F.col("y_true")))).alias("foreign_rows"),
        F.count_if(~F.coalesce(p.between(0, 1), F.lit(False))).alias("bad_probability"),
        F.count_if((p != 0.5) & ((p > 0.5).cast("int") != F.col("y_pred"))).alias("bad_decision"))


@query("training_fit", "SELECT unnest(['random_forest', 'boosted_trees']) AS model, (SELECT count(*) FROM x_split WHERE split = 'train') AS n, true AS better_than_chance")
def training_fit(spark, folder):
    """Both ensembles rank their own training rows well above chance."""
    parts = [model_queries.training_scores(spark, folder, kind).withColumn("model", F.lit(kind)) for kind in models.MODELS]
    df = parts[0].unionByName(parts[1])
    return df.groupBy("model").agg(F.count(F.lit(1)).alias("n")).join(metrics.roc_auc(df, ["model"]), "model").select(
        "model", "n", (F.col("roc_auc") > 0.7).alias("better_than_chance"))


@query("importance_checks", "SELECT unnest(range(1, 11))::INTEGER AS rank, true AS known, true AS in_order FROM (SELECT count(*) FROM customer)")
def importance_checks(spark, folder):
    """Ten importances of encoded features, falling, between 0 and 1."""
    names = model_queries.names(spark, folder)
    table = model_queries.feature_importance_top10(spark, folder)
    after = table.select((F.col("rank") - 1).alias("rank"), F.col("importance").alias("next"))
    return table.join(after, "rank", "left").select(
        "rank", F.col("feature").isin(names).alias("known"),
        (F.col("importance").between(0, 1) & (F.col("importance") >= F.coalesce("next", F.lit(0.0)))).alias("in_order"))


_N_TEST = "(SELECT count(*) FROM x_split WHERE split = 'test')"


@query("attribution_checks", f"SELECT {_N_TEST} AS n, CAST(0 AS BIGINT) AS bad_width, CAST(0 AS BIGINT) AS not_additive")
def attribution_checks(spark, folder):
    """Contributions and base add up to the log-odds of every test customer."""
    width = len(model_queries.names(spark, folder))
    df = model_queries.attributed_test(spark, folder)
    total = F.aggregate("contributions", F.lit(0.0), lambda a, x: a + x) + F.col("base")
    odds = F.log(F.col("y_proba") / (1 - F.col("y_proba")))
    return df.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.size("contributions") != width).alias("bad_width"),
        F.count_if(F.abs(total - odds) > 1e-6).alias("not_additive"))


@query("forest_attribution_checks", f"SELECT {_N_TEST} AS n, CAST(0 AS BIGINT) AS bad_width, CAST(0 AS BIGINT) AS not_additive")
def forest_attribution_checks(spark, folder):
    """The forest's contributions and base add up to its churn probability for every test customer."""
    width = len(model_queries.names(spark, folder))
    df = model_queries.attributed_test(spark, folder, "random_forest")
    total = F.aggregate("contributions", F.lit(0.0), lambda a, x: a + x) + F.col("base")
    return df.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.size("contributions") != width).alias("bad_width"),
        F.count_if(F.abs(total - F.col("y_proba")) > 1e-6).alias("not_additive"))


@query("saved_ensembles", f"""
SELECT unnest(['random_forest', 'boosted_trees']) AS model, {_N_TEST} AS n, CAST(0 AS BIGINT) AS differing
""")
def saved_ensembles(spark, folder):
    """Test scores of both ensembles before and after they are saved and loaded again."""
    test = model_queries.prepared(spark, folder).filter(F.col("split") == "test").select(KEY, "features")
    tables = []
    for kind in models.MODELS:
        model = model_queries.fitted(spark, folder, kind)[1]
        again = models.load(kind, models.save(model, work_path(spark, "saved")))
        a, b = (models.score_customers(test, m).select(KEY, F.col("y_proba").alias(n)) for m, n in ((model, "a"), (again, "b")))
        tables.append(a.join(b, KEY).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("a") != F.col("b")).alias("differing")).select(
            F.lit(kind).alias("model"), "n", "differing"))
    return tables[0].unionByName(tables[1])


@query("enriched_checks", f"""
SELECT customer_id, "Churned" AS y_true, true AS decided, true AS tiered, CAST(5 AS INTEGER) AS n_reasons FROM x_split WHERE split = 'test'
""")
def enriched_checks(spark, folder):
    """One explained row per test customer: label, decision, tier and five reasons that agree with the scores."""
    df = model_queries.enriched_customers(spark, folder)
    reasons = F.array(*[F.col(f"reason_{k}") for k in range(1, 6)])
    decided = (F.upper("churn_decision") == "CHURN") == (F.col("y_pred") == 1)
    return df.select(
        KEY, "y_true", decided.alias("decided"), F.col("risk_tier").isNotNull().alias("tiered"),
        F.size(F.filter(reasons, lambda r: r.isNotNull() & (r != ""))).alias("n_reasons"))


# The pipeline from customers to prompts


def real_prompts(spark, folder):
    """Prompts from trained models: explained test customers, the forest's predictions and importances."""
    enriched = model_queries.enriched_customers(spark, folder)
    forest = model_queries.predictions(spark, folder, "random_forest").filter("split = 'test'").select(KEY, "y_true", "y_pred", "y_proba")
    joined = prompts.join_second_model(enriched, forest)
    return prompts.build_prompts(joined, benchmarks(spark, folder), model_queries.feature_importance_top10(spark, folder))


@query("pipeline_prompts", f"""
SELECT customer_id, CAST(0 AS INTEGER) AS unfilled, CAST(5 AS INTEGER) AS reasons_shown, true AS importances_shown FROM x_split WHERE split = 'test'
""")
def pipeline_prompts(spark, folder):
    df = data.stage(
        spark, folder, "real_prompts",
        lambda: real_prompts(spark, folder).select(KEY, "prompt", *[f"reason_{k}" for k in range(1, 6)]))
    names = [text for named, text in P.pieces(P.PROMPT) if named]
    unfilled = F.size(F.filter(F.array(*[F.contains("prompt", F.lit("{" + n + "}")) for n in names]), lambda x: x))
    shown = F.size(F.filter(F.array(*[F.contains("prompt", F.col(f"reason_{k}")) for k in range(1, 6)]), lambda x: x))
    first = model_queries.feature_importance_top10(spark, folder).filter("rank = 1").select(
        P.short_feature_name(F.col("feature")).alias("name")).scalar()
    return df.select(
        KEY, unfilled.alias("unfilled"), shown.alias("reasons_shown"), F.contains("prompt", first).alias("importances_shown"))


# Side files and the choice of models


@query("benchmark_file", "SELECT position, feature, churned_mean, retained_mean FROM x_benchmarks")
def benchmark_file(spark, folder):
    """Benchmarks written as one JSON text and loaded again."""
    path = sinks.write_json_text(sinks.benchmark_json(benchmarks(spark, folder)), work_path(spark, "benchmarks_json"))
    return side_inputs.load_benchmarks(spark, path)


@query("importance_file", "SELECT * FROM x_importances")
def importance_file(spark, folder):
    path = sinks.write_json_text(sinks.importance_json(importances(spark, folder)), work_path(spark, "importances_json"))
    return side_inputs.load_importances(spark, path)


@query("model_choice", "SELECT customer_id, 'gemma' AS model FROM x_scored ORDER BY customer_id LIMIT 25")
def model_choice(spark, folder):
    """One model only, for the first customers: a dry run."""
    wanted = raw(spark, folder).select(KEY).distinct()
    return requests(wanted, GenerationParams(models=("gemma",), limit=25)).select(KEY, "model")


@query("aligned_replies", "SELECT customer_id, y_true FROM x_wide")
def aligned_replies(spark, folder):
    """Two models' tables, checked for equal keys and labels, joined."""
    df = answered(spark, folder)
    sides = [
        df.filter(F.col("model") == m).select(KEY, "y_true", *[F.col(c).alias(f"{m}_{c}") for c in replies.PARTS]) for m in ("qwen", "gemma")]
    return replies.aligned_join(*sides).select(KEY, "y_true")
