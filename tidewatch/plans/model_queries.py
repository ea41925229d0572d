"""Trained models, attributions, generation and incremental runs."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tidewatch.functions.labels import churn_decision, risk_tier
from tidewatch.functions.numbers import round_scaled
from tidewatch.operators import attribution, metrics, models, reasons
from tidewatch.operators.generate import generate_replies, requests
from tidewatch.operators.prepare import feature_names, fit_preparation, transform_prepared
from tidewatch.operators.replies import apply_fallback, parse_replies
from tidewatch.plans import data
from tidewatch.plans.echo_client import BreaksDown, PanelEcho
from tidewatch.plans.prompt_queries import prompts_for
from tidewatch.plans.reason_queries import enriched_layout
from tidewatch.plans.registry import query
from tidewatch.schema import KEY, LABEL
from tidewatch.session import checkpoint_root, work_path
from tidewatch.settings import GenerationParams
from tidewatch.sources.sinks import write_table
from tidewatch.streaming.incremental import run_batch, run_stream

_FITTED: dict[tuple[str, str, str], tuple[str, object]] = {}


def fitted(spark, folder, kind: str) -> tuple[str, object]:
    """A saved and reloaded model with its path, trained once per session and input folder."""
    key = (spark.sparkContext.applicationId, folder, kind)
    if key not in _FITTED:
        checkpoint_root(spark)
        if kind == "preparation":
            model = fit_preparation(data.training(spark, folder))
        else:
            train, val = (prepared(spark, folder).filter(F.col("split") == s) for s in ("train", "val"))
            model = models.fit_forest(train) if kind == "random_forest" else models.fit_boosted(train, val)
        path = models.save(model, work_path(spark, kind))
        _FITTED[key] = (path, models.load(kind, path))
    return _FITTED[key]


def prepared(spark, folder):
    """Customers with their feature vector, as a stored stage."""
    ready = fitted(spark, folder, "preparation")[1]
    return data.stage(
        spark, folder, "prepared", lambda: transform_prepared(ready, data.customers(spark, folder))
    )


def names(spark, folder) -> list[str]:
    return feature_names(fitted(spark, folder, "preparation")[1])


def predictions(spark, folder, kind: str):
    """Held-out scores of a model, as a stored stage: metrics read them several times."""
    model = fitted(spark, folder, kind)[1]
    return data.stage(
        spark, folder, f"predictions_{kind}", lambda: models.held_out_predictions(prepared(spark, folder), kind, model)
    )


def training_scores(spark, folder, kind: str):
    """Scores of a model's own training rows, as a stored stage."""
    model = fitted(spark, folder, kind)[1]
    train = prepared(spark, folder).filter(F.col("split") == "train").select(KEY, LABEL, "features")
    return data.stage(
        spark, folder, f"training_scores_{kind}", lambda: models.prediction_table(models.score_customers(train, model))
    )


@query("assemble")
def assemble(spark, folder):
    ready = fitted(spark, folder, "preparation")[1]
    df = transform_prepared(ready, data.customers(spark, folder))
    return df.select(KEY, "split", vector_to_array("features").alias("features"))


def _results(spark, folder, kind):
    return metrics.results_table(metrics.results_long(predictions(spark, folder, kind)))


@query("train_random_forest")
def train_random_forest(spark, folder):
    return _results(spark, folder, "random_forest")


@query("train_boosted_trees")
def train_boosted_trees(spark, folder):
    return _results(spark, folder, "boosted_trees")


@query("score_customers")
def score_customers(spark, folder):
    tables = [predictions(spark, folder, kind) for kind in models.MODELS]
    return tables[0].unionByName(tables[1]).select(KEY, "model", "split", "y_pred", "y_proba")


@query("prediction_table")
def prediction_table(spark, folder):
    test = prepared(spark, folder).filter(F.col("split") == "test")
    model = fitted(spark, folder, "boosted_trees")[1]
    return models.prediction_table(models.score_customers(test, model))


@query("feature_importance_top10")
def feature_importance_top10(spark, folder):
    model = fitted(spark, folder, "random_forest")[1]
    return models.feature_importances(spark, model, names(spark, folder))


def attributed_test(spark, folder, kind: str = "boosted_trees"):
    """Test customers with scores and contributions of a model."""
    path, model = fitted(spark, folder, kind)
    test = models.score_customers(prepared(spark, folder).filter(F.col("split") == "test"), model)
    return attribution.tree_attributions(test, path)


@query("tree_attributions")
def tree_attributions(spark, folder):
    pairs = F.arrays_zip(
        F.array(*[F.lit(n) for n in names(spark, folder)]).alias("feature"),
        F.col("contributions").alias("contribution"),
    )
    return attributed_test(spark, folder).select(KEY, "base", F.inline_outer(pairs))


@query("enriched_customers")
def enriched_customers(spark, folder):
    df = data.stage(
        spark, folder, "attributed", lambda: attributed_test(spark, folder).drop("features")
    )
    encoded = names(spark, folder)
    rolled, order = reasons.rollup_contributions(df, encoded)
    out = reasons.top_reasons(rolled, order).transform(reasons.reason_columns)
    out = reasons.wide_attributions(out, encoded).withColumns(
        {
            "y_true": F.col(LABEL), "risk_tier": risk_tier(F.col("y_proba")),
            "churn_decision": churn_decision(F.col("y_pred")),
            "y_proba": round_scaled(F.col("y_proba"), 4),
        }
    )
    return out.select(*enriched_layout(encoded))


def stored_prompts(spark, folder):
    return data.stage(
        spark, folder, "prompts",
        lambda: prompts_for(spark, folder).select(KEY, "y_true", "churn_decision", "prompt"),
    )


_REQUESTS = "x_prompts, (SELECT unnest(['qwen', 'gemma']) AS model)"


@query("generate_replies", f"""
SELECT customer_id, model, lower(churn_decision) AS decision, 'The first panel member predicts ' || lower(churn_decision) || '.' AS explanation,
       'Follow the panel.' AS recommendation, 'ok' AS status FROM {_REQUESTS}
""")
def generate(spark, folder):
    replies = generate_replies(requests(stored_prompts(spark, folder)), PanelEcho)
    return apply_fallback(parse_replies(replies)).select(
        KEY, "model", "decision", "explanation", "recommendation", "status"
    )


@query("retry_generation", f"SELECT customer_id, model, CASE WHEN length(prompt) % 5 = 0 THEN 2 ELSE 1 END AS attempts FROM {_REQUESTS}")
def retry_generation(spark, folder):
    replies = generate_replies(requests(stored_prompts(spark, folder)), PanelEcho)
    return replies.select(KEY, "model", "attempts")


@query("incremental_scoring", f"SELECT customer_id, model, lower(churn_decision) AS decision FROM {_REQUESTS}")
def incremental_scoring(spark, folder):
    """A run breaks down, half the prompts are answered, then all of them: no customer is asked twice."""
    prompts = stored_prompts(spark, folder)
    sink = work_path(spark, "answers")
    try:
        run_batch(prompts.filter(F.col(KEY) % 20 == 0), sink, BreaksDown, GenerationParams(on_error="raise"))
    except Exception as error:
        if "the server is gone" not in str(error):
            raise
    run_batch(prompts.filter(F.col(KEY) % 2 == 0), sink, PanelEcho)
    return run_batch(prompts, sink, PanelEcho).select(KEY, "model", "decision")


@query("incremental_stream", f"SELECT customer_id, model, lower(churn_decision) AS decision FROM {_REQUESTS}")
def incremental_stream(spark, folder):
    prompts = stored_prompts(spark, folder)
    source = write_table(prompts, work_path(spark, "arrivals"))
    answers = run_stream(
        spark, source, prompts.schema, work_path(spark, "answers"), work_path(spark, "progress"),
        PanelEcho, files_per_batch=4,
    )
    return answers.select(KEY, "model", "decision")
