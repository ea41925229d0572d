"""Parsing, fallback, merging and metrics of replies."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.functions.replies import FALLBACK_ADVICE, json_candidate, strip_reply
from tidewatch.operators import metrics, replies
from tidewatch.plans import data
from tidewatch.plans.reason_queries import explained
from tidewatch.plans.registry import block, query
from tidewatch.plans.reply_fixture import raw_replies
from tidewatch.schema import KEY

# The models whose replies are compared.
MODELS = ["qwen", "gemma"]
_WHITE_SQL = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def raw(spark, folder):
    """Raw replies, composed row by row from the stored explained customers."""
    return raw_replies(explained(spark, folder))


def parsed(spark, folder):
    """Parsed replies, as a stored stage."""
    return data.stage(
        spark, folder, "parsed_replies", lambda: replies.parse_replies(raw(spark, folder))
    )


def answered(spark, folder):
    return replies.apply_fallback(parsed(spark, folder))


def _strip(text: str) -> str:
    return f"trim({text}, {_WHITE_SQL})"


block("x_stripped", f"""
SELECT *, {_strip(f"regexp_replace({_strip(f"regexp_replace({_strip(f"regexp_replace({_strip('raw_reply')}, '<think>.*?</think>', '', 'gs')")}, '^```(?:json)?[[:space:]]*', '', 'i')")}, '[[:space:]]*```$', '')")} AS text
FROM x_raw
""")
block("x_found", """
SELECT *, CASE WHEN regexp_matches(text, '\\{.*\\}', 's') THEN regexp_extract(text, '\\{.*\\}', 0, 's') END AS found FROM x_stripped
""")


def _parsed_sql(name: str, null_text: str) -> None:
    def field(f):
        return (f"CASE WHEN json_type(json_extract(found, '$.{f}')) = 'NULL' THEN '{null_text}' "
                f"WHEN json_type(json_extract(found, '$.{f}')) = 'BOOLEAN' THEN CASE json_extract_string(found, '$.{f}') WHEN 'true' THEN 'True' ELSE 'False' END "
                f"ELSE coalesce(json_extract_string(found, '$.{f}'), '') END")

    fields = ", ".join(f"CASE WHEN valid THEN {_strip(field(f))} END AS v_{f}" for f in ("decision", "explanation", "recommendation"))
    block(f"{name}_f", f"SELECT *, {fields}, lower(regexp_extract(text, '\"decision\"\\s*:\\s*\"(churn|retain)\"', 1, 'i')) AS rescued, "
          f"regexp_extract(text, '\"explanation\"\\s*:\\s*\"([^\"]{{20,}})', 1, 's') AS s_explanation, "
          f"regexp_extract(text, '\"recommendation\"\\s*:\\s*\"([^\"]{{10,}})', 1, 's') AS s_recommendation "
          "FROM (SELECT *, coalesce(json_valid(found), false) AS valid FROM x_found)")
    block(f"{name}_s", f"""
SELECT *, CASE WHEN valid AND lower(v_decision) IN ('churn', 'retain') AND v_explanation <> '' AND v_recommendation <> '' THEN 'ok'
               WHEN NOT valid AND rescued <> '' THEN 'salvaged' ELSE 'error' END AS status,
       CASE WHEN NOT valid THEN 'no_json' WHEN lower(v_decision) IN ('churn', 'retain') THEN 'empty_text' ELSE 'bad_decision' END AS trouble
FROM {name}_f""")
    tail = lambda f: f"CASE WHEN s_{f} = '' THEN '[truncated]' ELSE {_strip(f's_{f}')} || ' [truncated]' END"
    block(name, f"""
SELECT customer_id, model, y_true, y_proba, churn_decision, risk_tier, raw_reply, time_sec, status,
       CASE WHEN status = 'error' THEN trouble END AS problem,
       CASE status WHEN 'ok' THEN lower(v_decision) WHEN 'salvaged' THEN rescued END AS decision,
       CASE status WHEN 'ok' THEN v_explanation WHEN 'salvaged' THEN {tail('explanation')} END AS explanation,
       CASE status WHEN 'ok' THEN v_recommendation WHEN 'salvaged' THEN {tail('recommendation')} END AS recommendation
FROM {name}_s""")


_parsed_sql("x_parsed", "")
_parsed_sql("x_compat", "None")
block("x_answered", f"""
SELECT * REPLACE (
  CASE WHEN status = 'error' THEN lower(churn_decision) ELSE decision END AS decision,
  CASE WHEN status = 'error' THEN '[parse_error] ' || substring({_strip('raw_reply')}, 1, 300) ELSE explanation END AS explanation,
  CASE WHEN status = 'error' THEN '{FALLBACK_ADVICE}' ELSE recommendation END AS recommendation,
  CASE WHEN status = 'error' THEN 0.0::DOUBLE ELSE time_sec END AS time_sec)
FROM x_parsed
""")
block("x_wide", "SELECT customer_id, y_true, " + ", ".join(
    f"max(CASE WHEN model = '{m}' THEN {c} END) AS {m}_{c}" for m in MODELS for c in replies.PARTS)
    + " FROM x_answered GROUP BY customer_id, y_true")


@query("raw_replies", "SELECT * FROM x_raw")
def raw_reply_table(spark, folder):
    return raw(spark, folder)


@query("strip_reply", "SELECT customer_id, model, text, found FROM x_found")
def strip_replies(spark, folder):
    df = raw(spark, folder).withColumn("text", strip_reply(F.col("raw_reply")))
    return df.select(KEY, "model", "text", json_candidate(F.col("text")).alias("found"))


@query("parse_reply", "SELECT customer_id, model, decision, explanation, recommendation FROM x_parsed WHERE status = 'ok'")
def parse_reply(spark, folder):
    df = parsed(spark, folder).filter(F.col("status") == "ok")
    return df.select(KEY, "model", "decision", "explanation", "recommendation")


@query("parse_reply_compat", "SELECT customer_id, model, decision, explanation, recommendation, status FROM x_compat")
def parse_reply_compat(spark, folder):
    return replies.parse_replies(raw(spark, folder), compat=True).select(
        KEY, "model", "decision", "explanation", "recommendation", "status"
    )


@query("salvage_reply", "SELECT customer_id, model, decision, explanation, recommendation FROM x_parsed WHERE status = 'salvaged'")
def salvage_reply(spark, folder):
    df = parsed(spark, folder).filter(F.col("status") == "salvaged")
    return df.select(KEY, "model", "decision", "explanation", "recommendation")


@query("reply_status", "SELECT customer_id, model, status, problem FROM x_parsed")
def reply_status(spark, folder):
    return parsed(spark, folder).select(KEY, "model", "status", "problem")


@query("fallback_reply", "SELECT customer_id, model, decision, explanation, recommendation, time_sec FROM x_answered WHERE status = 'error'")
def fallback_reply(spark, folder):
    df = answered(spark, folder).filter(F.col("status") == "error")
    return df.select(KEY, "model", "decision", "explanation", "recommendation", "time_sec")


@query("valid_reply_mask", """
SELECT customer_id, model FROM (
  SELECT customer_id, model, CASE WHEN decision IS NULL AND customer_id % 2 = 0 THEN '[parse_error] ' || left(raw_reply, 20) ELSE decision END AS d
  FROM x_parsed) WHERE d IS NOT NULL AND NOT starts_with(d, '[parse_error]')
""")
def valid_reply_mask(spark, folder):
    """Parsed replies before the fallback: failed ones are null or, as older tables hold them, marked."""
    marked = F.when(
        F.col("decision").isNull() & (F.col(KEY) % 2 == 0), F.concat(F.lit("[parse_error] "), F.left("raw_reply", F.lit(20)))
    ).otherwise(F.col("decision"))
    return parsed(spark, folder).filter(metrics.valid_reply(marked)).select(KEY, "model")


@query("decision_to_label", "SELECT customer_id, model, CAST(lower(trim(decision)) = 'churn' AS INTEGER) AS y_pred FROM x_answered")
def decision_to_label(spark, folder):
    return answered(spark, folder).select(KEY, "model", metrics.reply_label(F.col("decision")).alias("y_pred"))


@query("not_null_filter", "SELECT customer_id, model, explanation FROM x_parsed WHERE explanation IS NOT NULL")
def not_null_filter(spark, folder):
    return parsed(spark, folder).filter(F.col("explanation").isNotNull()).select(KEY, "model", "explanation")


@query("merge_model_replies", "SELECT * FROM x_wide")
def merge_model_replies(spark, folder):
    long = answered(spark, folder)
    first, second = (replies.one_model(long, m) for m in MODELS)
    return replies.merge_model_replies(first, second, MODELS[1])


@query("wide_replies", "SELECT * FROM x_wide")
def wide_replies(spark, folder):
    return replies.wide_replies(answered(spark, folder), MODELS)


@query("disagreement_pairs", """
SELECT customer_id, qwen_decision, gemma_decision, qwen_explanation, gemma_explanation, qwen_recommendation, gemma_recommendation
FROM x_wide WHERE qwen_decision <> gemma_decision
""")
def disagreement_pairs(spark, folder):
    wide = replies.wide_replies(answered(spark, folder), MODELS)
    return replies.disagreements(wide, *MODELS).select(
        KEY, *[f"{m}_{c}" for c in ("decision", "explanation", "recommendation") for m in MODELS]
    )


@query("resume_anti_join", "SELECT customer_id, model FROM x_parsed WHERE decision IS NULL")
def resume_anti_join(spark, folder):
    wanted = raw(spark, folder).select(KEY, "model")
    return replies.not_yet_answered(wanted, parsed(spark, folder), [KEY, "model"])


block("x_reply_counts", """
SELECT model, count(*) AS n, count(*) FILTER (WHERE y_true = 0 AND p = 0) AS tn, count(*) FILTER (WHERE y_true = 0 AND p = 1) AS fp,
       count(*) FILTER (WHERE y_true = 1 AND p = 0) AS fn, count(*) FILTER (WHERE y_true = 1 AND p = 1) AS tp,
       avg(time_sec) AS seconds, avg(CAST(starts_with(explanation, '[parse_error]') AS INTEGER)) AS failed
FROM (SELECT *, CAST(lower(trim(decision)) = 'churn' AS INTEGER) AS p FROM x_answered) GROUP BY model
""")


@query("reply_metrics", """
SELECT model, n AS n_evaluated, """ + ", ".join(f"CAST(printf('%.4f', {e}) AS DOUBLE) AS {n}" for n, e in {
    "accuracy": "(tp + tn)::DOUBLE / n", "precision": "CASE WHEN tp + fp = 0 THEN 0 ELSE tp::DOUBLE / (tp + fp) END",
    "recall": "CASE WHEN tp + fn = 0 THEN 0 ELSE tp::DOUBLE / (tp + fn) END",
    "f1": "CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE (2 * tp)::DOUBLE / (2 * tp + fp + fn) END",
    "roc_auc": "(tp::DOUBLE / (tp + fn) + tn::DOUBLE / (tn + fp)) / 2", "parse_failure_rate": "failed",
}.items()) + ", CAST(printf('%.2f', seconds) AS DOUBLE) AS avg_time_sec FROM x_reply_counts")
def reply_metrics(spark, folder):
    return metrics.reply_metrics(answered(spark, folder))


@query("avg_reply_time", "SELECT model, CAST(printf('%.2f', avg(time_sec)) AS DOUBLE) AS avg_time_sec FROM x_answered GROUP BY model")
def avg_reply_time(spark, folder):
    return metrics.reply_metrics(answered(spark, folder)).select("model", "avg_time_sec")
