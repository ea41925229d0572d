"""Panel inputs, benchmark matching and prompts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewatch.functions import prompts as P
from tidewatch.functions.numbers import fmt_number, round_exact
from tidewatch.operators import prompts
from tidewatch.operators.benchmarks import population_benchmarks
from tidewatch.plans import data
from tidewatch.plans.columns_queries import scored
from tidewatch.plans.reason_queries import explained
from tidewatch.plans.registry import block, query
from tidewatch.schema import CATEGORICAL_NAMES, KEY, NUMERIC_NAMES
from tidewatch.sources.guards import violations


def benchmarks(spark, folder):
    """Class means of the training rows, as a stored stage of 20 rows: prompts read it more than once.

    Prompts need the stored customers too, so the means are taken from them and no source table is read again.
    """
    return data.stage(
        spark, folder, "benchmarks", lambda: population_benchmarks(data.training(spark, folder))
    )


def importances(spark, folder):
    """Stand-in importances: the relative gap between the class means, ten largest.

    The benchmark table has one row per numeric feature, so one window is enough.
    """
    a, b = F.col("churned_mean"), F.col("retained_mean")
    gap = round_exact(F.abs(a - b) / (F.abs(a) + F.abs(b)), 4)
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc("importance"), "position")
    ranked = benchmarks(spark, folder).select("position", "feature", gap.alias("importance")).withColumn(
        "rank", F.row_number().over(order)
    )
    return ranked.filter(F.col("rank") <= 10).select("rank", "feature", "importance")


block("x_importances", """
SELECT CAST(row_number() OVER (ORDER BY importance DESC, position) AS INTEGER) AS rank, feature, importance
FROM (SELECT position, feature, CAST(printf('%.4f', abs(churned_mean - retained_mean) / (abs(churned_mean) + abs(retained_mean))) AS DOUBLE) AS importance
      FROM x_benchmarks)
QUALIFY row_number() OVER (ORDER BY importance DESC, position) <= 10
""")
block("x_importance_text", """
SELECT string_agg(CASE WHEN length(feature) > 25 THEN split_part(feature, '_', 1) ELSE feature END || '=' || printf('%.3f', importance), '  ' ORDER BY rank) AS importance_text
FROM x_importances WHERE rank <= 5
""")
block("x_match", """
SELECT customer_id, min(r) AS r, position FROM (
  SELECT customer_id, r, min(position) AS position FROM (
    SELECT customer_id, 1 AS r, lower(reason_1) AS t FROM x_explained UNION ALL SELECT customer_id, 2, lower(reason_2) FROM x_explained
    UNION ALL SELECT customer_id, 3, lower(reason_3) FROM x_explained) q
  JOIN x_benchmarks b ON contains(q.t, replace(lower(b.feature), '_', ' ')) OR contains(q.t, lower(b.feature))
  GROUP BY customer_id, r) GROUP BY customer_id, position
""")
block("x_match_feature", """
SELECT customer_id, r, position FROM (
  SELECT customer_id, 1 AS r, f1 AS f FROM x_explained UNION ALL SELECT customer_id, 2, f2 FROM x_explained
  UNION ALL SELECT customer_id, 3, f3 FROM x_explained) JOIN x_benchmarks ON feature = f
""")


def _matched_sql(name: str, source: str) -> None:
    value = "CASE feature " + " ".join(
        f"WHEN '{c}' THEN coalesce(printf('%.2f', \"{c}\"), 'N/A')" for c in NUMERIC_NAMES) + " END"
    block(name, f"""
SELECT customer_id, CAST(row_number() OVER (PARTITION BY customer_id ORDER BY r) - 1 AS INTEGER) AS k, feature,
       '  ' || feature || ': customer=' || {value} || ' | avg churner=' || CAST(churned_mean AS VARCHAR)
       || ' | avg retained=' || CAST(retained_mean AS VARCHAR) AS line
FROM (SELECT * FROM {source} UNION ALL
      SELECT customer_id, p, p FROM x_explained, (SELECT unnest([0, 1, 2]) AS p)
      WHERE customer_id NOT IN (SELECT customer_id FROM {source})) JOIN x_benchmarks USING (position) JOIN x_explained USING (customer_id)
""")


_matched_sql("x_matched", "x_match")
_matched_sql("x_matched_feature", "x_match_feature")
block("x_bench_lines", "SELECT customer_id, string_agg(line, chr(10) ORDER BY k) AS benchmark_lines FROM x_matched GROUP BY customer_id")


@query("top_importances", "SELECT * FROM x_importances WHERE rank <= 5")
def top_importances(spark, folder):
    return prompts.top_importances(importances(spark, folder))


@query("short_feature_name", """
SELECT customer_id, CASE WHEN length(feature) > 25 THEN split_part(feature, '_', 1) ELSE feature END AS short
FROM (SELECT customer_id, unnest([f1, f2, f3]) AS feature FROM x_explained)
""")
def short_feature_name(spark, folder):
    df = explained(spark, folder)
    named = df.select(KEY, F.explode_outer(F.slice("reasons.feature", 1, 3)).alias("feature"))
    return named.select(KEY, P.short_feature_name(F.col("feature")).alias("short"))


@query("attach_globals", "SELECT customer_id, (SELECT importance_text FROM x_importance_text) AS importances FROM x_scored")
def attach_globals(spark, folder):
    text = prompts.importance_text(importances(spark, folder)).scalar()
    return scored(spark, folder).select(KEY).withColumn("importances", text)


def panel_input(spark, folder):
    """Explained customers with the second model's stored prediction joined by key."""
    df = explained(spark, folder)
    second = scored(spark, folder).select(
        KEY, "y_true", F.col("rf_pred").alias("y_pred"), F.col("rf_proba").alias("y_proba")
    )
    return prompts.join_second_model(df.drop("rf_pred", "rf_proba"), second)


@query("join_rf_predictions", """
SELECT s.customer_id, s.y_true, s.y_pred, s.y_proba, CAST(n_late = 0 AS INTEGER) AS rf_pred, CASE WHEN n_late = 0 THEN 0.75::DOUBLE ELSE 0.25::DOUBLE END AS rf_proba
FROM x_scored s JOIN (SELECT c_custkey, count(*) FILTER (WHERE o_orderdate >= TIMESTAMP '2000-07-01') AS n_late
                      FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1) ON c_custkey = s.customer_id
""")
def join_rf_predictions(spark, folder):
    """The scorecard joined with a second table computed apart: no order since July predicts churn."""
    from tidewatch.sources.tables import read_table

    late = read_table(spark, folder, "orders").filter(
        F.col("o_orderdate") >= F.lit("2000-07-01").cast("timestamp_ntz")
    ).select(F.col("o_custkey").alias(KEY)).distinct().withColumn("late", F.lit(1))
    second = data.labelled(spark, folder).withColumnRenamed("Churned", "y_true").join(late, KEY, "left").select(
        KEY, "y_true", F.col("late").isNull().cast("int").alias("y_pred"),
        F.when(F.col("late").isNull(), 0.75).otherwise(0.25).alias("y_proba")
    )
    return prompts.join_second_model(scored(spark, folder).select(KEY, "y_true", "y_pred", "y_proba"), second)


@query("fmt_number_large", """
SELECT customer_id, f, CASE WHEN v IS NULL THEN 'N/A' ELSE printf('%.2f', v) END AS text
FROM (SELECT customer_id, f, "Lifetime_Value" * f AS v FROM x_features, (SELECT unnest([1e7, 1e8, 1e9, 3e9]::DOUBLE[]) AS f))
""")
def fmt_number_large(spark, folder):
    """Sums scaled up to where a double holds few decimals: rounding stays exact."""
    factors = F.explode(F.array(*[F.lit(f) for f in (1e7, 1e8, 1e9, 3e9)]))
    df = data.features(spark, folder, [KEY, "Lifetime_Value"]).select(KEY, "Lifetime_Value", factors.alias("f"))
    return df.select(KEY, "f", fmt_number(F.col("Lifetime_Value") * F.col("f")).alias("text"))


@query("input_guards", """
SELECT count(*) FILTER (WHERE b.customer_id IS NULL) AS only_left, count(*) FILTER (WHERE a.customer_id IS NULL) AS only_right,
       count(*) FILTER (WHERE a.customer_id IS NOT NULL AND b.customer_id IS NOT NULL AND (a.y IS DISTINCT FROM b.low OR a.y IS DISTINCT FROM b.high)) AS label_mismatch,
       CAST(0 AS BIGINT) AS repeated_left, count(*) FILTER (WHERE b.n > 1) AS repeated_right,
       CAST(count(a.customer_id) - coalesce(sum(b.n), 0) AS BIGINT) AS surplus_rows
FROM (SELECT c_custkey AS customer_id, y_true AS y FROM customer JOIN x_scored ON customer_id = c_custkey) a
FULL JOIN (SELECT customer_id, count(*) AS n, min(y) AS low, max(y) AS high FROM (
             SELECT o_custkey AS customer_id, CASE WHEN o_orderdate >= TIMESTAMP '2000-10-01' THEN 0 ELSE 1 END AS y, count(*) AS c
             FROM orders GROUP BY 1, 2) GROUP BY 1) b ON a.customer_id = b.customer_id
""")
def input_guards(spark, folder):
    """Customers against labels taken from their orders alone, one for each side of the cut-off: every count can occur."""
    from tidewatch.sources.tables import read_table

    late = F.col("o_orderdate") >= F.lit("2000-10-01").cast("timestamp_ntz")
    by_orders = read_table(spark, folder, "orders").select(
        F.col("o_custkey").alias(KEY), F.when(late, 0).otherwise(1).alias("y_true")
    ).distinct()
    return violations(data.labelled(spark, folder).withColumnRenamed("Churned", "y_true"), by_orders)


def _matched(spark, folder, mode):
    df = prompts.benchmark_texts(explained(spark, folder), benchmarks(spark, folder), mode)
    return df.select(KEY, F.posexplode_outer("matched").alias("k", "b")).select(KEY, "k", "b.feature")


@query("match_benchmarks", "SELECT customer_id, k, feature FROM x_matched")
def match_benchmarks(spark, folder):
    return _matched(spark, folder, "substring")


@query("match_benchmarks_by_feature", "SELECT customer_id, k, feature FROM x_matched_feature")
def match_benchmarks_by_feature(spark, folder):
    return _matched(spark, folder, "by_feature")


@query("benchmark_lines", "SELECT customer_id, benchmark_lines FROM x_bench_lines")
def benchmark_lines(spark, folder):
    df = prompts.benchmark_texts(explained(spark, folder), benchmarks(spark, folder))
    return df.select(KEY, "benchmark_lines")


block("x_panel", """
SELECT *, CASE WHEN rf_pred = 1 THEN 'CHURN' ELSE 'RETAIN' END AS second_decision,
       CASE WHEN (rf_pred = 1) = (churn_decision = 'CHURN') THEN 'Full agreement — both models predict ' || churn_decision
            ELSE 'Disagreement — XGBoost predicts ' || churn_decision || ', Random Forest predicts '
                 || CASE WHEN rf_pred = 1 THEN 'CHURN' ELSE 'RETAIN' END END AS agreement,
       concat_ws(chr(10), '    SHAP reason 1   : ' || reason_1, '    SHAP reason 2   : ' || reason_2, '    SHAP reason 3   : ' || reason_3,
                 '    SHAP reason 4   : ' || reason_4, '    SHAP reason 5   : ' || reason_5) AS reason_lines,
       CASE WHEN churn_decision = 'CHURN' AND rf_pred = 1 AND y_proba >= 0.8 THEN '""" + P.NOTICE.replace("'", "''") + """' ELSE '' END AS notice
FROM x_explained
""")


@query("panel_agreement", "SELECT customer_id, agreement FROM x_panel")
def panel_agreement(spark, folder):
    df = scored(spark, folder)
    text = P.panel_agreement(F.col("churn_decision"), P.decision_text(F.col("rf_pred")))
    return df.select(KEY, text.alias("agreement"))


@query("rf_decision_text", "SELECT customer_id, second_decision AS decision, printf('%.1f', rf_proba * 100) AS probability FROM x_panel")
def rf_decision_text(spark, folder):
    df = scored(spark, folder).withColumn("share", F.col("rf_proba") * 100)
    return df.select(
        KEY, P.decision_text(F.col("rf_pred")).alias("decision"),
        fmt_number(F.col("share"), "double", 1).alias("probability"),
    )


@query("consensus_notice", "SELECT customer_id, notice FROM x_panel")
def consensus_notice(spark, folder):
    df = scored(spark, folder)
    second = P.decision_text(F.col("rf_pred"))
    return df.select(
        KEY, P.consensus_notice(F.col("churn_decision"), second, F.col("y_proba")).alias("notice")
    )


@query("reason_lines", "SELECT customer_id, reason_lines FROM x_panel")
def reason_lines(spark, folder):
    df = explained(spark, folder)
    return df.select(KEY, P.reason_lines([F.col(f"reason_{k}") for k in range(1, 6)]).alias("reason_lines"))


def _prompt_sql() -> str:
    values = {
        c: f"coalesce(printf('%.{0 if c in P.WHOLE_NUMBERS else 2}f', \"{c}\"), 'N/A')" for c in P.PROMPT_NUMBERS
    }
    values |= {c: f"coalesce(\"{c}\", 'nan')" for c in CATEGORICAL_NAMES}
    values |= {
        "benchmark_section": f"'{P.BENCHMARK_HEADING}' || benchmark_lines || chr(10) || chr(10)",
        "boosted_auc": "'0.927'", "forest_auc": "'0.921'", "decision": "churn_decision",
        "probability": "printf('%.1f', y_proba * 100)", "risk_tier": "risk_tier",
        "reason_lines": "reason_lines", "second_decision": "second_decision",
        "second_probability": "printf('%.1f', rf_proba * 100)", "importances": "importance_text",
        "agreement": "agreement", "notice": "notice",
    }
    parts = [values[p] if named else "'" + p.replace("'", "''") + "'" for named, p in P.pieces(P.PROMPT)]
    block("x_prompts", f"SELECT customer_id, {' || '.join(parts)} AS prompt, churn_decision FROM x_panel JOIN x_bench_lines USING (customer_id), x_importance_text")
    return "SELECT customer_id, prompt FROM x_prompts"


def prompts_for(spark, folder):
    return prompts.build_prompts(
        panel_input(spark, folder), benchmarks(spark, folder), importances(spark, folder)
    )


@query("build_prompt", _prompt_sql())
def build_prompt(spark, folder):
    return prompts_for(spark, folder).select(KEY, "prompt")


@query("chat_messages", "SELECT customer_id, 0 AS position, 'system' AS role, '" + P.SYSTEM_MESSAGE
       + "' AS content FROM x_prompts UNION ALL SELECT customer_id, 1, 'user', prompt FROM x_prompts")
def chat_messages(spark, folder):
    df = prompts_for(spark, folder).withColumn("messages", P.system_and_user(F.col("prompt")))
    return df.select(KEY, F.posexplode_outer("messages").alias("position", "m")).select(
        KEY, "position", "m.role", "m.content"
    )


@query("chat_messages_blocks", "SELECT customer_id, 'user' AS role, 'text' AS type, prompt AS text FROM x_prompts")
def chat_messages_blocks(spark, folder):
    df = prompts_for(spark, folder).withColumn("messages", P.user_blocks(F.col("prompt")))
    one = df.select(KEY, F.explode_outer("messages").alias("m"))
    return one.select(KEY, "m.role", F.explode_outer("m.content").alias("c")).select(KEY, "role", "c.type", "c.text")
