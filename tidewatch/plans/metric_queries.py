"""Metrics over scored customers and over label pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.operators import metrics
from tidewatch.plans.columns_queries import scored
from tidewatch.plans.registry import block, query
from tidewatch.schema import KEY
from tidewatch.sources.tables import read_table


def predictions(spark, folder):
    """(model, split, key, y_true, y_pred, y_proba) for both models of the scorecard."""
    df = scored(spark, folder)
    both = F.array(
        F.struct(F.lit("boosted").alias("model"), F.col("y_pred"), F.col("y_proba")),
        F.struct(
            F.lit("forest").alias("model"), F.col("rf_pred").alias("y_pred"), F.col("rf_proba").alias("y_proba")
        ),
    )
    return df.select("split", KEY, "y_true", F.inline(both))


block("x_predictions", """
SELECT 'boosted' AS model, split, customer_id, y_true, y_pred, y_proba FROM x_scored JOIN x_split USING (customer_id)
UNION ALL SELECT 'forest', split, customer_id, y_true, rf_pred, rf_proba FROM x_scored JOIN x_split USING (customer_id)
""")
block("x_counts", """
SELECT model, split, count(*) FILTER (WHERE y_true = 0 AND y_pred = 0) AS tn,
       count(*) FILTER (WHERE y_true = 0 AND y_pred = 1) AS fp,
       count(*) FILTER (WHERE y_true = 1 AND y_pred = 0) AS fn,
       count(*) FILTER (WHERE y_true = 1 AND y_pred = 1) AS tp
FROM x_predictions GROUP BY ALL
""")
block("x_basic", """
SELECT model, split, tn, fp, fn, tp, (tp + tn)::DOUBLE / (tp + tn + fp + fn) AS accuracy,
       CASE WHEN tp + fp = 0 THEN 0 ELSE tp::DOUBLE / (tp + fp) END AS precision,
       CASE WHEN tp + fn = 0 THEN 0 ELSE tp::DOUBLE / (tp + fn) END AS recall,
       CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE (2 * tp)::DOUBLE / (2 * tp + fp + fn) END AS f1
FROM x_counts
""")
block("x_auc", """
SELECT model, split, sum(pos * (below + neg / 2.0::DOUBLE)) / (sum(pos) * sum(neg)) AS roc_auc
FROM (SELECT *, coalesce(sum(neg) OVER (PARTITION BY model, split ORDER BY y_proba
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below
      FROM (SELECT model, split, y_proba, sum(y_true)::DOUBLE AS pos, sum(1 - y_true)::DOUBLE AS neg
            FROM x_predictions GROUP BY ALL))
GROUP BY ALL
""")


@query("binary_metrics", """
SELECT model, split, round_even(accuracy, 9) AS accuracy, round_even(precision, 9) AS precision,
       round_even(recall, 9) AS recall, round_even(f1, 9) AS f1 FROM x_basic
""")
def binary_metrics(spark, folder):
    out = metrics.binary_metrics(predictions(spark, folder), ["model", "split"])
    return out.select(
        "model", "split", *[F.bround(c, 9).alias(c) for c in ("accuracy", "precision", "recall", "f1")]
    )


@query("label_pair_metrics", """
SELECT round_even((tp + tn)::DOUBLE / (tp + tn + fp + fn), 9) AS accuracy,
       round_even(CASE WHEN tp + fp = 0 THEN 0 ELSE tp::DOUBLE / (tp + fp) END, 9) AS precision,
       round_even(CASE WHEN tp + fn = 0 THEN 0 ELSE tp::DOUBLE / (tp + fn) END, 9) AS recall,
       round_even(CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE (2 * tp)::DOUBLE / (2 * tp + fp + fn) END, 9) AS f1
FROM (SELECT count(*) FILTER (WHERE quality = 0 AND toxic = 1) AS tn, count(*) FILTER (WHERE quality = 0 AND toxic = 0) AS fp,
             count(*) FILTER (WHERE quality = 1 AND toxic = 1) AS fn, count(*) FILTER (WHERE quality = 1 AND toxic = 0) AS tp
      FROM labels)
""")
def label_pair_metrics(spark, folder):
    pairs = read_table(spark, folder, "labels").select(
        F.col("quality").alias("y_true"), (1 - F.col("toxic")).alias("y_pred")
    )
    out = metrics.binary_metrics(pairs, [])
    return out.select(*[F.bround(c, 9).alias(c) for c in out.columns])


@query("confusion_matrix", "SELECT * FROM x_counts")
def confusion_matrix(spark, folder):
    return metrics.confusion_counts(predictions(spark, folder), ["model", "split"])


@query("roc_auc", "SELECT model, split, round_even(roc_auc, 9) AS roc_auc FROM x_auc")
def roc_auc(spark, folder):
    out = metrics.roc_auc(predictions(spark, folder), ["model", "split"])
    return out.select("model", "split", F.bround("roc_auc", 9).alias("roc_auc"))


@query("hard_label_auc", """
SELECT model, split, round_even((tp::DOUBLE / (tp + fn) + tn::DOUBLE / (tn + fp)) / 2, 9) AS hard_auc FROM x_counts
""")
def hard_label_auc(spark, folder):
    counts = metrics.confusion_counts(predictions(spark, folder), ["model", "split"])
    return metrics.from_counts(counts).select("model", "split", F.bround("hard_auc", 9).alias("hard_auc"))


block("x_report", """
SELECT model, split, tn, fp, fn, tp, tn + fp AS s0, fn + tp AS s1,
       CASE WHEN tn + fn = 0 THEN 0 ELSE tn::DOUBLE / (tn + fn) END AS p0, tn::DOUBLE / (tn + fp) AS r0,
       precision AS p1, recall AS r1
FROM x_basic
""")
block("x_report_f", """
SELECT *, CASE WHEN p0 + r0 = 0 THEN 0 ELSE 2 * p0 * r0 / (p0 + r0) END AS f0,
       CASE WHEN p1 + r1 = 0 THEN 0 ELSE 2 * p1 * r1 / (p1 + r1) END AS f1, s0 + s1 AS s FROM x_report
""")


@query("classification_report", """
SELECT model, split, label, CAST(printf('%.4f', precision) AS DOUBLE) AS precision, CAST(printf('%.4f', recall) AS DOUBLE) AS recall,
       CAST(printf('%.4f', f1) AS DOUBLE) AS f1, support
FROM (
  SELECT model, split, 'Retained' AS label, p0 AS precision, r0 AS recall, f0 AS f1, s0 AS support FROM x_report_f
  UNION ALL SELECT model, split, 'Churned', p1, r1, f1, s1 FROM x_report_f
  UNION ALL SELECT model, split, 'accuracy', NULL, NULL, (tp + tn)::DOUBLE / s, s FROM x_report_f
  UNION ALL SELECT model, split, 'macro avg', (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, s FROM x_report_f
  UNION ALL SELECT model, split, 'weighted avg', (p0 * s0 + p1 * s1) / s, (r0 * s0 + r1 * s1) / s, (f0 * s0 + f1 * s1) / s, s FROM x_report_f)
""")
def classification_report(spark, folder):
    return metrics.classification_report(predictions(spark, folder), ["model", "split"])


@query("results_table", """
SELECT model, split, round_even(accuracy, 9) AS accuracy, round_even(precision, 9) AS precision,
       round_even(recall, 9) AS recall, round_even(f1, 9) AS f1, round_even(roc_auc, 9) AS roc_auc
FROM x_basic JOIN x_auc USING (model, split)
""")
def results_table(spark, folder):
    out = metrics.results_table(metrics.results_long(predictions(spark, folder)))
    return out.select(
        "model", "split",
        *[F.bround(c, 9).alias(c) for c in ("accuracy", "precision", "recall", "f1", "roc_auc")],
    )
