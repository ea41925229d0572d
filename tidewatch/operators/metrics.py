"""Binary classification metrics as aggregates over keyed prediction tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.numbers import ratio, round_exact
from tidewatch.functions.text import strip


def confusion_counts(df: DataFrame, keys: list[str], truth="y_true", pred="y_pred") -> DataFrame:
    """tn, fp, fn, tp per key group in one pass."""
    t, p = F.col(truth), F.col(pred)
    return df.groupBy(*keys).agg(
        F.count_if((t == 0) & (p == 0)).alias("tn"),
        F.count_if((t == 0) & (p == 1)).alias("fp"),
        F.count_if((t == 1) & (p == 0)).alias("fn"),
        F.count_if((t == 1) & (p == 1)).alias("tp"),
    )


def _f1(precision: Column, recall: Column) -> Column:
    return ratio(2.0 * precision * recall, precision + recall)


def from_counts(counts: DataFrame) -> DataFrame:
    """Accuracy, precision, recall, F1 and hard-label AUC from the four counts.

    An undefined ratio is 0; the AUC of a single class is null.
    """
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    precision, recall = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return counts.withColumns(
        {
            "accuracy": ratio(tp + tn, tp + tn + fp + fn),
            "precision": precision,
            "recall": recall,
            "f1": ratio(2 * tp, 2 * tp + fp + fn),
            "hard_auc": (F.try_divide(tp, tp + fn) + F.try_divide(tn, tn + fp)) / 2.0,
        }
    )


def binary_metrics(df: DataFrame, keys: list[str]) -> DataFrame:
    return from_counts(confusion_counts(df, keys)).drop("tn", "fp", "fn", "tp", "hard_auc")


def roc_auc(
    df: DataFrame, keys: list[str], score="y_proba", truth="y_true", buckets: int = 128
) -> DataFrame:
    """Exact area under the ROC curve per key group; ties count half.

    Rows are reduced to one per distinct score. Running counts over the scores come from bucket
    totals plus a window inside each score bucket, so no group is ordered in one task. Bucket
    bounds are sketch quantiles of the distinct scores; any bounds give the exact result.
    """
    keys = keys or ["_all"]
    if keys == ["_all"]:
        df = df.withColumn("_all", F.lit(0))
    by_score = df.groupBy(*keys, F.col(score).alias("_s")).agg(
        F.sum(truth).alias("_pos"), F.sum(1 - F.col(truth)).alias("_neg")
    )
    shares = F.array(*[F.lit(i / buckets) for i in range(1, buckets)])
    bounds = by_score.groupBy(*keys).agg(F.percentile_approx("_s", shares, 1000).alias("_bounds"))
    # One row per key group (a model and split), and below at most ``buckets`` rows per group.
    binned = by_score.join(bounds, keys).withColumn(
        "_bucket", F.size(F.filter("_bounds", lambda b: b < F.col("_s")))
    )
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        binned.groupBy(*keys, "_bucket")
        .agg(F.sum("_neg").alias("_n"))
        .withColumn("_below", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .drop("_n")
    )
    inside = Window.partitionBy(*keys, "_bucket").orderBy("_s").rowsBetween(
        Window.unboundedPreceding, -1
    )
    placed = binned.withColumn("_lower", F.coalesce(F.sum("_neg").over(inside), F.lit(0))).join(
        offsets, [*keys, "_bucket"]
    )
    wins = F.col("_pos").cast("double") * (F.col("_below") + F.col("_lower") + F.col("_neg") / 2.0)
    out = placed.groupBy(*keys).agg(
        F.try_divide(F.sum(wins), F.sum("_pos").cast("double") * F.sum("_neg")).alias("roc_auc")
    )
    return out.drop("_all")


def classification_report(
    df: DataFrame, keys: list[str], names: tuple[str, str] = ("Retained", "Churned"), digits: int = 4
) -> DataFrame:
    """Per class precision, recall, F1 and support; then accuracy, macro and weighted mean."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    per_class = confusion_counts(df, keys).select(
        *keys,
        (tn + fp).alias("s0"), (fn + tp).alias("s1"), (tn + fp + fn + tp).alias("s"),
        ratio(tn, tn + fn).alias("p0"), ratio(tn, tn + fp).alias("r0"),
        ratio(tp, tp + fp).alias("p1"), ratio(tp, tp + fn).alias("r1"),
        ratio(tp + tn, tn + fp + fn + tp).alias("accuracy"),
    )
    c = {n: F.col(n) for n in ("s0", "s1", "s", "p0", "r0", "f0", "p1", "r1", "f1", "accuracy")}
    scored = per_class.withColumns({"f0": _f1(c["p0"], c["r0"]), "f1": _f1(c["p1"], c["r1"])})
    means = {f"macro_{m}": (c[f"{m}0"] + c[f"{m}1"]) / 2.0 for m in "prf"}
    means |= {f"weighted_{m}": ratio(c[f"{m}0"] * c["s0"] + c[f"{m}1"] * c["s1"], c["s"]) for m in "prf"}

    def line(label, precision, recall, score, support):
        cells = {"precision": precision, "recall": recall, "f1": score}
        return F.struct(
            F.lit(label).alias("label"),
            *[(F.col(v) if v else F.lit(None).cast("double")).alias(n) for n, v in cells.items()],
            c[support].alias("support"),
        )

    lines = F.array(
        line(names[0], "p0", "r0", "f0", "s0"),
        line(names[1], "p1", "r1", "f1", "s1"),
        line("accuracy", None, None, "accuracy", "s"),
        line("macro avg", "macro_p", "macro_r", "macro_f", "s"),
        line("weighted avg", "weighted_p", "weighted_r", "weighted_f", "s"),
    )
    return scored.withColumns(means).select(*keys, F.inline(lines)).select(
        *keys, "label",
        *[round_exact(F.col(n), digits).alias(n) for n in ("precision", "recall", "f1")], "support",
    )


def results_long(df: DataFrame) -> DataFrame:
    """(model, split, metric, value) for accuracy, precision, recall, F1 and ROC-AUC."""
    keys = ["model", "split"]
    wide = binary_metrics(df, keys).join(roc_auc(df, keys), keys)
    names = ["accuracy", "precision", "recall", "f1", "roc_auc"]
    return wide.unpivot(keys, names, "metric", "value")


def results_table(long: DataFrame) -> DataFrame:
    """One row per model and split, one column per metric."""
    return (
        long.groupBy("model", "split")
        .pivot("metric", ["accuracy", "precision", "recall", "f1", "roc_auc"])
        .agg(F.first("value"))
    )


def reply_label(decision: Column) -> Column:
    """1 where the decision reads ``churn`` after trimming and lower-casing."""
    return (F.lower(strip(decision)) == "churn").cast("int")


def valid_reply(decision: Column) -> Column:
    return decision.isNotNull() & ~decision.startswith("[parse_error]")


def _rounded(value: Column, digits: int) -> Column:
    """``round_exact`` of a value that is bound once: the rule names it dozens of times, too often for generated code."""
    return F.transform(F.array(value), lambda x: round_exact(x, digits))[0]


def reply_metrics(replies: DataFrame) -> DataFrame:
    """Metrics per reply model over valid replies; mean seconds over all rows.

    A model without a valid reply gets no row. ``parse_failure_rate`` shows the share of rows
    that carry a fallback: those count as evaluated because their decision is filled in.
    """
    failed = F.coalesce(F.col("explanation").startswith("[parse_error]"), F.lit(False)).cast("int")
    seconds = replies.groupBy("model").agg(F.avg("time_sec").alias("time"), F.avg(failed).alias("failed")).select(
        "model", _rounded(F.col("time"), 2).alias("avg_time_sec"), _rounded(F.col("failed"), 4).alias("parse_failure_rate"))
    pairs = replies.filter(valid_reply(F.col("decision"))).select(
        "model", F.col("y_true").cast("int").alias("y_true"), reply_label(F.col("decision")).alias("y_pred")
    )
    counts = confusion_counts(pairs, ["model"])
    names = {"accuracy": "accuracy", "precision": "precision", "recall": "recall", "f1": "f1", "hard_auc": "roc_auc"}
    metrics = from_counts(counts).select(
        "model",
        (F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")).alias("n_evaluated"),
        *[_rounded(F.col(c), 4).alias(out) for c, out in names.items()],
    )
    return metrics.join(seconds, "model")
