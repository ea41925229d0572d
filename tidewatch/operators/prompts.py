"""Prompts per customer from scored rows, class benchmarks and global importances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import prompts as P
from tidewatch.functions.numbers import decimal_text, each_number, fixed_text, fmt_number
from tidewatch.schema import CATEGORICAL_NAMES, KEY, NUMERIC_NAMES
from tidewatch.settings import PanelParams
from tidewatch.sources.guards import aligned_join


def join_second_model(enriched: DataFrame, predictions: DataFrame, check: bool = True) -> DataFrame:
    """Attach the second model's prediction and probability by key."""
    renamed = predictions.withColumnsRenamed({"y_pred": "rf_pred", "y_proba": "rf_proba"})
    if check and "y_true" in predictions.columns:
        return aligned_join(enriched, renamed)
    return enriched.join(renamed.drop("y_true"), KEY)


def benchmark_array(benchmarks: DataFrame) -> DataFrame:
    """The benchmark table (one row per numeric feature) as one array, in feature order."""
    entry = F.struct(
        "position", "feature",
        F.lower(F.regexp_replace("feature", "_", " ")).alias("words"), F.lower("feature").alias("name"),
        decimal_text(F.col("churned_mean"), 3).alias("churned"),
        decimal_text(F.col("retained_mean"), 3).alias("retained"),
    )
    return benchmarks.agg(F.array_sort(F.collect_list(entry)).alias("b"))


def top_importances(importances: DataFrame, top: int = 5) -> DataFrame:
    return importances.filter(F.col("rank") <= top)


def importance_text(importances: DataFrame) -> DataFrame:
    """The first five importances as one text; null when the table is empty."""
    part = F.concat(P.short_feature_name(F.col("feature")), F.lit("="), fixed_text(F.col("importance"), 3))
    parts = F.transform(
        F.array_sort(F.collect_list(F.struct("rank", part.alias("part")))), lambda e: e["part"]
    )
    text = top_importances(importances).agg(parts.alias("parts"))
    return text.select(F.when(F.size("parts") > 0, F.array_join("parts", "  ")).alias("text"))


def _first_match(benchmarks: Column, reason: Column) -> Column:
    lowered = F.lower(reason)
    return F.get(
        F.filter(
            benchmarks, lambda b: F.contains(lowered, b["words"]) | F.contains(lowered, b["name"])
        ),
        0,
    )


def _benchmark_of(benchmarks: Column, feature: Column) -> Column:
    return F.get(F.filter(benchmarks, lambda b: b["feature"] == feature), 0)


def match_benchmarks(df: DataFrame, mode: str = "substring", out: str = "matched") -> DataFrame:
    """Benchmarks for the first three reasons, without repeats; the first three when none fits.

    ``df`` carries the benchmark array in ``_benchmarks``. ``mode="substring"`` takes the first
    feature whose name occurs in the reason; ``mode="by_feature"`` the feature the reason is about.
    """
    have = F.col("_benchmarks")
    if mode == "substring":
        hits = [_first_match(have, F.col(f"reason_{k}")) for k in (1, 2, 3)]
    else:
        hits = [_benchmark_of(have, F.get("reasons", k)["feature"]) for k in range(3)]
    found = F.array_distinct(F.array_compact(F.array(*hits)))
    return df.withColumn("_found", found).withColumn(
        out, F.when(F.size("_found") > 0, F.col("_found")).otherwise(F.slice(have, 1, 3))
    ).drop("_found")


def benchmark_lines(matched: Column, numbers: Column) -> Column:
    """``feature: customer=… | avg churner=… | avg retained=…`` per matched benchmark.

    Only the numbers of matched benchmarks are written out. A benchmark without a number has no line.
    """
    own = F.transform(F.transform(matched, lambda b: F.get(numbers, b["position"])), lambda x: fmt_number(x))
    line = lambda b, text: F.when(
        b["position"] < F.size(numbers),
        F.concat(
            F.lit("  "), b["feature"], F.lit(": customer="), text,
            F.lit(" | avg churner="), b["churned"], F.lit(" | avg retained="), b["retained"],
        ),
    )
    return F.array_join(F.zip_with(matched, own, line), "\n")


def with_benchmarks(df: DataFrame, benchmarks: DataFrame) -> DataFrame:
    """Carry the benchmark array on every row, as a scalar subquery: nothing is joined."""
    return df.withColumn("_benchmarks", benchmark_array(benchmarks).scalar())


def benchmark_texts(df: DataFrame, benchmarks: DataFrame, mode: str = "substring") -> DataFrame:
    """Add ``matched`` and ``benchmark_lines``."""
    numbers = F.array(*[F.col(c).cast("double") for c in NUMERIC_NAMES])
    matched = match_benchmarks(with_benchmarks(df, benchmarks), mode)
    return matched.withColumn("_numbers", numbers).withColumn(
        "benchmark_lines", benchmark_lines(F.col("matched"), F.col("_numbers"))
    ).drop("_numbers", "_benchmarks")


def build_prompts(
    df: DataFrame, benchmarks: DataFrame, importances: DataFrame,
    panel: PanelParams = PanelParams(), mode: str = "substring",
) -> DataFrame:
    """Add the ``prompt`` column to explained customers with both models' predictions.

    Empty side tables leave the benchmark section out and print ``N/A`` for the importances.
    """
    out = benchmark_texts(df, benchmarks, mode)
    # Every number is written out once, in the decimals it is shown with.
    in_whole = [c for c in P.PROMPT_NUMBERS if c in P.WHOLE_NUMBERS]
    in_cents = [c for c in P.PROMPT_NUMBERS if c not in P.WHOLE_NUMBERS]
    whole = each_number([F.col(c) for c in in_whole], lambda x: fmt_number(x, "double", 0))
    cents = each_number([F.col(c) for c in in_cents], lambda x: fmt_number(x, "double", 2))
    shares = each_number(
        [F.col("y_proba") * 100, F.col("rf_proba") * 100],
        lambda x: fmt_number(x, "double", 1),
    )
    first = F.upper(F.coalesce("churn_decision", F.lit("N/A")))
    second = P.decision_text(F.col("rf_pred"))
    out = out.withColumns(
        {
            "_whole": whole, "_cents": cents, "_shares": shares, "_first": first, "_second": second,
            "_importances": F.coalesce(importance_text(importances).scalar(), F.lit("N/A")),
        }
    )
    values = {c: F.get("_whole", i) for i, c in enumerate(in_whole)}
    values |= {c: F.get("_cents", i) for i, c in enumerate(in_cents)}
    values |= {c: F.coalesce(F.col(c), F.lit("nan")) for c in CATEGORICAL_NAMES}
    lines = F.col("benchmark_lines")
    values |= {
        "benchmark_section": F.when(lines == "", "").otherwise(
            F.concat(F.lit(P.BENCHMARK_HEADING), lines, F.lit("\n\n"))
        ),
        "boosted_auc": F.lit(f"{panel.boosted_auc:.3f}"),
        "forest_auc": F.lit(f"{panel.forest_auc:.3f}"),
        "decision": F.col("_first"),
        "probability": F.get("_shares", 0),
        "risk_tier": F.coalesce("risk_tier", F.lit("N/A")),
        "reason_lines": P.reason_lines([F.col(f"reason_{k}") for k in range(1, 6)]),
        "second_decision": F.col("_second"),
        "second_probability": F.when(F.col("rf_pred").isNull(), "N/A").otherwise(F.get("_shares", 1)),
        "importances": F.col("_importances"),
        "agreement": P.panel_agreement(F.col("_first"), F.col("_second")),
        "notice": P.consensus_notice(F.col("_first"), F.col("_second"), F.col("y_proba")),
    }
    helpers = ["_whole", "_cents", "_shares", "_first", "_second", "_importances"]
    return out.withColumn("prompt", P.fill(P.PROMPT, values)).drop(*helpers)
