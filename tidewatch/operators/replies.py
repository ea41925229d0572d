"""Reply tables: parsing, fallback, merging, resuming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import replies as R
from tidewatch.functions.text import strip
from tidewatch.schema import KEY
from tidewatch.sources.guards import aligned_join

PARTS = {"decision": "string", "explanation": "string", "recommendation": "string", "time_sec": "double"}


def parse_replies(df: DataFrame, raw: str = "raw_reply", compat: bool = False) -> DataFrame:
    """Add decision, explanation, recommendation, ``status`` and ``problem``.

    Status is ``ok``, ``salvaged`` (broken JSON whose decision could be read) or ``error``; valid
    JSON with a bad decision or an empty text is an error and is not salvaged. A null field counts
    as empty; with ``compat`` it reads as the text ``None``.

    Simple objects are read in the JVM. Only the others reach Python: the rest pass nulls.
    """
    strict = R.strict_reader("None" if compat else "")
    text, found = F.col("_text"), F.col("_json")
    steps = (
        df.withColumn("_text", R.strip_reply(F.col(raw)))
        .withColumn("_json", R.json_candidate(text))
        .withColumn("_simple", F.coalesce(F.rlike(found, F.lit(R.SIMPLE_OBJECT)), F.lit(False)))
        .withColumn("_strict", strict(F.when(~F.col("_simple"), found)))
        .withColumn(
            "_plain", F.when(F.col("_simple"), F.from_json(found, ", ".join(f"{f} string" for f in R.FIELDS)))
        )
    )
    valid = F.col("_simple") | F.coalesce(F.col("_strict.valid"), F.lit(False))
    field = {
        f: strip(F.coalesce(F.col(f"_plain.{f}"), F.col(f"_strict.{f}"), F.lit(""))) for f in R.FIELDS
    }
    steps = steps.withColumns(
        {
            "_valid": valid,
            "_decision": F.lower(field["decision"]),
            "_explanation": field["explanation"],
            "_recommendation": field["recommendation"],
            "_rescued": F.when(~valid, F.lower(F.regexp_extract(text, R.SALVAGE_DECISION, 1))),
        }
    )
    known = F.col("_decision").isin(R.DECISIONS)
    full = (F.col("_explanation") != "") & (F.col("_recommendation") != "")
    rescued = ~F.col("_valid") & (F.coalesce("_rescued", F.lit("")) != "")
    steps = steps.withColumn(
        "status",
        F.when(F.col("_valid") & known & full, "ok").when(rescued, "salvaged").otherwise("error"),
    ).withColumn(
        "problem",
        F.when(F.col("status") != "error", F.lit(None).cast("string"))
        .when(~F.col("_valid"), "no_json").when(known, "empty_text").otherwise("bad_decision"),
    )
    by_status = lambda ok, partial: (
        F.when(F.col("status") == "ok", ok).when(F.col("status") == "salvaged", partial)
    )
    return steps.select(
        *df.columns,
        by_status(F.col("_decision"), F.col("_rescued")).alias("decision"),
        by_status(F.col("_explanation"), R.salvaged(text, R.SALVAGE_EXPLANATION)).alias("explanation"),
        by_status(F.col("_recommendation"), R.salvaged(text, R.SALVAGE_RECOMMENDATION)).alias("recommendation"),
        "status", "problem",
    )


def apply_fallback(df: DataFrame, raw: str = "raw_reply", tree_decision: str = "churn_decision") -> DataFrame:
    """Fill failed replies: the tree model's decision, the marked start of the text, time 0."""
    failed = F.col("status") == "error"
    start = F.substring(strip(F.coalesce(raw, F.lit(""))), 1, R.ERROR_CHARS)
    return df.withColumns(
        {
            "decision": F.when(failed, F.lower(F.coalesce(tree_decision, F.lit("retain")))).otherwise(F.col("decision")),
            "explanation": F.when(failed, F.concat(F.lit(R.ERROR_MARK), start)).otherwise(F.col("explanation")),
            "recommendation": F.when(failed, R.FALLBACK_ADVICE).otherwise(F.col("recommendation")),
            "time_sec": F.when(failed, 0.0).otherwise(F.col("time_sec")),
        }
    )


def one_model(replies: DataFrame, model: str) -> DataFrame:
    """The replies of one model with its name in front of the reply columns."""
    return replies.filter(F.col("model") == model).select(
        KEY, "y_true", *[F.col(c).alias(f"{model}_{c}") for c in PARTS]
    )


def merge_model_replies(first: DataFrame, second: DataFrame, model: str) -> DataFrame:
    """Put a second model's reply columns beside the first table, null where it lacks one."""
    names = {f"{model}_{c}": t for c, t in PARTS.items()}
    missing = {n: t for n, t in names.items() if n not in second.columns}
    second = second.withColumns({n: F.lit(None).cast(t) for n, t in missing.items()})
    return aligned_join(first, second.select(KEY, "y_true", *names))


def wide_replies(replies: DataFrame, models: list[str]) -> DataFrame:
    """All models side by side from the long table, in one shuffle on the key.

    The job fails on a customer whose rows disagree about the label or who has two replies of one model.
    """
    repeated = F.exists(
        F.array(*[F.count_if(F.col("model") == m) for m in models]), lambda n: n > 1)
    conflict = F.min(F.struct("y_true")) != F.max(F.struct("y_true"))
    problem = F.when(repeated, F.lit("two replies of one model: ")).when(conflict, F.lit("labels differ: "))
    checked = F.when(problem.isNull(), F.lit(True)).otherwise(
        F.raise_error(F.concat(problem, F.col(KEY).cast("string"))).cast("boolean"))
    wide = replies.groupBy(KEY).agg(
        checked.alias("_ok"), F.max("y_true").alias("y_true"),
        *[
            F.max(F.when(F.col("model") == m, F.col(c))).alias(f"{m}_{c}") for m in models for c in PARTS
        ]
    )
    return wide.filter("_ok").drop("_ok")


def disagreements(wide: DataFrame, a: str, b: str) -> DataFrame:
    return wide.filter(F.col(f"{a}_decision") != F.col(f"{b}_decision"))


def not_yet_answered(wanted: DataFrame, answered: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key has no answer in the sink yet."""
    done = answered.filter(F.col("decision").isNotNull()).select(*keys)
    return wanted.join(done, keys, "left_anti")
