"""Plain-English reasons for a contribution."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewatch.functions.labels import strength_label
from tidewatch.functions.numbers import signed_text


def reason_text(contribution: Column, direction: Column, description: Column, value: Column) -> Column:
    """One of six phrases: sign of the contribution by churn direction of the feature."""
    rises = contribution > 0
    effect = F.when(rises, " increases churn risk").otherwise(" reduces churn risk")
    high = (rises & (direction == 1)) | (~rises & (direction == -1))
    named = F.concat(F.when(high, "High ").otherwise("Low "), description, F.lit(" ("), value, F.lit(")"))
    plain = F.concat(description, F.lit(" = "), value)
    return F.concat(F.when(direction == 0, plain).otherwise(named), effect)


def reason_with_magnitude(reason: Column, contribution: Column) -> Column:
    return F.concat(
        reason, F.lit(" [SHAP="), signed_text(contribution, 2), F.lit(", "),
        strength_label(contribution), F.lit("]"),
    )


def join_reasons(reasons: Column) -> Column:
    return F.array_join(F.transform(reasons, lambda r: r["reason_with_magnitude"]), " | ")


def reason_column(reasons: Column, k: int) -> Column:
    """The k-th reason, an empty text when there are fewer."""
    return F.coalesce(F.get(reasons, k - 1)["reason_with_magnitude"], F.lit(""))
