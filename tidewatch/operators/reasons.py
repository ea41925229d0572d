"""From contributions per encoded feature to ranked reasons per customer.

Contributions are one array per customer, aligned with the list of encoded features. Rolling up,
ranking and phrasing are expressions on that array: no explode and no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.numbers import round_exact, round_scaled, value_text
from tidewatch.functions.reasons import (
    join_reasons,
    reason_column,
    reason_text,
    reason_with_magnitude,
)
from tidewatch.schema import DESCRIPTIONS, DIRECTIONS, FEATURES


def rollup_target(encoded: str, originals: list[str]) -> str | None:
    """The first original feature that equals the encoded name or is its ``name_`` prefix."""
    return next((o for o in originals if encoded == o or encoded.startswith(o + "_")), None)


def rollup_plan(encoded: list[str], originals: list[str]) -> dict[str, list[tuple[int, bool]]]:
    """Per feature the positions it sums and whether each is a one-hot part."""
    plan: dict[str, list[tuple[int, bool]]] = {}
    for i, name in enumerate(encoded):
        target = rollup_target(name, originals)
        plan.setdefault(target or name, []).append((i, target is not None and name != target))
    return plan


def _feature_total(parts: list[tuple[int, bool]], contributions: str, mode: str) -> Column:
    first, n = parts[0][0], len(parts)
    hot = parts[0][1]
    magnitude = (lambda x: F.abs(x)) if hot and mode == "abs" else (lambda x: x)
    together = [p for p, _ in parts] == list(range(first, first + n)) and all(h == hot for _, h in parts)
    if n == 1:
        return magnitude(F.get(contributions, first))
    if together:
        run = F.slice(contributions, first + 1, n)
        return F.aggregate(run, F.lit(0.0), lambda a, x: a + magnitude(x))
    total = F.lit(0.0)
    for i, is_hot in parts:
        part = F.get(contributions, i)
        total = total + (F.abs(part) if is_hot and mode == "abs" else part)
    return total


def rollup_contributions(
    df: DataFrame, encoded: list[str], originals: list[str] = FEATURES,
    mode: str = "abs", contributions: str = "contributions", out: str = "rolled",
) -> tuple[DataFrame, list[str]]:
    """Add an array of contributions per feature, and return the feature order.

    A numeric feature keeps its sign. One-hot parts add their absolute values (``mode="abs"``) or
    keep their signs (``mode="signed"``). Encoded names that match no feature stay, at the end.
    """
    plan = rollup_plan(encoded, originals)
    names = [o for o in originals if o in plan] + [n for n in plan if n not in originals]
    totals = [_feature_total(plan[n], contributions, mode) for n in names]
    return df.withColumn(out, F.array(*totals)), names


def first_entries(entries: list[Column], top: int) -> Column:
    """The ``top`` least of some structs that are never null, as an array.

    ``sort_array`` compares whole structs in compiled code, where ``array_sort`` calls a lambda for every pair.
    """
    return F.slice(F.sort_array(F.array(*entries)), 1, top)


def top_reasons(
    df: DataFrame, names: list[str], top: int = 5, rolled: str = "rolled", out: str = "reasons",
) -> DataFrame:
    """The ``top`` features by absolute contribution, ties in column order, with their texts.

    ``names`` gives the order of the array; only original features can be named as reasons.
    """
    types = dict(df.dtypes)
    entries = []
    for i, name in enumerate(names):
        if name not in types:
            continue
        is_number = types[name] in ("double", "float")
        v = F.get(rolled, i)
        entries.append(
            F.struct(
                (-F.abs(v)).alias("key"), F.lit(i).alias("position"), v.alias("v"),
                (F.col(name) if is_number else F.lit(None)).cast("double").alias("number"),
                (F.lit(None) if is_number else F.col(name)).cast("string").alias("text"),
                F.lit(DESCRIPTIONS.get(name, name)).alias("description"),
                F.lit(DIRECTIONS.get(name, 0)).alias("direction"),
            )
        )
    ranked = df.withColumn("_top", first_entries(entries, top))
    feature_names = F.array(*[F.lit(n) for n in names])
    # The ranked entries are used twice, so they are ranked in compiled code before the lambdas run on them.
    # A category has no number: without a text either it is missing, as a number is.
    phrased = F.zip_with(
        "_top", F.transform("_top", lambda r: F.coalesce(r["text"], value_text(r["number"], "double"))),
        lambda r, v: F.struct(
            F.get(feature_names, r["position"]).alias("feature"), r["v"].alias("v"), v.alias("feature_value"),
            reason_text(r["v"], r["direction"], r["description"], v).alias("reason"),
        ),
    )
    finished = F.transform(
        phrased,
        lambda r: F.struct(
            r["feature"].alias("feature"),
            round_exact(r["v"], 4).alias("shap_value"),
            r["feature_value"].alias("feature_value"),
            r["reason"].alias("reason"),
            reason_with_magnitude(r["reason"], r["v"]).alias("reason_with_magnitude"),
        ),
    )
    return ranked.withColumn(out, finished).drop("_top")


def reason_columns(df: DataFrame, reasons: str = "reasons", top: int = 5) -> DataFrame:
    """Add the joined reasons and one column per rank."""
    return df.withColumns(
        {f"top_{top}_reasons": join_reasons(F.col(reasons))}
        | {f"reason_{k}": reason_column(F.col(reasons), k) for k in range(1, top + 1)}
    )


def base_feature(encoded: str) -> str:
    """The described feature an encoded name belongs to; its own name when there is none."""
    head = encoded.split("_")[0]
    if head in DESCRIPTIONS:
        return head
    if encoded in DESCRIPTIONS:
        return encoded
    return next((k for k in DESCRIPTIONS if encoded.startswith(k)), encoded)


def top_encoded_reasons(
    df: DataFrame, encoded: list[str], values: str = "encoded_values",
    contributions: str = "contributions", top: int = 3, out: str = "encoded_reasons",
) -> DataFrame:
    """The variant over encoded features: no roll-up, values printed as given."""
    entries = [
        F.struct(
            (-F.abs(F.get(contributions, i))).alias("key"), F.lit(i).alias("position"),
            F.lit(name).alias("feature"), F.get(contributions, i).alias("v"),
            F.get(values, i).alias("value"),
            F.lit(DESCRIPTIONS.get(base_feature(name), name)).alias("description"),
            F.lit(DIRECTIONS.get(base_feature(name), 0)).alias("direction"),
        )
        for i, name in enumerate(encoded)
    ]
    ranked = df.withColumn("_top", first_entries(entries, top))
    finished = F.transform(
        "_top",
        lambda r: F.struct(
            r["feature"].alias("feature"), round_exact(r["v"], 4).alias("shap_value"),
            r["value"].alias("feature_value"),
            reason_text(r["v"], r["direction"], r["description"], r["value"]).alias("reason"),
        ),
    )
    return ranked.withColumn(out, finished).drop("_top")


def describe_features(df: DataFrame, dimension: DataFrame) -> DataFrame:
    """Look up readable name and direction; unknown features keep their name and get 0.

    The dimension has one row per feature (23), fixed by the schema.
    """
    lookup = dimension.select("feature", F.col("description").alias("_d"), F.col("direction").alias("_s"))
    return df.join(F.broadcast(lookup), "feature", "left").select(
        *df.columns,
        F.coalesce("_d", "feature").alias("description"),
        F.coalesce("_s", F.lit(0)).alias("direction"),
    )


def wide_attributions(df: DataFrame, encoded: list[str], contributions: str = "contributions") -> DataFrame:
    """One ``shap_<encoded feature>`` column each, four decimals."""
    return df.withColumns(
        {f"shap_{name}": round_scaled(F.get(contributions, i), 4) for i, name in enumerate(encoded)}
    )
