"""Text-pattern statistics over replies.

The pattern table is configuration. Each pattern becomes one conditional count in a single
aggregate over the text column, so rows are never multiplied by the number of patterns; the one
result row per group is then laid out as rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.numbers import percent_text, round_exact
from tidewatch.functions.text import words
from tidewatch.operators.split import seeded_hash
from tidewatch.schema import KEY

# Fixed values: (theme, label, pattern, least number of matches), case ignored.
PATTERNS = [
    ("agreement", "both models", r"both (the )?(models|xgboost)", 1),
    ("agreement", "unanimously", r"unanimously", 1),
    ("agreement", "agree/agreement", r"\bagree(s|d|ment)?\b", 1),
    ("citation", "numeric SHAP value", r"[+-]\d+\.\d+", 1),
    ("citation", "probability percentage", r"\d+(\.\d+)?%", 1),
    ("citation", "benchmark/average", r"benchmark|average", 1),
    ("citation", "magnitude label", r"\b(dominant|strong|moderate)\b", 1),
    ("citation", "specific number", r"\d", 1),
    ("hedging", "however/although/despite/while", r"\b(however|although|despite|while)\b", 1),
    ("reasoning", "weighs competing signals", r"outweigh|offset|mitigat", 1),
    ("reasoning", "compares to averages", r"average", 1),
    ("reasoning", "model disagreement", r"disagree|differ(ing|ent) outcomes", 1),
    ("reasoning", "dominant driver", r"dominant", 1),
    ("reasoning", "multi-factor", r"shap", 2),
    ("reasoning", "risk tier", r"risk tier", 1),
    ("feature", "age", r"age", 1),
    ("feature", "customer service", r"customer service", 1),
    ("feature", "cart abandonment", r"cart abandonment", 1),
    ("feature", "lifetime value", r"lifetime value", 1),
    ("feature", "days since", r"days since", 1),
    ("feature", "discount", r"discount", 1),
    ("feature", "email open", r"email open", 1),
    ("feature", "returns", r"returns", 1),
    ("feature", "login", r"login", 1),
    ("feature", "session", r"session", 1),
    ("feature", "mobile app", r"mobile app", 1),
    ("feature", "purchase", r"purchase", 1),
    ("action_verb", "offer", r"offer", 1),
    ("action_verb", "address", r"address", 1),
    ("action_verb", "target", r"target", 1),
    ("action_verb", "engage", r"engage", 1),
    ("action_verb", "implement", r"implement", 1),
    ("action_verb", "personalize", r"personaliz", 1),
    ("action_verb", "maintain", r"maintain", 1),
    ("action_verb", "focus", r"focus", 1),
    ("action_verb", "immediately", r"immediately", 1),
    ("action_verb", "proactively", r"proactively", 1),
    ("action_verb", "reinforce", r"reinforc", 1),
    ("action_verb", "capitalize", r"capitaliz", 1),
    ("action_verb", "encourage", r"encourag", 1),
    ("action_verb", "understand", r"understand", 1),
    ("action_verb", "recommend", r"recommend", 1),
    ("action_verb", "reach out", r"reach out", 1),
    ("action_verb", "continue", r"continue", 1),
    ("action_verb", "investigate", r"investigat", 1),
    ("action_verb", "initiate", r"initiat", 1),
    ("trait", "conditional", r"\b(if|should|unless|in case)\b", 1),
    ("trait", "urgency", r"immediate|urgent|within \d+", 1),
    ("trait", "root cause", r"root cause|investigat|underlying", 1),
    ("trait", "monitoring", r"monitor|ongoing", 1),
    ("channel", "call", r"call", 1),
    ("channel", "email", r"email", 1),
    ("channel", "outreach", r"outreach", 1),
    ("channel", "social media", r"social media", 1),
    ("channel", "mobile app", r"mobile app", 1),
    ("intervention", "discount", r"discount", 1),
    ("intervention", "loyalty", r"loyalty", 1),
    ("intervention", "retention campaign", r"retention campaign", 1),
    ("intervention", "re-engagement", r"re-engag", 1),
    ("intervention", "exclusive", r"exclusive", 1),
    ("intervention", "reward", r"reward", 1),
    ("intervention", "dedicated", r"dedicated", 1),
    ("intervention", "win-back", r"win-back", 1),
    ("intervention", "personalized offer", r"personalized offer", 1),
    ("intervention", "support", r"support", 1),
    ("intervention", "incentive", r"incentive", 1),
    ("intervention", "product recommendation", r"product recommendation", 1),
    ("intervention", "curated", r"curated", 1),
    ("intervention", "survey", r"survey", 1),
    ("specificity", "numeric values", r"\d", 1),
    ("specificity", "days", r"days", 1),
    ("specificity", "calls", r"call", 1),
    ("specificity", "cart", r"cart", 1),
    ("specificity", "email", r"email", 1),
    ("specificity", "LTV", r"lifetime value|ltv", 1),
    ("specificity", "age", r"age", 1),
    ("differentiator", "superior model", r"superior model", 1),
    ("differentiator", "ROC-AUC", r"roc-auc", 1),
    ("differentiator", "risk tier", r"risk tier", 1),
    ("differentiator", "numeric SHAP value", r"[+-]\d+\.\d+", 1),
    ("differentiator", "SHAP values", r"shap values", 1),
    ("differentiator", "population benchmarks", r"population benchmarks", 1),
    ("differentiator", "both probabilities", r"\d%", 2),
    ("advice", "urgency", r"immediate|urgent|within \d+", 1),
    ("advice", "discount", r"discount", 1),
    ("advice", "loyalty", r"loyalty", 1),
    ("advice", "investigate", r"investigat", 1),
    ("advice", "monitor", r"monitor", 1),
    ("advice", "personalize", r"personaliz", 1),
    ("advice", "re-engage", r"re-engag", 1),
]
SENTENCE_END = r"[.!?]+(\s|$)"


def patterns(theme: str) -> list[tuple[str, str, str, int]]:
    return [p for p in PATTERNS if p[0] == theme]


def matches(text: Column, pattern: str, least: int = 1) -> Column:
    """Whether a lower-cased text holds the pattern at least ``least`` times."""
    if least == 1:
        return F.rlike(text, F.lit(pattern))
    return F.regexp_count(text, F.lit(pattern)) >= least


Pattern = tuple[str, str, str, int]


def pattern_list(table: DataFrame) -> list[Pattern]:
    """Patterns from a small table (theme, label, regex, and optionally least: matches needed, default 1)."""
    least = F.coalesce("least", F.lit(1)) if "least" in table.columns else F.lit(1)
    rows = table.select("theme", "label", "regex", least.alias("least")).orderBy("theme", "label").collect()
    return [(r.theme, r.label, r.regex, r.least) for r in rows]


def theme_rates(
    df: DataFrame, text: str, theme: str, keys: list[str], keep_zero: bool = True,
    dictionary: list[Pattern] | DataFrame | None = None,
) -> DataFrame:
    """(keys, theme, label, hits, n, pct): rows with a match, per pattern of a theme.

    ``dictionary`` replaces the built-in patterns: a list of (theme, label, regex, least) or a table of them.
    """
    known = pattern_list(dictionary) if isinstance(dictionary, DataFrame) else dictionary
    chosen = patterns(theme) if known is None else [p for p in known if p[0] == theme]
    lowered = df.select(*keys, F.lower(F.col(text)).alias("_t"))
    counts = lowered.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(matches(F.col("_t"), p, k)).alias(f"_{i}") for i, (_, _, p, k) in enumerate(chosen)],
    )
    rows = F.array(
        *[
            F.struct(F.lit(t).alias("theme"), F.lit(label).alias("label"), F.col(f"_{i}").alias("hits"))
            for i, (t, label, _, _) in enumerate(chosen)
        ]
    )
    out = counts.select(*keys, "n", F.inline(rows)).withColumn("pct", percent_text(F.col("hits"), F.col("n")))
    return out if keep_zero else out.filter(F.col("hits") > 0)


def top_labels(rates: DataFrame, key: str, top: int) -> DataFrame:
    """The labels with most hits per key; the table has one row per key and pattern."""
    order = Window.partitionBy(key).orderBy(F.desc("hits"), "label")
    return rates.withColumn("rank", F.row_number().over(order)).filter(
        (F.col("rank") <= top) & (F.col("hits") > 0)
    )


def distinct_matches(text: Column, theme: str) -> Column:
    """How many patterns of a theme a lower-cased text holds."""
    total = F.lit(0)
    for _, _, pattern, least in patterns(theme):
        total = total + matches(text, pattern, least).cast("int")
    return total


def multi_action_rate(df: DataFrame, text: str, key: str) -> DataFrame:
    """Rows with at least two different action verbs."""
    found = distinct_matches(F.lower(F.col(text)), "action_verb")
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.count_if(found >= 2).alias("hits")).withColumn(
        "pct", percent_text(F.col("hits"), F.col("n"))
    )


def length_stats(df: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """Mean characters, words and sentences."""
    t = F.col(text)
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        round_exact(F.avg(F.length(t)), 4).alias("avg_chars"),
        round_exact(F.avg(F.size(words(t))), 4).alias("avg_words"),
        round_exact(F.avg(F.regexp_count(t, F.lit(SENTENCE_END))), 4).alias("avg_sentences"),
    )


def opening_phrases(df: DataFrame, text: str, key: str, n_words: int) -> DataFrame:
    """(key, phrase, hits, pct): the first words, case kept."""
    phrase = F.concat(F.array_join(F.slice(words(F.col(text)), 1, n_words), " "), F.lit("..."))
    counts = df.groupBy(key, phrase.alias("phrase")).agg(F.count(F.lit(1)).alias("hits"))
    totals = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return counts.join(totals, key).withColumn("pct", percent_text(F.col("hits"), F.col("n"))).drop("n")


def top_openings(openings: DataFrame, key: str, top: int) -> DataFrame:
    order = Window.partitionBy(key).orderBy(F.desc("hits"), "phrase")
    return openings.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def seeded_sample(df: DataFrame, keys: list[str], size: int, seed: int = 42) -> DataFrame:
    """A fixed-size sample per key group, by seeded hash of the customer.

    The rank filter lets every task keep only its first ``size`` rows before the shuffle.
    """
    order = Window.partitionBy(*keys).orderBy("_h", KEY)
    hashed = df.withColumn("_h", seeded_hash(F.col(KEY), seed))
    return hashed.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= size).drop("_h")


def differentiators(df: DataFrame, text: str, models: list[str]) -> DataFrame:
    """Pattern counts of the models side by side, with the mean length as a last line."""
    rates = theme_rates(df, text, "differentiator", ["model"]).select(
        "label", "model", F.col("hits").cast("double").alias("value")
    )
    lengths = length_stats(df, text, ["model"]).select(
        F.lit("mean length").alias("label"), "model", F.col("avg_chars").alias("value")
    )
    both = rates.unionByName(lengths)
    return both.groupBy("label").pivot("model", models).agg(F.first("value"))
