"""Sampling and text-pattern statistics over replies and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.operators import patterns as T
from tidewatch.operators import replies
from tidewatch.operators.dictionary import dictionary_rates
from tidewatch.plans.registry import block, query
from tidewatch.plans.reply_queries import MODELS, answered
from tidewatch.schema import KEY
from tidewatch.sources.tables import read_table

block("x_talk", "SELECT conv_id, turn, text FROM conversations WHERE role = 'assistant'")


def talk(spark, folder):
    df = read_table(spark, folder, "conversations")
    return df.filter(F.col("role") == "assistant").select("conv_id", "turn", "text")


def _hit(text: str, pattern: str, least: int) -> str:
    if least == 1:
        return f"regexp_matches(lower({text}), '{pattern}')"
    return f"len(regexp_extract_all(lower({text}), '{pattern}')) >= {least}"


def _rates_sql(text: str, theme: str, keys: str = "model", source: str = "x_answered") -> str:
    return " UNION ALL ".join(
        f"SELECT {keys}, count(*) AS n, '{theme}' AS theme, '{label}' AS label, "
        f"count(*) FILTER (WHERE {_hit(text, p, k)}) AS hits, "
        f"CAST(round_even(100.0::DOUBLE * count(*) FILTER (WHERE {_hit(text, p, k)}) / count(*), 0) AS INTEGER) AS pct "
        f"FROM {source} GROUP BY {keys}"
        for _, label, p, k in T.patterns(theme)
    )


def _lengths_sql(text: str, keys: str, source: str) -> str:
    return f"""
SELECT {keys}, count(*) AS n, CAST(printf('%.4f', avg(length({text}))) AS DOUBLE) AS avg_chars,
       CAST(printf('%.4f', avg(len(list_filter(string_split_regex(trim({text}), '\\s+'), lambda w: w <> '')))) AS DOUBLE) AS avg_words,
       CAST(printf('%.4f', avg(len(regexp_extract_all({text}, '[.!?]+(\\s|$)')))) AS DOUBLE) AS avg_sentences
FROM {source} GROUP BY {keys}"""


def _openings_sql(text: str, key: str, source: str, n: int) -> str:
    return f"""
SELECT {key}, phrase, count(*) AS hits,
       CAST(round_even(100.0::DOUBLE * count(*) / sum(count(*)) OVER (PARTITION BY {key}), 0) AS INTEGER) AS pct
FROM (SELECT {key}, array_to_string(list_filter(string_split_regex(trim({text}), '\\s+'), lambda w: w <> '')[1:{n}], ' ') || '...' AS phrase FROM {source})
GROUP BY {key}, phrase"""


@query("text_length_stats", _lengths_sql("explanation", "model", "x_answered"))
def text_length_stats(spark, folder):
    return T.length_stats(answered(spark, folder), "explanation", ["model"])


@query("text_length_advice", _lengths_sql("recommendation", "model", "x_answered"))
def text_length_advice(spark, folder):
    return T.length_stats(answered(spark, folder), "recommendation", ["model"])


@query("conversation_lengths", _lengths_sql("text", "turn", "x_talk"))
def conversation_lengths(spark, folder):
    return T.length_stats(talk(spark, folder), "text", ["turn"])


@query("opening_phrases", _openings_sql("explanation", "model", "x_answered", 6))
def opening_phrases(spark, folder):
    return T.opening_phrases(answered(spark, folder), "explanation", "model", 6)


@query("opening_phrases_advice", _openings_sql("recommendation", "model", "x_answered", 5))
def opening_phrases_advice(spark, folder):
    return T.opening_phrases(answered(spark, folder), "recommendation", "model", 5)


@query("conversation_openings", _openings_sql("text", "turn", "x_talk", 2))
def conversation_openings(spark, folder):
    return T.opening_phrases(talk(spark, folder), "text", "turn", 2)


def _top_sql(inner: str, key: str, by: str, top: int) -> str:
    return (f"SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY {key} ORDER BY hits DESC, {by}) AS INTEGER) AS rank "
            f"FROM ({inner})) WHERE rank <= {top} AND hits > 0")


@query("top_opening_phrases", _top_sql(_openings_sql("explanation", "model", "x_answered", 6), "model", "phrase", 5))
def top_opening_phrases(spark, folder):
    return T.top_openings(opening_phrases(spark, folder), "model", 5)


@query("top_opening_phrases_advice", _top_sql(_openings_sql("recommendation", "model", "x_answered", 5), "model", "phrase", 8))
def top_opening_phrases_advice(spark, folder):
    return T.top_openings(opening_phrases_advice(spark, folder), "model", 8)


def _register_rates(name: str, column: str, theme: str, keep_zero: bool = True) -> None:
    sql = _rates_sql(column, theme)
    if not keep_zero:
        sql = f"SELECT * FROM ({sql}) WHERE hits > 0"

    @query(name, sql)
    def build(spark, folder):
        return T.theme_rates(answered(spark, folder), column, theme, ["model"], keep_zero)


_register_rates("phrase_rates", "explanation", "agreement")
_register_rates("citation_rates", "explanation", "citation")
_register_rates("hedging_rate", "explanation", "hedging")
_register_rates("reasoning_rates", "explanation", "reasoning")
_register_rates("feature_citations", "explanation", "feature", keep_zero=False)
_register_rates("advice_traits", "recommendation", "trait")
_register_rates("channels", "recommendation", "channel", keep_zero=False)
_register_rates("specificity", "recommendation", "specificity")


@query("action_verbs", _top_sql(_rates_sql("recommendation", "action_verb"), "model", "label", 12))
def action_verbs(spark, folder):
    rates = T.theme_rates(answered(spark, folder), "recommendation", "action_verb", ["model"])
    return T.top_labels(rates, "model", 12)


_VERBS = " + ".join(f"CAST({_hit('recommendation', p, k)} AS INTEGER)" for _, _, p, k in T.patterns("action_verb"))


@query("multi_action", f"""
SELECT model, count(*) AS n, count(*) FILTER (WHERE {_VERBS} >= 2) AS hits,
       CAST(round_even(100.0::DOUBLE * count(*) FILTER (WHERE {_VERBS} >= 2) / count(*), 0) AS INTEGER) AS pct
FROM x_answered GROUP BY model
""")
def multi_action(spark, folder):
    return T.multi_action_rate(answered(spark, folder), "recommendation", "model")


@query("interventions", _top_sql(_rates_sql("recommendation", "intervention"), "model", "label", 10))
def interventions(spark, folder):
    rates = T.theme_rates(answered(spark, folder), "recommendation", "intervention", ["model"])
    return T.top_labels(rates, "model", 10)


@query("advice_by_decision", f"""
SELECT r.*, avg_len FROM ({_rates_sql('recommendation', 'advice', 'model, decision')}) r
JOIN (SELECT model, decision, CAST(printf('%.4f', avg(length(recommendation))) AS DOUBLE) AS avg_len FROM x_answered GROUP BY ALL) l
  ON l.model = r.model AND l.decision = r.decision
""")
def advice_by_decision(spark, folder):
    df = answered(spark, folder)
    keys = ["model", "decision"]
    lengths = T.length_stats(df, "recommendation", keys).select(*keys, F.col("avg_chars").alias("avg_len"))
    return T.theme_rates(df, "recommendation", "advice", keys).join(lengths, keys)


@query("differentiators", "SELECT label, " + ", ".join(
    f"max(CASE WHEN model = '{m}' THEN value END) AS {m}" for m in MODELS)
    + f" FROM (SELECT label, model, CAST(hits AS DOUBLE) AS value FROM ({_rates_sql('explanation', 'differentiator')})"
    + " UNION ALL SELECT 'mean length', model, CAST(printf('%.4f', avg(length(explanation))) AS DOUBLE) FROM x_answered GROUP BY model) GROUP BY label")
def differentiators(spark, folder):
    return T.differentiators(answered(spark, folder), "explanation", MODELS)


def _sample_sql(keys: str, size: int, columns: str, source: str = "x_answered") -> str:
    return (f"SELECT {columns} FROM (SELECT *, CAST(row_number() OVER (PARTITION BY {keys} "
            f"ORDER BY md5(CAST(customer_id AS VARCHAR) || '-42'), customer_id) AS INTEGER) AS rank FROM {source}) WHERE rank <= {size}")


@query("seeded_sample", _sample_sql("model", 200, "customer_id, model, explanation, rank"))
def seeded_sample(spark, folder):
    df = answered(spark, folder).filter(F.col("explanation").isNotNull())
    return T.seeded_sample(df, ["model"], 200).select(KEY, "model", "explanation", "rank")


@query("representative_samples", _sample_sql(
    "model, decision", 5, "customer_id, model, y_true, decision, y_proba, risk_tier, explanation, recommendation, rank"))
def representative_samples(spark, folder):
    return T.seeded_sample(answered(spark, folder), ["model", "decision"], 5).select(
        KEY, "model", "y_true", "decision", "y_proba", "risk_tier", "explanation", "recommendation", "rank"
    )


block("x_disagree", "SELECT *, 'disagreement' AS part FROM x_wide WHERE qwen_decision <> gemma_decision")


@query("deep_read_sample", "SELECT part, customer_id, CAST(rank AS INTEGER) AS rank FROM ("
       + _sample_sql("model, decision", 5, "model || ' ' || decision AS part, customer_id, rank")
       + " UNION ALL " + _sample_sql("part", 5, "part, customer_id, rank", "x_disagree") + ")")
def deep_read_sample(spark, folder):
    df = answered(spark, folder)
    full = T.seeded_sample(df, ["model", "decision"], 5).select(
        F.concat_ws(" ", "model", "decision").alias("part"), KEY, "rank"
    )
    split = replies.disagreements(replies.wide_replies(df, MODELS), *MODELS)
    split = T.seeded_sample(split.withColumn("part", F.lit("disagreement")), ["part"], 5)
    return full.unionByName(split.select("part", KEY, "rank"))


@query("theme_dictionary", """
SELECT lang, 'benchmark' AS theme, word AS label, count(*) FILTER (WHERE contains(lower(text), word)) AS hits, count(*) AS n,
       CAST(round_even(100.0::DOUBLE * count(*) FILTER (WHERE contains(lower(text), word)) / count(*), 0) AS INTEGER) AS pct
FROM documents, (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{6,}')) AS word FROM benchmark) GROUP BY lang, word""")
def theme_dictionary(spark, folder):
    """How many documents of each language hold each longer word of the benchmark items: a dictionary taken from a table."""
    word = F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{6,}"), F.lit(0)))
    words = read_table(spark, folder, "benchmark").select(word.alias("regex")).distinct()
    known = words.select(F.lit("benchmark").alias("theme"), F.col("regex").alias("label"), "regex")
    return dictionary_rates(read_table(spark, folder, "documents").select("lang", "text"), "text", "benchmark", ["lang"], dictionary=known)
