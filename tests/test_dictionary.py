"""Dictionaries in one automaton against one regular expression per pattern."""

import random
from collections import Counter

import pytest

from tidewatch.operators import dictionary as D
from tidewatch.operators import patterns as P


def test_what_is_a_literal():
    assert D.literals("cart abandonment") == ["cart abandonment"] and D.literals("outweigh|offset") == ["outweigh", "offset"]
    assert D.literals(r"a\.b\|c|d") == ["a.b|c", "d"] and D.literals("win-back") == ["win-back"]
    for regex in (r"\d%", "a.b", "x(y)", "a||b", "", r"\bif\b", "tail\\", r"\é"):
        assert D.literals(regex) is None


@pytest.fixture(scope="module")
def replies(spark):
    rng = random.Random(4)
    bits = ["both models agree", "Offer a discount", "12.5%", "+0.31", "SHAP", "shap values", "within 3 days", "customer service", "é", "ageage", "win-back",
            "If we investigate", "immediately", "roc-auc 0.9", ""]
    rows = [(rng.choice(["a", "b", None]), " ".join(rng.choices(bits, k=rng.randint(0, 9))) if rng.random() > 0.05 else None) for _ in range(400)]
    return spark.createDataFrame(rows, "model string, reply string"), rows


def as_rows(df):
    return sorted(map(tuple, df.select("model", "theme", "label", "hits", "n", "pct").collect()), key=repr)


def test_equals_one_expression_per_pattern_for_every_theme(replies):
    df = replies[0]
    whole = [("all", f"{theme}/{label}", regex, least) for theme, label, regex, least in P.PATTERNS]
    assert as_rows(D.dictionary_rates(df, "reply", "all", ["model"], dictionary=whole)) == as_rows(
        P.theme_rates(df, "reply", "all", ["model"], dictionary=whole))
    built_in = (f(df, "reply", "advice", ["model"], keep_zero=False) for f in (D.dictionary_rates, P.theme_rates))
    assert as_rows(next(built_in)) == as_rows(next(built_in))


def test_thousands_of_patterns_nested_and_overlapping(spark, replies):
    df, rows = replies
    rng = random.Random(8)
    text = " ".join((t or "").lower() for _, t in rows)
    known = sorted({text[i:i + rng.randint(1, 9)] for i in rng.sample(range(len(text) - 9), 9000)} | {"never seen", "ag", "geag"})[:5000]
    known = [k for k in known if D.literals(k) == [k]]
    table = spark.createDataFrame([("t", k, k, 1) for k in known] + [("t", "twice", "age", 2), ("other", "x", "x", 1)], "theme string, label string, regex string, least int")
    got = {(r.model, r.label): (r.hits, r.n) for r in D.dictionary_rates(df, "reply", "t", ["model"], dictionary=table).collect()}
    n, want = Counter(m for m, _ in rows), Counter()
    for m, t in rows:
        for k in known:
            want[m, k] += k in (t or "").lower()
        want[m, "twice"] += (t or "").lower().count("age") >= 2
    assert len(known) > 2000 and got == {key: (hits, n[key[0]]) for key, hits in want.items()}
    with pytest.raises(ValueError, match="more than 10 patterns"):
        D.dictionary_rates(df, "reply", "t", ["model"], dictionary=table, most=10)


def test_nothing_to_count(replies):
    df = replies[0]
    assert D.dictionary_rates(df, "reply", "none", ["model"], dictionary=[]).count() == 0
    assert D.dictionary_rates(df.limit(0), "reply", "advice", ["model"]).count() == 0
