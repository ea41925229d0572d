"""Quality and toxicity on held-out rows, the pipeline, and the queries' shapes."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.compare import connect, differences
from tests.llm import cases
from tests.llm.test_texts import plain_dedup, words
from tidewatch.llm import quality, queries, toxicity
from tidewatch.llm.rows import held_out

FOLDER = "/root/testdata/sf0.01"



def auc(good, bad):
    bad = np.sort(bad)
    return (np.searchsorted(bad, good, "left") + np.searchsorted(bad, good, "right")).sum() / 2 / len(good) / len(bad)


def test_quality_on_held_out_rows(spark):
    scored = queries.op2_quality(spark, FOLDER).join(spark.read.parquet(f"{FOLDER}/labels.parquet"), "doc_id").filter("held_out")
    rows = scored.collect()
    assert auc(np.array([r.score for r in rows if r.quality]), np.array([r.score for r in rows if not r.quality])) > 0.97
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.95


def test_quality_ignores_negative_and_held_out_labels(spark):
    """Only the prior may depend on which rows are labelled 0; held-out labels change nothing."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(300)
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    flipped = labels.withColumn("quality", F.when(held_out("doc_id", 5, 0), 1 - F.col("quality")).otherwise(F.col("quality")))
    rows = quality.stored_features(docs)
    a, b = (quality.learn(rows, table, quality.learning_rows()) for table in (labels, flipped))
    assert a.prior == b.prior and np.allclose(a.weights, b.weights)


def test_risk_is_the_sum_over_parts():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((50, quality.WIDTH))
    x[:, 0] = 1
    positive = rng.random(50) < 0.4
    model = quality.Model(np.zeros(quality.WIDTH), np.ones(quality.WIDTH), rng.standard_normal(quality.WIDTH) / 5, 0.6)
    whole = quality.sums(x, positive, model)
    assert np.allclose(whole, quality.sums(x[:20], positive[:20], model) + quality.sums(x[20:], positive[20:], model))
    risk, gradient, _, clipped = quality.risk_of(whole, model)
    g = x @ model.weights
    p, u = np.log1p(np.exp(-g[positive])).mean(), np.log1p(np.exp(g)).mean() - 0.6 * np.log1p(np.exp(g[positive])).mean()
    assert risk == pytest.approx(0.6 * p + max(0, u), abs=1e-2) and clipped == (u <= 0)
    for k in (0, 3):
        near = quality.Model(model.mean, model.scale, model.weights + 1e-6 * np.eye(quality.WIDTH)[k], 0.6)
        slope = (quality.risk_of(quality.sums(x, positive, near), near)[0] - risk) / 1e-6
        assert slope == pytest.approx(gradient[k], abs=1e-4)


@pytest.mark.parametrize("labels", [[], [(3, 1, 0), (3, 0, 1), (None, 1, 1), (5, None, None)], [(5, 1, 1), (7, 0, 0), (9, 1, 0)]])
def test_awkward_models(spark, labels):
    docs, none = cases.awkward(spark), cases.none(spark)
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    for df in (docs, none):
        model = quality.learn(quality.stored_features(df), table, F.lit(True))
        scores = [r.score for r in df.withColumn("score", quality.score(model)).collect()]
        assert len(scores) == df.count() and all(0 <= s <= 1 for s in scores)
        toxic = toxicity.learn(df, table, F.lit(True))
        scores = [r.score for r in df.withColumn("score", toxicity.score(toxic)).collect()]
        assert len(scores) == df.count() and all(0 <= s <= 1 for s in scores)


def test_grammar_weighs_clauses():
    g = toxicity.Grammar({"fool": 4.0}, {"lowei": 3.0})
    total = lambda text: sum(g.clauses(text))
    assert total("a fool here") == 4.0 and total("a FOOL. a fool") == 8.0
    assert total("you are a fool") == 6.0 and total("you are here. a fool") == 4.0
    assert total("he is not a fool") == 2.0 and total("not here. a fool") == 4.0
    assert total("they said he is a fool") == pytest.approx(2.8)
    assert total("loweischaft") == 3.0 and total("lowe foolish") == 0.0
    assert total("kill it") == 0.0 and total("i will kill you") == toxicity.THREAT_WEIGHT
    assert total("you kill time") == total("i will not kill you") == toxicity.THREAT_WEIGHT / 2 == 2 * total("never kill you")
    assert total("they will go. kill you") == total("you kill, kill") / 2 == toxicity.THREAT_WEIGHT / 2
    assert g.evidence(None) == (0.0, 0.0) and list(g.clauses("")) == []


def chained(symbols, weights):
    """The parts one after the other, each over the whole text, then clause by clause."""
    states, put = {}, [*symbols, toxicity.STOP]
    for name, part in toxicity.CASCADE.items():
        put, states[name] = part.run(put)
    insult = threats = 0.0
    for at, symbol in enumerate(put):
        if symbol == toxicity.STOP:
            ends = toxicity.closing({n: s[at - 1] if at else 0 for n, s in states.items()})
            if insult * ends[0] + threats * ends[1]:
                yield insult * ends[0] + threats * ends[1]
            insult = threats = 0.0
            continue
        factors = toxicity.FACTORS.get(toxicity.SYMBOLS[symbol], (0.0, 0.0))
        insult, threats = insult + weights[at] * factors[0], threats + weights[at] * factors[1]


def by_rule(symbols, weights):
    """The rules of the docstring read word by word, without any table."""
    ends = [i for i, s in enumerate([*symbols, toxicity.STOP]) if s == toxicity.STOP]
    for begin, end in zip([0, *[e + 1 for e in ends]], ends):
        clause = symbols[begin:end]
        aimed, told = toxicity.TARGET in clause, toxicity.REPORT in clause
        total = 0.0
        for i, s in enumerate(clause):
            near = toxicity.NEGATION in clause[max(0, i - toxicity.REACH) : i]
            value = weights[begin + i] * (toxicity.NEGATED if near else 1.0)
            if s == toxicity.INSULT:
                total += value * (toxicity.AIMED if aimed else 1.0)
            elif s == toxicity.THREAT and aimed:
                total += value * (1.0 if toxicity.INTENT in clause[:i] else toxicity.BARE)
        if total:
            yield total * (toxicity.REPORTED if told else 1.0)


def test_composed_transducers_equal_chained_ones_and_the_rules():
    rng = random.Random(4)
    for _ in range(3000):
        n = rng.randint(0, 25)
        symbols = [rng.choice(range(toxicity.READ)) if rng.random() < 0.8 else toxicity.NOTHING for _ in range(n)]
        weights = [float(rng.randint(1, 9)) if s >= toxicity.THREAT else 0.0 for s in symbols]
        got = list(toxicity.GRAMMAR.clauses(symbols, weights))
        assert got == pytest.approx(list(chained(symbols, weights)))
        assert got == pytest.approx(list(by_rule(symbols, weights)))


def test_composition_reaches_every_state_it_needs():
    sizes = [len(t.step) for t in toxicity.CASCADE.values()]
    reached = toxicity.GRAMMAR.step
    assert 1 < len(reached) <= np.prod(sizes)
    assert all(0 <= cell[0] < len(reached) for row in reached for cell in row)
    assert all(row[toxicity.STOP][0] == 0 for row in reached)


def test_learned_insults_are_those_that_explain(spark):
    """Words that only share toxic texts with an insult do not become insults."""
    rng = random.Random(1)
    common = "lorem ipsum dolor sit amet magna".split()
    rows, labels = [], []
    for i in range(600):
        text = [rng.choice(common) for _ in range(20)]
        toxic = int(i % 6 == 0)
        if toxic:
            text.insert(rng.randint(0, 19), "grobian")
        if i < 60 and toxic:
            text += ["innocent", "bystander"]
        rows.append((i, " ".join(text)))
        labels.append((i, toxic))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.learn(docs, spark.createDataFrame(labels, "doc_id long, toxic int"), F.lit(True))
    assert set(model.grammar.insults) == {"grobian"}
    low, high = model.scores(["innocent bystander", "you grobian"])
    assert low < 0.3 and high > 0.7


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, before, FOLDER)
        from tidewatch.session import materialise

        after = materialise(after, "stage")
        if name != "encoding":
            assert after.columns == docs.columns
            assert 0 < after.count() and after.join(before, "doc_id", "left_anti").count() == 0
        if name == "passage dedup":
            plain = plain_dedup(sorted((r.doc_id, r.text) for r in before.collect()))
            want = {i: t for i, (t, gone) in plain.items() if gone < len((t or "").split("\n")) + gone and not (t == "" and gone)}
            assert {r.doc_id: r.text for r in after.collect()} == want
        if name == "mixing":
            total = sum(len(words(r.text)) for r in before.collect())
            assert sum(len(words(r.text)) for r in after.collect()) == pytest.approx(1.5 * total, rel=0.05)
        before = after
    assert {"doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"} == set(before.columns)


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_same_rows_as_sql(spark, name):
    assert differences(queries.QUERIES[name](spark, FOLDER), connect(FOLDER), queries.ORACLES[name]) == []


def test_every_operator_has_a_query():
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{i}" for i in range(1, 11)]
