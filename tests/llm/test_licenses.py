"""License scan against plain Python and SQL."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tests.compare import connect, differences
from tests.llm import cases
from tidewatch.llm import licenses, queries

FOLDER = "/root/testdata/sf0.01"
FILL = "lorem ipsum dolor sit amet consectetur the software license general public mit apache".split()


def words(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower)


def plain(text, templates=licenses.TEMPLATES, least=licenses.LEAST_SCORE):
    """All spans (start, end, label, exact, score), by comparing every place of the text with every place of a template."""
    w, out = words(text), []
    for t in templates:
        v, k = words(t.text), 2 if t.exact else 4
        hits = [(i - j, i, j) for i in range(len(w) - k + 1) for j in range(len(v) - k + 1) if w[i : i + k] == v[j : j + k]]
        groups = []
        for d in sorted({h[0] for h in hits}):
            if t.exact or not groups or d - groups[-1][-1] > min(licenses.DRIFT, len(v) // 2):
                groups.append([])
            groups[-1].append(d)
        for group in groups:
            mine = [h for h in hits if h[0] in group]
            low, high = min(h[1] for h in mine), max(h[1] for h in mine) + k
            score = len({j + x for _, _, j in mine for x in range(k)}) / max(len(v), high - low)
            if score >= (1 if t.exact else least):
                out.append((low, high, t.label, t.exact, score))
    return sorted(out)


def scanned(spark, texts, **how):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: (r.n_words, [tuple(s) for s in r.spans]) for r in licenses.scan(df, **how).collect()}


def test_against_sql(spark):
    got = queries.op13_licenses(spark, FOLDER)
    assert differences(got, connect(FOLDER), queries.ORACLES["op13_licenses"]) == []


def test_against_plain_python(spark):
    """Notices with words left out, put in and changed, among words of the names themselves."""
    rng = random.Random(2)
    texts = []
    for _ in range(300):
        parts = []
        for _ in range(rng.randint(1, 4)):
            parts.append(" ".join(rng.choices(FILL, k=rng.randint(0, 12))))
            notice = words(rng.choice(licenses.TEMPLATES).text)
            for _ in range(rng.randint(0, 3)):
                at = rng.randrange(len(notice) + 1)
                notice[at : at + rng.randint(0, 2)] = rng.choices(FILL, k=rng.randint(0, 3))
            parts.append(rng.choice([" ", "\n", " * "]).join(notice).upper())
        texts.append(" ".join(parts))
    got = scanned(spark, texts)
    assert got == {i: (len(words(t)), plain(t)) for i, t in enumerate(texts)}
    assert sum(any(not s[3] for s in spans) for _, spans in got.values()) > 100


@pytest.mark.parametrize("text, labels", [
    ("MIT License", ["mit"]), ("the MIT-license; mit  LICENSE", ["mit", "mit"]), ("mit licensed", []), ("limit license", []),
    ("GNU General\nPublic License", ["gpl"]), ("general public licence", []), ("general public general public license", ["gpl"]),
    ("é mit license", ["mit"]), ("émit license", []), ("Licensed under CC BY-NC 4.0.", ["cc-by-nc"]), ("licensed under cc by 4.0", ["cc-by"])])
def test_names_and_notices(spark, text, labels):
    assert [s[2] for s in scanned(spark, [text])[0][1]] == labels


def test_awkward_rows(spark):
    df = cases.awkward(spark)
    got = licenses.scan(df)
    assert got.columns == ["doc_id", "n_words", "spans"]
    want = sorted((str(r.doc_id), len(words(r.text))) for r in df.collect())
    assert sorted((str(r.doc_id), r.n_words) for r in got.collect()) == want
    assert licenses.scan(cases.none(spark)).collect() == [] and {len(s) for _, s in scanned(spark, ["mit license"], templates=[]).values()} == {0}


def test_a_very_long_text_and_a_shared_passage(spark):
    """Every place counts, and no Python worker takes part."""
    texts = ["mit license " * 20000, cases.LONG + " apache license"] + ["released under the mit license"] * 500
    got = scanned(spark, texts)
    assert (got[0][0], len(got[0][1])) == (40000, 20000) and got[1][1][0][:2] == (30000, 30002)
    assert all(len(got[i][1]) == 1 for i in range(2, 502))
    plan = licenses.scan(spark.createDataFrame([(1, "x")], "doc_id long, text string").select(F.col("doc_id"), "text"))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text and "Arrow" not in text and "MapIn" not in text
