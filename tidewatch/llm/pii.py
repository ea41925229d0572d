"""Personal data: fixed patterns, and terms that reveal what the patterns found.

Patterns find e-mail addresses, IP addresses, card and phone numbers: leftmost matches of each kind without
overlap, of which those that fail a check (parts at most 255, digits and Luhn, number of digits) are dropped.

Information-theoretic step: what the patterns found are protected entities, known by their normalised value.
Corpus counts say how strongly a term reveals an entity: with p the share of documents,

    PMI(t, e) = log p(t, e) / (p(t) p(e)),   IC(e) = -log p(e),   disclosure = PMI / IC  (at most 1)

where (t, e) counts documents that have the term anywhere beside the entity. A term that meets an entity in at
least ``LEAST_CONTEXTS`` differently worded documents (copies count once) and whose disclosure reaches
``GENERALISE`` is generalised wherever it stands in documents with the entity, from ``REMOVE`` on it is removed.
Common words occur everywhere, so their PMI is near zero.

One pass over the texts gives spans, the terms of documents with an entity and, per task, document counts of all
words (flushed when large, so memory is bounded); the counts are added up by shuffles with map-side combining.
Disclosure reaches ``GENERALISE`` = 1/2 only where n_t <= sqrt(n n_e), so terms more common than that are left
out before and right after terms meet entities; nothing that could be marked is lost by it.

Nulls: a null text counts as empty. Rows are known by doc_id and text; rows equal in both get the same
result and count once per row. An empty table gives an empty result. Texts are read whole.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.llm.rows import small_batches, text_key, text_of
from tidewatch.session import materialise

# Fixed patterns of the base kinds, in the order in which kinds are listed.
KINDS = ("email", "ip", "card", "phone", "term")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
#: Numbers joined by dots, as long as possible; an address is four of them, the next four may be another.
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
NUMBER = re.compile(r"[0-9]+")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NOT_DIGITS = re.compile(r"[^0-9]")

#: Differently worded documents in which a term has to meet an entity.
LEAST_CONTEXTS = 3
GENERALISE = 0.5
REMOVE = 0.8
#: Distinct words a task counts before it hands its counts on.
FLUSH = 200_000
TERM = re.compile(r"\w+(?:[.'-]\w+)*")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    doubled = [int(d) * 2 for d in digits[-2::-2]]
    return (sum(map(int, digits[-1::-2])) + sum(d - 9 if d > 9 else d for d in doubled)) % 10 == 0


def emails(text: str) -> Iterator[re.Match]:
    """All matches of EMAIL. Candidates are looked for around each @, so other long runs cost nothing."""
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and (text[start - 1] in "._%+-" or (text[start - 1].isascii() and text[start - 1].isalnum())):
            start -= 1
        match = EMAIL.match(text, start) if start < at else None
        if match:
            yield match
            done = match.end()
        else:
            done = max(done, at)
        at = text.find("@", max(done, at + 1))


def base_spans(text: str) -> list[Span]:
    """Spans of the base kinds in code points, by start, then kind as listed."""
    out: list[Span] = [("email", m.start(), m.end()) for m in emails(text)]
    for m in DOTTED.finditer(text) if "." in text else ():
        parts = list(NUMBER.finditer(text, m.start(), m.end()))
        for four in zip(*[iter(parts)] * 4):
            if all(len(part.group().lstrip("0")) <= 3 and int(part.group()) <= 255 for part in four):
                out.append(("ip", four[0].start(), four[3].end()))
    for m in CARD.finditer(text):
        digits = NOT_DIGITS.sub("", m.group())
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= len(NOT_DIGITS.sub("", m.group())) <= 15:
                out.append(("phone", m.start(), m.end()))
    return in_order(out)


def in_order(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def shown(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def entity(kind: str, value: str) -> str:
    """The normalised value: how an entity is written does not matter."""
    return f"{kind}:{NOT_DIGITS.sub('', value) if kind in ('card', 'phone') else value.lower()}"


def key_of(value: str) -> int:
    """A 64-bit key of a term or entity."""
    return int.from_bytes(hashlib.blake2b(value.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def merged(spans: list[Span]) -> tuple[list[int], list[int]]:
    """Starts and ends of the stretches that spans in order cover."""
    starts: list[int] = []
    ends: list[int] = []
    for _, a, b in spans:
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


def terms_beside(text: str, spans: list[Span]) -> tuple[list[int], int, list[tuple[int, int, int]]]:
    """Entities, the wording without them, and (term, start, end) of each term; terms are not parts of entities."""
    starts, ends = merged(spans)

    def free(m: re.Match) -> bool:
        at = bisect_left(starts, m.end()) - 1
        return (at < 0 or ends[at] <= m.start()) and not m.group().isdigit()

    terms = [m for m in TERM.finditer(text) if free(m)]
    keys = {w: key_of(w) for w in {m.group().lower() for m in terms}}
    around = key_of(" ".join(m.group().lower() for m in terms))
    return (sorted({key_of(entity(k, text[a:b])) for k, a, b in spans}), around,
            [(keys[m.group().lower()], m.start(), m.end()) for m in terms])


TERMS = pa.list_(pa.struct([("t", pa.int64()), ("a", pa.int32()), ("b", pa.int32())]))


def scan(docs: DataFrame) -> DataFrame:
    """One pass over the texts (doc_id, text), stored: a row per document, and partial word counts (w, n)."""
    small_batches(docs.sparkSession)
    texts = docs.select("doc_id", text_key().alias("tw_key"), row_key().alias("r"), text_of().alias("text"))
    schema = (
        f"doc_id {dict(docs.dtypes)['doc_id']}, tw_key long, r long, base string, "
        "es array<long>, c long, found array<struct<t: long, a: int, b: int>>, w long, n long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        kinds: list[pa.DataType] = []
        names = ["doc_id", "tw_key", "r", "base", "es", "c", "found", "w", "n"]

        def flushed() -> pa.RecordBatch:
            size = len(counts)
            out = pa.RecordBatch.from_arrays(
                [*(pa.nulls(size, k) for k in kinds), pa.array([key_of(w) for w in counts], pa.int64()),
                 pa.array(list(counts.values()), pa.int64())], names=names)
            counts.clear()
            return out

        for batch in batches:
            kinds = [batch.schema.field("doc_id").type, pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.int64(), TERMS]
            base, entities, around, found = [], [], [], []
            for text in batch.column("text").to_pylist():
                spans = base_spans(text)
                base.append(shown(spans))
                es, c, terms = terms_beside(text, spans) if spans else ([], None, [])
                entities.append(es)
                around.append(c)
                found.append([dict(zip("tab", row)) for row in terms])
                counts.update(set(TERM.findall(text.lower())))
            empty = pa.nulls(len(base), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(base, pa.string()), pa.array(entities, pa.list_(pa.int64())),
                 pa.array(around, pa.int64()), pa.array(found, TERMS), empty, empty],
                names=names)
            if len(counts) > FLUSH:
                yield flushed()
        if counts:
            yield flushed()

    return materialise(texts.mapInArrow(run, schema), "pii_scan")


def row_key() -> Column:
    """A 64-bit key of a row by doc_id and text."""
    return F.xxhash64(F.lit(1), F.col("doc_id").isNull(), F.col("doc_id"), text_of())


def revealing(scanned: DataFrame) -> DataFrame:
    """(r, t, disclosure): the terms of each row whose disclosure of an entity of the row reaches ``GENERALISE``."""
    docs = scanned.filter("w IS NULL")
    n = float(max(docs.count(), 1))
    held = docs.select("r", "c", F.explode("es").alias("e")).distinct()
    entities = (
        held.groupBy("e", "c").agg(F.count(F.lit(1)).alias("n")).groupBy("e")
        .agg(F.sum("n").alias("n_e"), F.count(F.lit(1)).alias("contexts")).filter(F.col("contexts") >= LEAST_CONTEXTS).drop("contexts"))
    entities = materialise(entities, "pii_entities")
    hottest = entities.agg(F.max("n_e")).first()[0] or 0
    # A hair above the bound, so that rounding leaves out nothing.
    words = (
        scanned.filter("w IS NOT NULL").groupBy(F.col("w").alias("t")).agg(F.sum("n").alias("n_t"))
        .filter(F.col("n_t").between(LEAST_CONTEXTS, math.sqrt(n * hottest) * 1.000001)))
    kept = materialise(held.join(entities, "e"), "pii_held")
    terms = (
        docs.select("r", F.explode(F.array_distinct(F.transform("found", lambda x: x["t"]))).alias("t"))
        .join(kept.select("r").distinct(), "r", "left_semi").distinct().join(words, "t"))
    near = materialise(
        kept.join(terms, "r").filter(F.col("n_t") <= F.sqrt(F.lit(n) * F.col("n_e")) * 1.000001)
        .select("r", "e", "t", "c", "n_e", "n_t"), "pii_near")
    pmi = F.log(F.col("n_te") * n / (F.col("n_t") * F.col("n_e")))
    ic = F.log(F.lit(n) / F.col("n_e"))
    pairs = (
        near.groupBy("e", "t", "c", "n_e", "n_t").agg(F.count(F.lit(1)).alias("n"))
        .groupBy("e", "t", "n_e", "n_t").agg(F.sum("n").alias("n_te"), F.count(F.lit(1)).alias("contexts"))
        .filter(F.col("contexts") >= LEAST_CONTEXTS)
        .select("e", "t", F.when(ic > 0, F.least(F.lit(1.0), pmi / ic)).otherwise(F.lit(0.0)).alias("disclosure"))
        .filter(F.col("disclosure") >= GENERALISE))
    return near.select("r", "e", "t").join(pairs, ["e", "t"]).groupBy("r", "t").agg(F.max("disclosure").alias("disclosure"))


@F.pandas_udf(T.StringType())
def _all_spans(base: pd.Series, terms: pd.Series) -> pd.Series:
    def one(text: str, more) -> str:
        if more is None or not len(more):
            return text
        known = [(k, int(a), int(b)) for k, a, b in (x.split(":") for x in text.split(",") if x)]
        return shown(in_order(known + sorted({("term", int(m["a"]), int(m["b"])) for m in more})))

    return pd.Series([one(b, t) for b, t in zip(base, terms)])


def found_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, tw_key, base, spans, terms) for each row of ``docs``: base spans, all spans, and the terms
    among them with their disclosure (array<struct<a, b, disclosure>>, null if none)."""
    scanned = scan(docs)
    rows = scanned.filter("w IS NULL")
    places = rows.select("r", F.explode("found").alias("f")).select("r", "f.*").distinct()
    terms = (
        places.join(revealing(scanned), ["r", "t"]).groupBy("r")
        .agg(F.sort_array(F.collect_list(F.struct("a", "b", "disclosure"))).alias("terms")))
    return (
        rows.select("doc_id", "tw_key", "r", "base").join(terms, "r", "left").drop("r")
        .withColumn("spans", _all_spans("base", "terms")))


def kind_count(kind: str, spans: str = "base") -> Column:
    return F.size(F.filter(F.split(spans, ","), lambda x: x.startswith(f"{kind}:"))).cast("long")


@F.pandas_udf(T.StringType())
def _sanitised(text: pd.Series, base: pd.Series, terms: pd.Series) -> pd.Series:
    def one(text: str, base: str, more) -> str:
        spans = [(int(a), int(b), f"[{k.upper()}]") for k, a, b in (x.split(":") for x in base.split(",") if x)]
        spans += [(int(m["a"]), int(m["b"]), "" if m["disclosure"] >= REMOVE else "[TERM]") for m in (more if more is not None else [])]
        out, at = [], 0
        for a, b, label in sorted(spans):
            if a >= at:
                out += [text[at:a], label]
            at = max(at, b)
        return "".join(out) + text[at:]

    return pd.Series([one(t, b, m) for t, b, m in zip(text, base, terms)])


def sanitised(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data in ``text`` replaced by its kind and revealing terms generalised or removed."""
    found = found_spans(docs.select("doc_id", "text")).dropDuplicates(["doc_id", "tw_key"])
    return (
        docs.withColumn("__tw_key", text_key()).alias("d")
        .join(found.alias("f"), F.expr("d.doc_id <=> f.doc_id AND d.__tw_key = f.tw_key"))
        .select(*[_sanitised(text_of("d.text"), F.col("f.base"), F.col("f.terms")).alias(c) if c == "text" else F.col(f"d.`{c}`")
                  for c in docs.columns]))
