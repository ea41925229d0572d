"""Quality of documents by learning from positives and unlabelled texts.

Trusted positives are texts labelled 1 in the learning rows; the unlabelled set is every document of the
corpus, labels ignored. With a class prior p the risk of a score function g under logistic loss l is

    p E_pos[l(g)] + max(0, E_all[l(-g)] - p E_pos[l(-g)])

whose second part estimates the risk on negatives and must not go below zero. The prior is estimated as the
share of positives among labelled learning rows. g is linear in a fixed number of features of the whole
text. The risk is minimised by damped Newton steps; every step is one pass over the stored features of all
documents and all positives, added up in Spark, so nothing is sampled and the driver holds one matrix of
fixed size.

Nulls: a null text is scored as the empty text. A null doc_id has no label and is not held out. Repeated
rows count as often as they occur. Without positives or documents the score is the prior (0.5 where nothing
is labelled). A column of the input that is called ``score`` is replaced.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.rows import agreed_labels, fold, small_batches, sum_vectors, text_of
from tidewatch.session import materialise

STEPS = 12
RIDGE = 1e-4

def _classes() -> bytes:
    """Bytes by class: A capital, 0 digit, . other ASCII sign, blank for white space, a for all else."""
    out = bytearray(b"a" * 256)
    for code in range(128):
        sign = chr(code)
        out[code] = ord("A" if sign.isupper() else "0" if sign.isdigit() else " " if sign.isspace() else "a" if sign.isalpha() else ".")
    return bytes(out)


_CLASSES = _classes()
#: Shares of words, bytes or lines, and sizes; each share also enters as its square root.
SHARES = (
    "signs", "words that end in signs", "lone signs", "capitals in a row", "digits", "same word as before",
    "repeated pairs", "repeated words", "top word", "repeated lines")
SIZES = ("words", "word length", "line length")
WIDTH = 1 + 2 * len(SHARES) + 2 * len(SIZES)


def features(text: str | None) -> list[float]:
    """Features of one whole text. Cost and memory are proportional to its length."""
    text = text or ""
    words = text.split()
    n = len(words)
    some = max(n, 1)
    lines = text.split("\n")
    counts = Counter(words)
    shape = b" " + text.encode("utf-8", "surrogatepass").translate(_CLASSES).replace(b" ", b"  ") + b" "
    size = max(len(shape), 1)
    shares = (
        shape.count(b".") / size,
        shape.count(b".. ") / some,
        shape.count(b" . ") / some,
        shape.count(b"AA") / size,
        shape.count(b"0") / size,
        sum(map(eq, words, words[1:])) / some,
        1 - len(set(zip(words, words[1:]))) / (n - 1) if n > 1 else 0.0,
        1 - len(counts) / some if n else 0.0,
        max(counts.values(), default=0) / some,
        1 - len(set(lines)) / len(lines),
    )
    sizes = (np.log1p(n), np.log1p(len(text) / some), np.log1p(n / len(lines)))
    return [1.0, *shares, *(s**0.5 for s in shares), *sizes, *(s * s / 8 for s in sizes)]


@dataclass(frozen=True)
class Model:
    """Weights of standardised features."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    prior: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.clip(((x - self.mean) / self.scale) @ self.weights, -30, 30)

    def scores(self, x: np.ndarray) -> np.ndarray:
        x = x.reshape(-1, WIDTH).astype("float64")
        return np.round(1 / (1 + np.exp(-self.logits(x))), 6)


def sums(x: np.ndarray, positive: np.ndarray, model: Model) -> np.ndarray:
    """Losses, gradients and curvatures of one part of the rows, as one vector: for all rows, then positives."""
    z = (x - model.mean) / model.scale
    g = np.clip(z @ model.weights, -30, 30)
    s = 1 / (1 + np.exp(-g))
    out = []
    for rows in (np.ones(len(x), dtype=bool), positive):
        zr, gr, sr = z[rows], g[rows], s[rows]
        out += [
            [rows.sum(), np.logaddexp(0, -gr).sum(), np.logaddexp(0, gr).sum()],
            zr.sum(axis=0), sr @ zr, ((zr * (sr * (1 - sr))[:, None]).T @ zr).ravel()]
    return np.concatenate(out)


def risk_of(total: np.ndarray, model: Model) -> tuple[float, np.ndarray, np.ndarray, bool]:
    """The non-negative risk, its gradient and curvature, and whether its second part is cut off at zero."""
    d = len(model.weights)
    size = 3 + 2 * d + d * d
    parts = []
    for v in (total[:size], total[size:]):
        n = max(v[0], 1.0)
        parts.append((v[1] / n, v[2] / n, v[3 : 3 + d] / n, v[3 + d : 3 + 2 * d] / n, v[3 + 2 * d :].reshape(d, d) / n))
    (_, all_neg, _, all_s, all_h), (pos_pos, pos_neg, pos_z, pos_s, pos_h) = parts
    p = model.prior
    negative = all_neg - p * pos_neg
    clipped = negative <= 0
    risk, gradient, curvature = p * pos_pos, p * (pos_s - pos_z), p * pos_h
    if not clipped:
        risk, gradient, curvature = risk + negative, gradient + all_s - p * pos_s, all_h
    penalty = np.full(d, RIDGE)
    penalty[0] = 0.0
    return (
        risk + 0.5 * float(penalty @ model.weights**2), gradient + penalty * model.weights,
        curvature + np.diag(penalty + 1e-9), clipped)


def fit(table: DataFrame, prior: float, steps: int = STEPS) -> Model:
    """Fit on ``table`` (x: array<float>, positive: boolean)."""
    def matrix(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1).astype("float64")
        return x, batch.column("positive").to_numpy(zero_copy_only=False).astype(bool)

    def moments(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        out = np.zeros(1 + 2 * WIDTH)
        for batch in batches:
            x, _ = matrix(batch)
            out += np.concatenate([[len(x)], x.sum(axis=0), (x * x).sum(axis=0)])
        return out

    m = sum_vectors(table, moments, 1 + 2 * WIDTH)
    n = max(m[0], 1.0)
    mean = m[1 : 1 + WIDTH] / n
    scale = np.sqrt(np.maximum(m[1 + WIDTH :] / n - mean * mean, 1e-12))
    mean[0], scale[0] = 0.0, 1.0
    start = np.zeros(WIDTH)
    start[0] = np.log(prior / (1 - prior))
    length = 2 * (3 + 2 * WIDTH + WIDTH * WIDTH)

    def evaluate(weights: np.ndarray):
        model = Model(mean, scale, weights, prior)

        def partial(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
            out = np.zeros(length)
            for batch in batches:
                if batch.num_rows:
                    out += sums(*matrix(batch), model)
            return out

        total = sum_vectors(table, partial, length)
        return risk_of(total, model), total[length // 2]

    weights = start
    (risk, gradient, curvature, clipped), positives = evaluate(weights)
    if not m[0] or not positives:
        return Model(mean, scale, start, prior)
    length_of_step = 1.0
    for _ in range(steps):
        step = np.linalg.solve(curvature + 1e-6 * np.eye(WIDTH), gradient)
        step *= min(1.0, 8.0 / max(np.abs(step).max(), 1e-12)) * length_of_step
        (new, *rest), _ = evaluate(weights - step)
        if new >= risk:
            length_of_step /= 4
            continue
        gain, risk, weights = risk - new, new, weights - step
        gradient, curvature, clipped = rest
        # With no risk left on negatives, going on would only fit the positives at hand.
        if clipped or gain < 1e-5:
            break
        length_of_step = min(1.0, 2 * length_of_step)
    return Model(mean, scale, weights, prior)


def stored_features(docs: DataFrame) -> DataFrame:
    """(doc_id, x): the features of every text, stored once."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("array<float>")
    def compute(texts: pd.Series) -> pd.Series:
        return pd.Series([np.array(features(t), dtype="float32") for t in texts])

    return materialise(docs.select("doc_id", compute(text_of()).alias("x")), "features")


def learn(rows: DataFrame, labels: DataFrame, learns: Column, steps: int = STEPS) -> Model:
    """Fit on all ``rows`` (doc_id, x) as unlabelled and, where ``learns`` holds, those labelled 1 as positives."""
    known = agreed_labels(labels, "quality").filter(learns)
    counts = rows.select("doc_id").join(known, "doc_id").agg(F.count(F.lit(1)), F.sum("__tw_label")).first()
    prior = min(0.99, max(0.01, ((counts[1] or 0) + 1) / (counts[0] + 2)))
    positives = known.filter("__tw_label = 1").select("doc_id", F.lit(True).alias("positive"))
    marked = rows.join(positives, "doc_id", "left").select("x", F.coalesce("positive", F.lit(False)).alias("positive"))
    return fit(materialise(marked, "marked"), prior, steps)


def score(model: Model, text: str = "text") -> Column:
    """The score of a text column: 0 to 1, the estimated probability that the text is good."""
    @F.pandas_udf("double")
    def compute(texts: pd.Series) -> pd.Series:
        return pd.Series(model.scores(np.array([features(t) for t in texts], dtype="float32")))

    return compute(text_of(text))


def score_features(model: Model, x: str = "x") -> Column:
    """The same score from stored features."""
    @F.pandas_udf("double")
    def compute(rows: pd.Series) -> pd.Series:
        return pd.Series(model.scores(np.array(list(rows), dtype="float32")))

    return compute(F.col(x))


def learning_rows(parts: int = 5, rest: int = 0) -> Column:
    """Rows that labels may be learned from: crc32 of the id modulo ``parts`` is not ``rest``."""
    return F.coalesce(fold("doc_id", parts) != F.lit(rest), F.lit(False))
