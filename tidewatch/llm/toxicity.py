"""Toxicity by a weighted finite-state grammar over clauses.

Words are read in lower case and cut into clauses at sentence signs and line ends. A lexicon gives every word a
symbol: insult (also by stems, which accept every word that starts with them), threat verb, intent, target,
negation, reporting word, or nothing. Five transducers read symbols, each a table of states with an output
symbol per transition:

- ``negation`` turns insults and threat verbs at most ``REACH`` words after a negation into negated ones,
- ``threat`` turns a threat verb into a threat: a stated one after an intent ("will ... kill"), else a bare one,
- ``target`` and ``report`` pass everything on and remember whether the clause has a target or reported speech,
- ``insult`` passes everything on and remembers whether the clause has an insult.

They are composed, the output of one being the input of the next, into one automaton over the words' symbols
(``compose``: the product of the states that can be reached). Its transitions carry the factor by which a word's
weight counts, its states the factors by which the clause's sums of insults and of threats count at its end:

- a negated insult or threat counts ``NEGATED`` times, a bare threat ``BARE`` times a stated one,
- threats count only in a clause that has a target; insults then count ``AIMED`` times,
- a clause with reported speech counts ``REPORTED`` times.

A document's evidence is the sum over its clauses; a logistic curve turns it into a score. Insults, their
weights and the curve are learned from labels: a word or stem is an insult if the lower confidence bound of
its log-odds between toxic and other learning documents is high, in texts that stronger ones do not explain.
The lexicon holds all of them. It is learned from at most ``LEARNING_ROWS`` labelled ids and each entry occurs
in ``LEAST_DOCS`` or more of their toxic texts, so it does not grow with the corpus.

Nulls: a null text is scored like the empty text, which has no evidence. A null doc_id has no label and is
not held out. Repeated rows count as often as they occur. Without labels of both kinds the score of a text
without evidence is low and evidence of the fixed words alone counts. Texts are read whole. An empty table gives
an empty result and, as labels, the model without labels. Words equal in their bound are all taken, so ties
decide nothing. Only ``doc_id`` and the text are read: other columns may have any names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.rows import agreed_labels, small_batches, sum_vectors, text_of
from tidewatch.session import materialise

# Fixed words of the grammar, in the languages of the corpus.
THREATS = frozenset("kill murder strangle stab shoot destroy umbringen erschlagen töten tuer assassiner matar asesinar".split())
INTENTS = frozenset(
    "will shall gonna i'll we'll they'll he'll she'll going werde werden wird vais va allons vont voy vamos van".split())
TARGETS = frozenset(
    "you your yours yourself u ur du dich dir dein deine ihr euch euer tu toi te vous ton ta tes votre tú ti usted ustedes vosotros".split())
NEGATIONS = frozenset("not never no nor isn't aren't don't nicht kein keine keinen nie pas jamais ne nunca jamás ni".split())
REPORTS = frozenset(
    "said says wrote called quoted reported claimed sagte sagt schrieb nannte dit disait écrit écrivait dijo dice escribió llamó".split())

#: Labelled ids that are learned from at most, the first by a hash; a bounded sample once there are more.
LEARNING_ROWS = 200_000
#: Least lower bound of the log-odds for an insult, round by round, and least toxic learning documents.
BOUNDS = (4.5, 3.0, 2.0, 1.0)
LEAST_DOCS = 3
#: Distinct words and stems a task counts before it hands its counts on.
FLUSH = 400_000
STEM_LENGTHS = (4, 5, 6)
THREAT_WEIGHT = 4.0
REACH = 3
NEGATED = 0.5
BARE = 0.5
AIMED = 1.5
REPORTED = 0.7
#: Words whose class a worker remembers; results do not depend on it.
REMEMBERED = 300_000

TOKENS = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?|[.!?;:\n]")
WORDS = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
STOPS = frozenset(".!?;:\n")
#: Symbols: the first seven are read from words, the others are put out by transducers.
SYMBOLS = (
    "nothing", "stop", "target", "negation", "report", "intent", "threat", "insult",
    "negated_threat", "negated_insult", "stated", "bare", "negated_stated", "negated_bare")
NOTHING, STOP, TARGET, NEGATION, REPORT, INTENT, THREAT, INSULT = range(8)
READ = 8
OF = {name: i for i, name in enumerate(SYMBOLS)}


@dataclass(frozen=True)
class Transducer:
    """A deterministic transducer: ``step[state][symbol]`` is (next state, symbol put out); state 0 starts."""

    step: tuple[tuple[tuple[int, int], ...], ...]

    def run(self, symbols: Iterable[int]) -> tuple[list[int], list[int]]:
        """What it puts out, and the state after each symbol."""
        state, out, states = 0, [], []
        for symbol in symbols:
            state, put = self.step[state][symbol]
            out.append(put)
            states.append(state)
        return out, states


def transducer(states: int, rule: Callable[[int, str], tuple[int, str]]) -> Transducer:
    """The table of ``rule`` (state, symbol) -> (state, symbol); the end of a clause always leads to the start."""
    def cell(state: int, symbol: str) -> tuple[int, int]:
        after, put = rule(state, symbol)
        return (0 if symbol == "stop" else after), OF[put]

    return Transducer(tuple(tuple(cell(q, s) for s in SYMBOLS) for q in range(states)))


def negation(reach: int = REACH) -> Transducer:
    """State: for how many words a negation still holds."""
    def rule(left: int, symbol: str) -> tuple[int, str]:
        if symbol == "negation":
            return reach, symbol
        turned = left > 0 and symbol in ("threat", "insult")
        return max(left - 1, 0), "negated_" + symbol if turned else symbol

    return transducer(reach + 1, rule)


def threat() -> Transducer:
    """State 1 after an intent: threat verbs become stated threats, in state 0 bare ones."""
    def rule(intent: int, symbol: str) -> tuple[int, str]:
        if symbol == "intent":
            return 1, symbol
        return intent, symbol.replace("threat", "stated" if intent else "bare")

    return transducer(2, rule)


def seen(*symbols: str) -> Transducer:
    """Passes everything on; state 1 from the first of ``symbols`` to the end of the clause."""
    return transducer(2, lambda state, symbol: (1 if symbol in symbols else state, symbol))


#: In the order in which each reads what the one before puts out.
CASCADE = {
    "negation": negation(), "threat": threat(), "target": seen("target"), "report": seen("report"),
    "insult": seen("insult", "negated_insult")}
#: What a word's weight counts, by the symbol that the last transducer puts out: as insult, as threat.
FACTORS = {
    "insult": (1.0, 0.0), "negated_insult": (NEGATED, 0.0), "stated": (0.0, 1.0), "bare": (0.0, BARE),
    "negated_stated": (0.0, NEGATED), "negated_bare": (0.0, NEGATED * BARE)}


def closing(states: dict[str, int]) -> tuple[float, float]:
    """What a clause's insults and threats count, by the transducers' states at its end."""
    told = REPORTED if states["report"] else 1.0
    aimed = bool(states["target"])
    return (AIMED if aimed else 1.0) * told * states["insult"], told * aimed


@dataclass(frozen=True)
class Automaton:
    """Composed transducers: per state and word symbol the next state and two factors; two factors per state at the end."""

    step: tuple[tuple[tuple[int, float, float], ...], ...]
    end: tuple[tuple[float, float], ...]

    def clauses(self, symbols: list[int], weights: list[float]) -> Iterator[float]:
        """Weights of the clauses that match. The last one needs no stop."""
        state, insult, threats = 0, 0.0, 0.0
        for symbol, weight in zip([*symbols, STOP], [*weights, 0.0]):
            if symbol == STOP:
                by_insult, by_threat = self.end[state]
                total = insult * by_insult + threats * by_threat
                if total:
                    yield total
                insult = threats = 0.0
            state, as_insult, as_threat = self.step[state][symbol]
            insult += weight * as_insult
            threats += weight * as_threat


def compose(cascade: dict[str, Transducer]) -> Automaton:
    """One automaton for a cascade: its states are the tuples of states that can be reached from the start."""
    numbers: dict[tuple[int, ...], int] = {(0,) * len(cascade): 0}
    table: list[list[tuple[int, float, float]]] = []
    waiting = list(numbers)
    for states in waiting:  # grows while it is read
        row = []
        for symbol in range(READ):
            after, put = [], symbol
            for part, state in zip(cascade.values(), states):
                state, put = part.step[state][put]
                after.append(state)
            goal = tuple(after)
            if goal not in numbers:
                numbers[goal] = len(numbers)
                waiting.append(goal)
            row.append((numbers[goal], *FACTORS.get(SYMBOLS[put], (0.0, 0.0))))
        table.append(row)
    ends = tuple(closing(dict(zip(cascade, states))) for states in numbers)
    return Automaton(tuple(map(tuple, table)), ends)


GRAMMAR = compose(CASCADE)


@dataclass
class Grammar:
    """The lexicon: which symbol and weight a word has. ``GRAMMAR`` reads the symbols."""

    insults: dict[str, float]
    stems: dict[str, float]
    known: dict[str, tuple[int, float]] = field(default_factory=dict)

    def event(self, word: str) -> tuple[int, float]:
        if word in STOPS:
            return STOP, 0.0
        if word in self.insults:
            return INSULT, self.insults[word]
        for n in STEM_LENGTHS:
            if word[:n] in self.stems and len(word) >= n:
                return INSULT, self.stems[word[:n]]
        if word in THREATS:
            return THREAT, THREAT_WEIGHT
        for kind, words in ((INTENT, INTENTS), (TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS)):
            if word in words:
                return kind, 0.0
        return NOTHING, 0.0

    def events(self, text: str) -> list[tuple[int, float]]:
        words = TOKENS.findall(text.lower())
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        for word in set(words):
            if word not in known:
                known[word] = self.event(word)
        return list(map(known.__getitem__, words))

    def clauses(self, text: str) -> Iterator[float]:
        """Weights of the clauses that match."""
        events = self.events(text)
        # Only threat verbs and insults have a weight.
        if any(kind >= THREAT for kind, _ in events):
            symbols, weights = zip(*events)
            yield from GRAMMAR.clauses(list(symbols), list(weights))

    def evidence(self, text: str | None) -> tuple[float, float]:
        """What a document's clauses come to, saturating and growing."""
        total = sum(self.clauses(text or ""))
        return 1 - float(np.exp(-total / 3)), float(np.log1p(total))


@dataclass(frozen=True)
class Model:
    grammar: Grammar
    weights: np.ndarray

    def scores(self, texts) -> np.ndarray:
        x = np.array([(1.0, *self.grammar.evidence(t)) for t in texts]).reshape(-1, 3)
        return np.round(1 / (1 + np.exp(-np.clip(x @ self.weights, -30, 30))), 6)


def patterns_of(text: str) -> set[str]:
    """The words of a text, and their stems marked with *."""
    words = set(WORDS.findall(text.lower()))
    return words | {w[:n] + "*" for w in words for n in STEM_LENGTHS if len(w) >= n}


def pattern_counts(rows: DataFrame, explained: frozenset[str] = frozenset()) -> DataFrame:
    """(word, toxic, other): in how many texts of each kind a word or stem occurs, stored.

    Texts with a word of ``explained`` do not count. Tasks hand their counts on when they grow large.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: tuple[Counter[str], Counter[str]] = (Counter(), Counter())

        def flushed() -> pa.RecordBatch:
            words = list(counts[0].keys() | counts[1].keys())
            out = pa.RecordBatch.from_arrays(
                [pa.array(words, pa.string()), *(pa.array([c[w] for w in words], pa.int64()) for c in counts[::-1])],
                names=["word", "toxic", "other"])
            for c in counts:
                c.clear()
            return out

        for batch in batches:
            for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist()):
                found = patterns_of(text)
                if explained.isdisjoint(found):
                    counts[label].update(found)
            if max(map(len, counts)) > FLUSH:
                yield flushed()
        yield flushed()

    summed = rows.mapInArrow(run, "word string, toxic long, other long").groupBy("word").agg(
        F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    return materialise(summed, "pattern_counts")


def learn_grammar(docs: DataFrame) -> Grammar:
    """Insults and insult stems from labelled texts (text, label 0 or 1).

    In rounds of falling strictness: words that tell toxic texts from others by a wide margin come first, and
    what they explain is set aside, so that words which merely share a text with them (copies of one toxic
    text, say) do not enter.
    """
    toxic, count = docs.agg(F.coalesce(F.sum("label"), F.lit(0)), F.count(F.lit(1))).first()
    if not toxic or toxic == count:
        return Grammar({}, {})
    counts = pattern_counts(docs)
    others = counts.select("word", "other")
    lexicon: dict[str, float] = {}
    for bound in BOUNDS:
        odds = F.log((F.col("toxic") + 0.5) / F.lit(toxic + 1.0)) - F.log((F.col("other") + 0.5) / F.lit(count - toxic + 1.0))
        spread = F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("other") + 0.5))
        found = (
            counts.filter(F.col("toxic") >= LEAST_DOCS).withColumn("bound", odds - 1.96 * spread)
            .filter(F.col("bound") >= bound))
        lexicon |= {row.word: float(row.bound) for row in found.select("word", "bound").collect() if row.word not in lexicon}
        if bound != BOUNDS[-1]:
            rest = pattern_counts(docs.filter("label = 1"), frozenset(lexicon)).select("word", "toxic")
            counts = rest.join(others, "word")
    return Grammar(
        {w: b for w, b in lexicon.items() if w[-1] != "*"}, {w[:-1]: b for w, b in lexicon.items() if w[-1] == "*"})


def learn(docs: DataFrame, labels: DataFrame, learns: Column, steps: int = 20) -> Model:
    """Learn the lexicon and the curve from rows of ``docs`` where ``learns`` holds and that have a label.

    At most ``LEARNING_ROWS`` labelled ids are used.
    """
    small_batches(docs.sparkSession)
    known = agreed_labels(labels, "toxic").filter(learns).orderBy(F.xxhash64("doc_id"), "doc_id").limit(LEARNING_ROWS)
    # The broadcast is bounded by LEARNING_ROWS; texts stay where they are.
    rows = materialise(
        docs.select("doc_id", text_of().alias("text")).join(F.broadcast(known), "doc_id").select("text", F.col("__tw_label").alias("label")),
        "labelled_texts")
    grammar = learn_grammar(rows)

    @F.pandas_udf("array<double>")
    def evidence(texts: pd.Series) -> pd.Series:
        return pd.Series([np.array([1.0, *grammar.evidence(t)]) for t in texts])

    return Model(grammar, fit(materialise(rows.select(evidence("text").alias("x"), "label"), "evidence"), steps))


def fit(table: DataFrame, steps: int, ridge: float = 1e-3) -> np.ndarray:
    """Logistic regression on (x: array<double>, label) by Newton steps, each one pass added up in Spark."""
    # Three pseudo-rows keep the curve sensible without labels: no evidence is not toxic, much evidence is.
    pseudo = np.array([[1.0, 0.0, 0.0], [1.0, 0.0, 0.0], [1.0, 0.9, 2.0]]), np.array([0.0, 0.0, 1.0])
    weights = np.array([-2.0, 3.0, 1.0])

    def sums(x: np.ndarray, y: np.ndarray, weights: np.ndarray) -> np.ndarray:
        s = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        return np.concatenate([[len(x)], (s - y) @ x, ((x * (s * (1 - s))[:, None]).T @ x).ravel()])

    for _ in range(steps):
        def partial(batches: Iterator[pa.RecordBatch], weights=weights) -> np.ndarray:
            out = np.zeros(13)
            for batch in batches:
                x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, 3)
                out += sums(x, batch.column("label").to_numpy(zero_copy_only=False).astype("float64"), weights)
            return out

        total = sum_vectors(table, partial, 13) + sums(*pseudo, weights)
        gradient = total[1:4] / total[0] + ridge * weights * [0, 1, 1]
        step = np.linalg.solve(total[4:].reshape(3, 3) / total[0] + ridge * np.eye(3), gradient)
        step *= min(1.0, 4.0 / max(np.abs(step).max(), 1e-12))
        weights = weights - step
        if np.abs(step).max() < 1e-3:
            break
    return weights


def score(model: Model, text: str = "text") -> Column:
    """The score of a text column: 0 to 1, the estimated probability that the text is toxic."""
    @F.pandas_udf("double")
    def compute(texts: pd.Series) -> pd.Series:
        return pd.Series(model.scores(texts))

    return compute(text_of(text))
