"""Encoding and decoding with a byte-pair vocabulary whose words end in a marker.

A text is normalised (NFC, lower case), cut into pieces at white space and by the vocabulary's pattern,
and each piece is merged pair by pair. Merging runs in batches: the symbols of many pieces lie in one flat
array, the rank of every neighbouring pair is found by binary search over the sorted pair keys, each piece
merges all places of its lowest-rank pair, and the rounds go on until no pair has a rank. Pieces that are
finished leave the array, so one very long piece does not hold up the others.

A worker reads texts in stretches of bounded size, cut at white space, and remembers the ids and the decoded
form of pieces up to a bounded number of bytes; results do not depend on it.

The vocabulary file is a parameter. Special tokens that occur in a text become their ids. Nulls: a null
text encodes to no ids, and no ids decode to the empty text. All columns pass through; an input column
with the name of the output is replaced. Texts of any length are encoded whole.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidewatch.llm.rows import small_batches

#: Bytes of pieces that a worker remembers; beyond that it starts afresh.
REMEMBERED_BYTES = 80 << 20
#: What an entry takes besides its strings.
ENTRY_BYTES = 260
#: Characters of a stretch of text, and bytes of new pieces that are merged at once.
STRETCH = 1 << 19
MERGED_BYTES = 1 << 17
#: Where a long text may be cut.
BLANK = regex.compile(r"[ \t\n\r]")


class Vocabulary:
    """What encoding and decoding need of a vocabulary file, as plain arrays and dictionaries."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            data = json.load(file)
        model = data["model"]
        ids: dict[str, int] = model["vocab"]
        self.end = model["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        split = next(p for p in data["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pattern = split["pattern"]["Regex"]
        self.tokens = [""] * (max([*ids.values(), *self.special.values()]) + 1)
        for token, i in chain(ids.items(), self.special.items()):
            self.tokens[i] = token
        letters = byte_letters()
        self.inner = np.array([ids[c] for c in letters], dtype="int64")
        self.last = np.array([ids[c + self.end] for c in letters], dtype="int64")
        pairs = [(ids[a], ids[b], ids[a + b]) for a, b in map(tuple, model["merges"])]
        keys = np.array([a << 32 | b for a, b, _ in pairs], dtype="int64")
        # A pair that is listed twice has the rank of its last entry.
        order = np.lexsort((-np.arange(len(keys)), keys))
        order = order[np.concatenate([[True], keys[order][1:] != keys[order][:-1]])]
        self.keys, self.ranks = keys[order], order.astype("int64")
        self.merged = np.array([c for _, _, c in pairs], dtype="int64")

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair; the number of merges where there is none."""
        wanted = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.ranks[at], len(self.merged))

    def merge(self, pieces: list[bytes]) -> list[list[int]]:
        """The ids of each piece (not empty), all pieces at once."""
        lengths = np.fromiter(map(len, pieces), dtype="int64", count=len(pieces))
        flat = np.frombuffer(b"".join(pieces), dtype="uint8")
        symbols = self.inner[flat]
        ends = np.cumsum(lengths) - 1
        symbols[ends] = self.last[flat[ends]]
        owner = np.repeat(np.arange(len(pieces)), lengths)
        out: list[list[int]] = [[]] * len(pieces)
        none = len(self.merged)
        while len(symbols):
            ranks = np.full(len(symbols), none, dtype="int64")
            inside = owner[1:] == owner[:-1]
            ranks[:-1][inside] = self.pair_ranks(symbols[:-1][inside], symbols[1:][inside])
            starts = np.flatnonzero(np.concatenate([[True], ~inside]))
            lowest = np.minimum.reduceat(ranks, starts)
            sizes = np.diff(np.append(starts, len(symbols)))
            done = lowest == none
            if done.any():
                active = np.repeat(~done, sizes)
                finished = symbols[~active].tolist()
                ends_at = np.cumsum(sizes[done]).tolist()
                for piece, a, b in zip(owner[starts[done]].tolist(), [0, *ends_at], ends_at):
                    out[piece] = finished[a:b]
                symbols, owner, ranks = symbols[active], owner[active], ranks[active]
                lowest, sizes = lowest[~done], sizes[~done]
                if not len(symbols):
                    break
            hit = ranks == np.repeat(lowest, sizes)
            hit[:-1] &= owner[1:] == owner[:-1]
            # In a run of overlapping places only every other one merges, from the left.
            places = np.flatnonzero(hit)
            fresh = np.concatenate([[True], np.diff(places) > 1])
            run = np.maximum.accumulate(np.where(fresh, places, 0))
            places = places[(places - run) % 2 == 0]
            symbols[places] = self.merged[ranks[places]]
            keep = np.ones(len(symbols), dtype=bool)
            keep[places + 1] = False
            symbols, owner = symbols[keep], owner[keep]
        return out


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself where it prints, else one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(rest)) for b in range(256)]


class Encoder:
    """Encodes texts in one worker, remembering pieces it has met.

    Ids are kept as text, joined by blanks, beside the decoded form; both are joined further without being taken apart.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.find = regex.compile(vocabulary.pattern).findall
        self.cut = regex.compile("(" + "|".join(map(regex.escape, vocabulary.special)) + ")").split if vocabulary.special else None
        self.marks = [s[:2] for s in vocabulary.special]
        self.names = [str(i) for i in range(len(vocabulary.tokens))]
        self.forget()

    def forget(self) -> None:
        # Special tokens have a blank before their name, which no piece has.
        self.ids = {" " + s: str(i) for s, i in self.vocabulary.special.items()}
        self.texts = {" " + s: self.vocabulary.tokens[i] for s, i in self.vocabulary.special.items()}
        self.held = 0

    def normal_pieces(self, text: str) -> list[str]:
        return self.find(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())

    def pieces(self, text: str) -> list[str]:
        """The pieces of a text, and the special tokens between them."""
        if not any(mark in text for mark in self.marks):
            return self.normal_pieces(text)
        out: list[str] = []
        for i, part in enumerate(self.cut(text)):
            out.extend([" " + part] if i % 2 else self.normal_pieces(part))
        return out

    def learn(self, new: list[str]) -> None:
        """Take in new pieces, merged in batches."""
        names, tokens = self.names, self.vocabulary.tokens
        for group in _batches_of(new):
            for piece, ids in zip(group, self.vocabulary.merge([p.encode() for p in group])):
                self.ids[piece] = ids_text = " ".join([names[i] for i in ids])
                self.texts[piece] = text = " ".join([tokens[i] for i in ids])
                self.held += len(piece) + len(ids_text) + len(text) + ENTRY_BYTES

    def read(self, texts: list[str | None]) -> Iterator[list[tuple[int, str, str]]]:
        """(row, ids, decoded form) of all stretches of the texts, some at a time. Stretches without ids are left out."""
        for group in _groups(texts):
            if self.held > REMEMBERED_BYTES:
                self.forget()
            cut = [(row, pieces) for row, stretch in group if (pieces := self.pieces(stretch))]
            self.learn(list(set(chain.from_iterable(pieces for _, pieces in cut)).difference(self.ids)))
            yield [(row, " ".join(map(self.ids.__getitem__, ps)), " ".join(map(self.texts.__getitem__, ps))) for row, ps in cut]

    def encode(self, texts: list[str | None]) -> pa.Array:
        """A list of ids for each text."""
        rows: list[list[np.ndarray]] = [[] for _ in texts]
        for group in self.read(texts):
            for row, ids, _ in group:
                rows[row].append(_numbers(ids))
        return _lists(rows)

    def digests(self, texts: list[str | None], with_ids: bool) -> list[pa.Array]:
        """Number of ids, SHA-256 of the ids joined by blanks, SHA-256 of the decoded text; the ids themselves on demand."""
        count = [0] * len(texts)
        made = [(hashlib.sha256(), hashlib.sha256()) for _ in texts]
        rows: list[list[np.ndarray]] = [[] for _ in texts]
        for group in self.read(texts):
            for row, ids, text in group:
                if count[row]:
                    made[row][0].update(b" ")
                    made[row][1].update(b" ")
                count[row] += ids.count(" ") + 1
                made[row][0].update(ids.encode())
                made[row][1].update(text.encode())
                if with_ids:
                    rows[row].append(_numbers(ids))
        out = [pa.array(count, pa.int64()), *[pa.array([m[k].hexdigest() for m in made], pa.string()) for k in (0, 1)]]
        return [*out, _lists(rows)] if with_ids else out


def _numbers(ids: str) -> np.ndarray:
    return np.array(ids.split(" "), dtype="int32")


def _lists(rows: list[list[np.ndarray]]) -> pa.Array:
    ends = np.cumsum([0, *[sum(map(len, r)) for r in rows]])
    flat = np.concatenate([np.zeros(0, "int32"), *chain.from_iterable(rows)])
    return pa.ListArray.from_arrays(pa.array(ends.astype("int32")), pa.array(flat))


def _batches_of(pieces: list[str]) -> Iterator[list[str]]:
    """Pieces in batches of about ``MERGED_BYTES``."""
    group: list[str] = []
    size = 0
    for piece in pieces:
        group.append(piece)
        size += len(piece)
        if size >= MERGED_BYTES:
            yield group
            group, size = [], 0
    if group:
        yield group


def _groups(texts: list[str | None]) -> Iterator[list[tuple[int, str]]]:
    """(row, stretch of its text) in groups of about ``STRETCH`` characters; long texts are cut before white space."""
    group: list[tuple[int, str]] = []
    size = 0
    for row, text in enumerate(texts):
        at = 0
        while text and at < len(text):
            end = len(text)
            if end - at > STRETCH:
                space = BLANK.search(text, at + STRETCH)
                end = space.start() if space else end
            group.append((row, text[at:end]))
            size += end - at
            at = end
            if size >= STRETCH:
                yield group
                group, size = [], 0
    if group:
        yield group


def _worker_batches(df: DataFrame, schema: T.StructType, source: str, compute) -> DataFrame:
    """``df`` with columns made from another, batch by batch; ``compute()`` gives a worker's function."""
    small_batches(df.sparkSession)
    at = df.columns.index(source)
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = compute()
        for batch in batches:
            yield pa.RecordBatch.from_arrays(make(batch, at), names=names)

    return df.mapInArrow(run, schema)


def _with_column(df: DataFrame, source: str, name: str, kind: T.DataType, compute) -> DataFrame:
    df = df.drop(name) if name in df.columns and name != source else df

    def worker():
        make = compute()
        return lambda batch, at: [*batch.columns, make(batch.column(at))]

    return _worker_batches(df, T.StructType([*df.schema.fields, T.StructField(name, kind)]), source, worker)


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with the ids of its texts, an array of int. ``path`` is read by the driver only."""
    vocabulary = docs.sparkSession.sparkContext.broadcast(Vocabulary(path))  # a vocabulary's size is fixed

    def worker():
        encoder = Encoder(vocabulary.value)
        return lambda column: encoder.encode(column.to_pylist())

    return _with_column(docs, text, ids, T.ArrayType(T.IntegerType()), worker)


def digests(docs: DataFrame, path: str, ids: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of the texts of ``docs`` (doc_id, text), and their ids on demand.

    Encoding and decoding are one pass of one worker; neither the texts nor, unless they are asked for, the ids come back.
    """
    vocabulary = docs.sparkSession.sparkContext.broadcast(Vocabulary(path))
    rows = docs.select("doc_id", "text")
    schema = T.StructType([
        rows.schema["doc_id"], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()),
        T.StructField("decoded_sha256", T.StringType()), *([T.StructField(ids, T.ArrayType(T.IntegerType()))] if ids else [])])

    def worker():
        encoder = Encoder(vocabulary.value)
        return lambda batch, at: [batch.column(0), *encoder.digests(batch.column(at).to_pylist(), bool(ids))]

    return _worker_batches(rows, schema, "text", worker)


def decode(rows: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``rows`` with the texts of its ids: without a decoder in the file, tokens joined by one blank."""
    vocabulary = rows.sparkSession.sparkContext.broadcast(Vocabulary(path))

    def worker():
        token = vocabulary.value.tokens.__getitem__

        def run(column: pa.Array) -> pa.Array:
            bounds = column.offsets.to_pylist()
            values = column.values.to_numpy(zero_copy_only=False)
            null = column.is_null().to_pylist()
            return pa.array(["" if no else " ".join(map(token, values[a:b].tolist())) for a, b, no in zip(bounds, bounds[1:], null)])

        return run

    return _with_column(rows, ids, text, T.StringType(), worker)
