"""Near-duplicate documents by SimHash and meet-in-the-middle ball hashing.

Fingerprint: A-Z in lower case, words cut at ASCII white space, shingles of ``words`` words joined by one
blank, repeats included (a shorter text is one shingle; a text without words has fingerprint zero and is
compared like any other). A bit is 1 if it is set in over half of the shingles' XXH64 hashes (seed 42).

Search within ``radius`` 3: of the two halves of a fingerprint, a pair of that distance agrees in one up to
a single bit. So the ball of radius 1 around a half suffices, and a half meets its partner in the middle:
partners at distance 1 differ in parity, hence only halves of odd parity emit the 32 variants besides
themselves, those of even parity just themselves (34 keys a fingerprint on average). Keys are shuffled,
fingerprints that share one are compared in blocks, and what is at most ``radius`` bits apart is linked.
(Whole-fingerprint balls of radius 1 and 2 would emit 1,073 variants on average for the same links.)

Equal fingerprints are one node from the start: thousands of copies cost one row. Nulls: a null text
counts as empty; a null doc_id is never a component's name unless the component holds no other. Repeated
rows are links like all others. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.llm.links import block_pairs, components, forest, per_unit, upper_pairs
from tidewatch.llm.rows import possibly_in, small_batches, sum_vectors, text_of
from tidewatch.session import materialise

RADIUS = 3
SEED = 42


_LANES = np.uint64(0x0101010101010101)


def shingle_hashes(tokens: list[bytes], words: int) -> np.ndarray:
    """XXH64 of every run of ``words`` tokens, repeats included; of the whole sequence if it is shorter."""
    if not tokens:
        return np.zeros(0, dtype="uint64")
    joined = b" ".join(tokens)
    digest = xxhash.xxh64_intdigest
    if len(tokens) <= words:
        return np.array([digest(joined, SEED)], dtype="uint64")
    ends = np.cumsum(np.fromiter(map(len, tokens), dtype="int64", count=len(tokens)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    return np.array(
        [digest(joined[a:b], SEED) for a, b in zip(starts[: len(starts) - words + 1].tolist(), ends[words - 1 :].tolist())],
        dtype="uint64")


def ones_of(hashes: np.ndarray) -> np.ndarray:
    """How many hashes of each row (..., n) have each bit set, from the highest bit down (..., 64).

    Eight bits, one of each byte, are added at once in byte lanes; 255 additions cannot overflow a lane.
    """
    *rows, n = hashes.shape
    padded = np.zeros((*rows, -(-n // 255) * 255), dtype="uint64")
    padded[..., :n] = hashes
    out = np.empty((*rows, 64), dtype="int64")
    for bit in range(8):
        lanes = ((padded >> np.uint64(bit)) & _LANES).reshape(*rows, -1, 255).sum(axis=-1, dtype="uint64")
        out[..., 63 - bit :: -8] = lanes.astype("<u8").view("uint8").reshape(*rows, -1, 8).sum(axis=-2, dtype="int64")
    return out


def fingerprint(text: str | None, words: int) -> int:
    """The fingerprint of one text as an unsigned 64-bit number."""
    hashes = shingle_hashes((text or "").encode("utf-8", "surrogatepass").lower().split(), words)
    return int.from_bytes(np.packbits(ones_of(hashes) * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """All columns of ``docs`` with ``__tw_fp``, the fingerprint as a signed long."""
    small_batches(docs.sparkSession)
    schema = T.StructType([*docs.schema.fields, T.StructField("__tw_fp", T.LongType())])
    texts = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = np.array([fingerprint(t, words) for t in batch.column(texts).to_pylist()], dtype="uint64").view("int64")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made)], names=[*batch.schema.names, "__tw_fp"])

    return docs.mapInArrow(run, schema)


def ball_keys(nodes: DataFrame) -> DataFrame:
    """(key, node): the variants of both halves of each fingerprint. The key's top bits name the half."""
    halves = F.explode(F.array(
        F.struct(F.lit(0).cast("long").alias("half"), F.expr("node & 4294967295").alias("value")),
        F.struct(F.lit(1).cast("long").alias("half"), F.shiftrightunsigned("node", 32).alias("value"))))
    own = F.array(F.lit(0).cast("long"))
    flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << k).cast("long") for k in range(32)])
    return (
        nodes.select("node", halves.alias("h"))
        .withColumn("flip", F.explode(F.when(F.expr("bit_count(h.value) % 2 = 0"), own).otherwise(flips)))
        .select(F.expr("shiftleft(h.half, 32) | (h.value ^ flip)").alias("key"), "node")
    )


def _close(group: dict[str, np.ndarray], radius: int) -> tuple[np.ndarray, np.ndarray] | None:
    node = group["node"]
    bits = node.view("uint64")
    linked = (np.bitwise_count(bits[:, None] ^ bits[None, :]) <= radius) & upper_pairs(group)
    if not linked.any():
        return None
    a, b = forest(linked | linked.T)
    return node[a], node[b]


def linked_fingerprints(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges (a, b) that connect all fingerprints (column node, distinct) at most ``radius`` bits apart."""
    if not 0 <= radius <= 3:
        raise ValueError("halves with one differing bit cover a radius of at most 3")
    # Spark's size of the nodes knows nothing of their 34 keys each: without the hint it broadcasts all keys of a small table.
    units = block_pairs(ball_keys(nodes), ["key"], "node", sorted_join=True)
    return per_unit(units, ["key"], lambda group: _close(group, radius), "a long, b long")


def near_copies(docs: DataFrame, words: int = 3, radius: int = RADIUS) -> DataFrame:
    """(doc_id, __tw_fp, component_id) for every row of ``docs``."""
    rows = materialise(fingerprints(docs.select("doc_id", text_of().alias("text")), words).drop("text"), "fingerprints")
    nodes = materialise(rows.groupBy(F.col("__tw_fp").alias("node")).agg(F.min("doc_id").alias("first")), "nodes")
    roots = components(linked_fingerprints(nodes.select("node"), radius))
    placed = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    names = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = placed.select("node", "root").join(names, "root").select(F.col("node").alias("__tw_fp"), "component_id")
    return rows.join(classes, "__tw_fp").select("doc_id", "__tw_fp", "component_id")


def first_of_components(docs: DataFrame, words: int = 3, radius: int = RADIUS) -> DataFrame:
    """``docs`` with the rows whose doc_id names their component of near copies (all rows, if it holds null ids alone).

    Which row of several with one doc_id stays is left to the caller: a row is known by doc_id and fingerprint here.
    """
    goes = materialise(
        near_copies(docs, words, radius).filter("component_id IS NOT NULL AND NOT doc_id <=> component_id")
        .select(F.col("doc_id").alias("__tw_id"), F.col("__tw_fp").alias("__tw_gone")).distinct(), "goes")
    known = lambda c: F.xxhash64(F.col(c).isNull(), F.col(c))
    # What goes is usually little: only rows that may be among it get their fingerprint again and are joined.
    told = possibly_in(docs, known("doc_id"), goes.select(known("__tw_id").alias("h")), "__tw_maybe")
    maybe = fingerprints(told.filter("__tw_maybe").select(*docs.columns), words)
    stay = maybe.join(goes, F.expr("doc_id <=> __tw_id AND __tw_fp = __tw_gone"), "left_anti")
    return told.filter("NOT __tw_maybe").select(*docs.columns).unionByName(stay.select(*docs.columns))


# Documents similar in their shingles, beyond a few bits. Candidates come from prefixes of the shingle sets: sets with
# a Jaccard of ``least`` share a shingle among the first of either in any common order, so no pair is missed. Rare
# shingles come first. A sketch of many SimHash words tells which of them may be similar; groups of those are compared
# by their exact sets.

#: 64-bit words of a sketch, and the standard deviations that similar sets may lie beyond the expected distance.
SKETCH_WORDS = 8
DEVIATIONS = 6
#: Numbers that count shingles by hash, to tell common ones; the driver sees these, however large the table is.
COUNTERS = 1 << 18


def combined(word_hashes: np.ndarray, words: int) -> np.ndarray:
    """A hash for every run of ``words`` words, from the words' hashes in order; of all words if there are fewer."""
    n = len(word_hashes)
    words = min(words, n)
    out = np.zeros(n - words + 1 if n else 0, dtype="uint64")
    for k in range(words):
        out = out * np.uint64(0x9E3779B97F4A7C15) + word_hashes[k : n - words + 1 + k]
    return out


#: Hashes that are mixed at once, so that a very long text needs little memory.
PART = 65536


def mixed(hashes: np.ndarray, streams: range) -> np.ndarray:
    """Independent 64-bit hashes from others, a row for each stream: a fixed bijective mixer with own starts."""
    starts = np.array([(k * 0x9E3779B97F4A7C15) % 2**64 for k in streams], dtype="uint64")
    z = hashes[None, :] + starts[:, None]
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def majority_bits(hashes: np.ndarray, streams: range) -> np.ndarray:
    """The bits set in over half of the mixed hashes, stream after stream."""
    ones = sum(ones_of(mixed(hashes[a : a + PART], streams)) for a in range(0, max(len(hashes), 1), PART))
    return (ones * 2 > len(hashes)).ravel()


def word_hashes(text: str | None) -> tuple[int, np.ndarray]:
    """(key of the normalised text, hashes of its words in order)."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    each = np.fromiter(map(xxhash.xxh64_intdigest, tokens), dtype="uint64", count=len(tokens))
    return xxhash.xxh64_intdigest(b" ".join(tokens), SEED), each


def shingle_set(each: np.ndarray, words: int) -> np.ndarray:
    """The distinct hashes of runs of ``words`` words."""
    return np.unique(mixed(combined(each, words), range(50, 51))[0])


def common_shingles(docs: DataFrame, words: int) -> np.ndarray:
    """How many documents' shingles fall on each of ``COUNTERS`` remainders; a common shingle lifts its own."""
    small_batches(docs.sparkSession)

    def partial(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        out = np.zeros(COUNTERS, dtype="int64")
        for batch in batches:
            for text in batch.column("text").to_pylist():
                np.add.at(out, shingle_set(word_hashes(text)[1], words) % np.uint64(COUNTERS), 1)
        return out

    return sum_vectors(docs.select(text_of().alias("text")), partial, COUNTERS)


def prefix(own: np.ndarray, least: Fraction, counts: np.ndarray) -> np.ndarray:
    """The first shingles of a set, rare ones before common ones: as many as it takes for no pair to be missed."""
    n = len(own)
    taken = n - math.ceil(least * n) + 1 if n else 0
    return own[np.lexsort((own, counts[own % np.uint64(COUNTERS)]))[:taken]]


def sketch(text: str | None, words: int, least: Fraction, counts: np.ndarray) -> tuple[int, int, np.ndarray, np.ndarray]:
    """(key of the normalised text, number of distinct shingles, sketch words, prefix)."""
    key, each = word_hashes(text)
    own = shingle_set(each, words)
    made = majority_bits(own, range(SKETCH_WORDS))
    return key, len(own), np.packbits(made).view("int64"), prefix(own, least, counts).view("int64")


def sketches(docs: DataFrame, words: int, least: Fraction) -> DataFrame:
    """(h1, h2: the row's key, doc_id, node, size, sketch, prefix) for every row of ``docs``."""
    counts = docs.sparkSession.sparkContext.broadcast(common_shingles(docs, words))
    small_batches(docs.sparkSession)
    keys = docs.select(*row_keys(), "doc_id", text_of().alias("text"))
    kind = dict(docs.dtypes)["doc_id"]

    def lists(rows: list[np.ndarray]) -> pa.Array:
        ends = np.cumsum([0, *map(len, rows)])
        return pa.ListArray.from_arrays(pa.array(ends.astype("int32")), pa.array(np.concatenate([np.zeros(0, "int64"), *rows])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [sketch(t, words, least, counts.value) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(np.array([m[0] for m in made], dtype="uint64").view("int64")),
                 pa.array([m[1] for m in made], pa.int32()), lists([m[2] for m in made]), lists([m[3] for m in made])],
                names=["h1", "h2", "doc_id", "node", "size", "sketch", "prefix"])

    return keys.mapInArrow(run, f"h1 long, h2 long, doc_id {kind}, node long, size int, sketch array<long>, prefix array<long>")


def row_keys() -> list[Column]:
    """128 bits that name a row by doc_id and text."""
    return [F.xxhash64(F.lit(n), F.col("doc_id").isNull(), F.col("doc_id"), text_of()).alias(f"h{n}") for n in (1, 2)]


def bits_apart(least: Fraction) -> int:
    """How many bits sketches of sets with a Jaccard of ``least`` may differ in. The angle between the sets gives the
    share of bits; sets of few shingles differ in up to a quarter more."""
    share = min(1.25 * math.acos(float(2 * least / (1 + least))) / math.pi, 0.5)
    bits = 64 * SKETCH_WORDS
    return math.ceil(bits * share + DEVIATIONS * math.sqrt(bits * share * (1 - share)))


def _maybe_similar(group: dict[str, np.ndarray], least: Fraction) -> tuple[np.ndarray, np.ndarray] | None:
    node, size = group["node"], group["size"].astype("int64")
    bits = group["sketch"].view("uint64")
    apart = sum(np.bitwise_count(bits[:, k, None] ^ bits[None, :, k]).astype("int32") for k in range(bits.shape[1]))
    sizes = np.minimum(size[:, None], size[None, :]) * least.denominator >= np.maximum(size[:, None], size[None, :]) * least.numerator
    linked = (apart <= bits_apart(least)) & sizes & upper_pairs(group)
    if not linked.any():
        return None
    a, b = forest(linked | linked.T)
    return node[a], node[b]


def _similar(group: dict[str, np.ndarray], least: Fraction) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of the pairs whose sets of shingles have a Jaccard of ``least``."""
    node, sets = group["node"], [np.frombuffer(x, "int64") for x in group["shingles"]]
    size = np.array([len(x) for x in sets])
    ends = np.cumsum(size)
    distinct, ids = np.unique(np.concatenate(sets), return_inverse=True)
    here = np.zeros(len(distinct), dtype="int32")
    left = np.ones(len(node), dtype=bool)
    a: list[int] = []
    b: list[int] = []
    while left.any():
        queue = [int(left.argmax())]
        left[queue[0]] = False
        while queue and left.any():
            at = queue.pop()
            own = ids[ends[at] - size[at] : ends[at]]
            here[own] = 1
            shared = np.add.reduceat(here[ids], ends - size)
            here[own] = 0
            found = np.flatnonzero(left & (shared * least.denominator >= (size + size[at] - shared) * least.numerator)).tolist()
            left[found] = False
            a.extend([at] * len(found))
            b.extend(found)
            queue.extend(found)
    return node[np.array(a, dtype="int64")], node[np.array(b, dtype="int64")]


def linked_sketches(nodes: DataFrame, least: Fraction) -> DataFrame:
    """Edges (a, b) that connect at least all nodes (node, size, sketch, prefix) with a Jaccard of ``least``."""
    members = nodes.select(F.explode("prefix").alias("key"), "node")
    units = block_pairs(members, ["key"], "node", sorted_join=True).join(nodes.select("node", "size", "sketch").hint("merge"), "node")
    return per_unit(units, ["key"], lambda group: _maybe_similar(group, least), "a long, b long")


def stored_sets(texts: DataFrame, words: int) -> DataFrame:
    """(node, shingles as bytes) of the rows (node, text), one row for each node, stored."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [shingle_set(word_hashes(t)[1], words).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(made, pa.binary())], names=["node", "shingles"])

    small_batches(texts.sparkSession)
    return materialise(texts.mapInArrow(run, "node long, shingles binary").dropDuplicates(["node"]), "shingle_sets")


def linked_sets(groups: DataFrame, sets: DataFrame, least: Fraction) -> DataFrame:
    """Edges (a, b) that connect the nodes with a Jaccard of ``least``, none below, inside the groups (node, root)."""
    units = block_pairs(groups.select("root", "node"), ["root"], "node").join(sets, "node")
    return per_unit(units, ["root"], lambda group: _similar(group, least), "a long, b long")


def keep_one(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` with one row of each group of similar documents: the one with the smallest doc_id.

    Similarity is the Jaccard of the sets of ``words``-word shingles. All similar pairs meet in the prefixes of their
    sets; sketches sort out what is far from similar, and the groups that are left are compared by their exact sets. Texts equal after normalisation (lower case, white space) are one node from the start.
    Null ids come last; further ties are settled by the row's key. Of rows equal in doc_id and text one stays.
    """
    least = Fraction(similarity).limit_denominator(10**6)
    rows = materialise(sketches(docs, words, least), "sketches")
    nodes = materialise(rows.groupBy("node").agg(*[F.first(c).alias(c) for c in ("size", "sketch", "prefix")]), "nodes")
    groups = materialise(components(linked_sketches(nodes, least)), "groups")
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("h1"), F.col("h2"))
    # First per node, with copies combined map-side; only then per group.
    per_node = rows.groupBy("node").agg(F.min_by(F.struct("h1", "h2"), order).alias("row"), F.min(order).alias("order"))
    # Only texts in a group are read again for their sets.
    compared = materialise(per_node.join(groups, "node").select("row.h1", "row.h2", "node"), "compared")
    texts = possibly_in(docs.select(*row_keys(), text_of().alias("text")), F.col("h1"), compared.select("h1"), "__tw_maybe").filter("__tw_maybe")
    sets = stored_sets(texts.join(compared, ["h1", "h2"]).select("node", "text"), words)
    roots = components(linked_sets(groups, sets, least))
    first = (
        per_node.join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("group"))
        .agg(F.min_by("row", "order").alias("row")).select("row.h1", "row.h2", F.lit(True).alias("first")))
    # What goes is usually little: only rows that may be among it are joined, the others are not shuffled.
    counted = rows.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).join(first, ["h1", "h2"], "left")
    unusual = materialise(counted.filter("first IS NULL OR n > 1").select("h1", "h2", F.col("first").isNotNull().alias("stays")), "unusual")
    keyed = docs.select("*", *[k.alias(f"__tw_{n}") for k, n in zip(row_keys(), ("h1", "h2"))])
    keyed = possibly_in(keyed, F.col("__tw_h1"), unusual.select("h1"), "__tw_maybe")
    same = (F.col("__tw_h1") == F.col("h1")) & (F.col("__tw_h2") == F.col("h2"))
    usual, maybe = keyed.filter("NOT __tw_maybe"), keyed.filter("__tw_maybe")
    once = usual.unionByName(maybe.join(unusual, same, "left_anti"))
    repeated = maybe.join(unusual.filter("stays"), same, "left_semi").dropDuplicates(["__tw_h1", "__tw_h2"])
    return once.unionByName(repeated).drop("__tw_h1", "__tw_h2", "__tw_maybe")
