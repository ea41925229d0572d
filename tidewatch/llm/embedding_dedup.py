"""Near-duplicate vectors by iterative quantisation and multi-index Hamming tables.

Learning: unit vectors of a bounded sample are centred and rotated by PCA; iterative quantisation turns the
rotation until the vectors lie close to the corners of a cube, from several random starts. A bit is the sign
of a rotated coordinate. Centring balances the codes; the centre counts near copies once, so that no hot group
lies on it, and large groups, which the rotation follows, come to lie near corners. Retrieval: every vector is put in one table
per ``WIDTH`` bits of its codes, under its label; vectors that share a bucket in any table are candidates.
At cosine 0.98 two bits differ with probability 0.064, so 16 bits agree with 0.35 and none of 20 tables
does with 0.0002; closer pairs are missed less. Reranking: candidates are compared with their original
vectors in double precision, in blocks, and nothing below the threshold is linked.

A pair is counted in the first table in which it meets, so links are counted once without listing pairs;
blocks return counts and a spanning forest. Hot buckets spread over many pairs of blocks.

Vectors that are null, empty, zero or hold null or non-finite components link with nothing, and neither do
vectors with a null label. Vectors of different lengths never link. Repeated rows are vectors of their own
that link. A null vec_id names no component unless it holds no other. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.links import block_pairs, components, forest, per_unit, upper_pairs
from tidewatch.llm.rows import numbered, small_batches
from tidewatch.llm.vectors import as_rows, usable, widest
from tidewatch.session import materialise

#: Vectors that the rotations are learned from, the smallest by a hash of vec_id; all vectors are indexed.
SAMPLE_ROWS = 8192
#: Of these, the vectors that the centre is taken from.
THINNED_ROWS = 2048
TABLES = 20
WIDTH = 16
ROUNDS = 30


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one. Scaling by the largest component first keeps squares finite."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


@dataclass(frozen=True)
class Codes:
    """Learned rotations: per table a projection of unit vectors and the centre's coordinates."""

    projections: np.ndarray  # dimensions x (tables * width)
    cuts: np.ndarray
    width: int

    def keys(self, x: np.ndarray) -> np.ndarray:
        bits = unit(x) @ self.projections[: x.shape[1]] > self.cuts
        powers = 1 << np.arange(self.width)
        return bits.reshape(len(x), -1, self.width) @ powers


def learn(sample: np.ndarray, dimensions: int, tables: int = TABLES, width: int = WIDTH, seed: int = 5) -> Codes:
    """Learn rotations until there are bits for all tables; each start gives as many as it has dimensions."""
    width = min(width, dimensions)
    x = unit(np.pad(sample, ((0, 0), (0, dimensions - sample.shape[1]))))
    centre = centre_of(x[:THINNED_ROWS])
    _, axes = np.linalg.eigh((x - centre).T @ (x - centre))
    axes = axes[:, ::-1]  # by falling variance
    v = (x - centre) @ axes
    rng = np.random.default_rng(seed)
    per_start = max(1, min(dimensions, 256) // width)
    parts = []
    for _ in range(math.ceil(tables / per_start)):
        kept = per_start * width
        r = np.linalg.qr(rng.standard_normal((kept, kept)))[0]
        for _ in range(ROUNDS):
            corners = np.where(v[:, :kept] @ r >= 0, 1.0, -1.0)
            left, _, right = np.linalg.svd(corners.T @ v[:, :kept])
            r = right.T @ left.T
        parts.append(axes[:, :kept] @ r)
    projections = np.concatenate(parts, axis=1)[:, : tables * width]
    return Codes(projections, centre @ projections, width)


def centre_of(x: np.ndarray) -> np.ndarray:
    """The mean of unit vectors, near copies counted once and drawn to the origin where few are left.

    A hot group would pull a plain mean or median into itself, and its members would fall on both sides.
    """
    left, kept = np.ones(len(x), dtype=bool), []
    while left.any():
        at = int(left.argmax())
        kept.append(at)
        left &= x @ x[at] < 0.98
        left[at] = False
    return x[kept].sum(axis=0) / (len(kept) + 2 * x.shape[1])


def _compare(group: dict[str, np.ndarray], least: float) -> tuple[np.ndarray, ...] | None:
    """Links of one unit: (node, -1, number of links) for every node, and (a, b, 0) for a spanning forest."""
    x = unit(group["embedding"])
    node, keys, table = group["node"], group["keys"], int(group["slot"][0]) >> WIDTH
    i, j = np.nonzero((x @ x.T >= least) & upper_pairs(group) & (group["size"][:, None] == group["size"][None, :]))
    if table and len(i):  # pairs that met in an earlier table are counted there
        new = np.concatenate([
            ~(keys[i[a : a + 65536], :table] == keys[j[a : a + 65536], :table]).any(axis=1) for a in range(0, len(i), 65536)])
        i, j = i[new], j[new]
    if not len(i):
        return None
    linked = np.zeros((len(node), len(node)), dtype=bool)
    linked[i, j] = linked[j, i] = True
    a, b = forest(linked)
    links = linked.sum(axis=1)
    some = np.flatnonzero(links)
    return (
        np.concatenate([node[some], node[a]]),
        np.concatenate([np.full(len(some), -1), node[b]]),
        np.concatenate([links[some], np.zeros(len(a), dtype="int64")]),
    )


def near_vectors(table: DataFrame, least: float = 0.98) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``table`` (vec_id, embedding, label)."""
    spark = table.sparkSession
    small_batches(spark, 2000)
    rows = numbered(table.select("vec_id", "embedding", "label"), "node")
    good = rows.filter(usable() & F.col("label").isNotNull())
    out = rows.select("node", "vec_id")
    dimensions = widest(good)
    sample = good.orderBy(F.xxhash64("vec_id", "node"), "node").limit(SAMPLE_ROWS).select("embedding").toArrow()
    if not sample.num_rows:
        return out.select(
            "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"),
            F.col("vec_id").isNotNull().alias("kept"))
    codes = spark.sparkContext.broadcast(learn(as_rows(sample.column(0).combine_chunks()), dimensions))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keys = codes.value.keys(as_rows(batch.column("embedding")))
                flat = pa.ListArray.from_arrays(
                    pa.array(np.arange(0, keys.size + 1, keys.shape[1], dtype="int32")), pa.array(keys.astype("int32").ravel()))
                yield pa.RecordBatch.from_arrays([*batch.columns, flat], names=[*batch.schema.names, "keys"])

    coded = materialise(
        good.select("node", "label", "embedding", F.size("embedding").alias("size"))
        .mapInArrow(run, "node long, label int, embedding array<float>, size int, keys array<int>"
                    .replace("label int", f"label {dict(good.dtypes)['label']}")
                    .replace("array<float>", dict(good.dtypes)["embedding"])), "codes")
    members = coded.select("node", "label", F.posexplode("keys").alias("t", "k")).select(
        "node", "label", F.expr(f"shiftleft(t, {WIDTH}) | k").alias("slot"))
    units = block_pairs(members, ["label", "slot"], "node").join(coded.drop("label"), "node")
    found = materialise(
        per_unit(units, ["label", "slot"], lambda group: _compare(group, least), "a long, b long, n long"), "links")
    links = found.filter("b < 0").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n_links"))
    roots = components(found.filter("b >= 0").select("a", "b"))
    placed = (
        out.join(links, "node", "left").join(roots, "node", "left")
        .select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("root", "node").alias("root"))
    )
    names = (
        out.join(roots, "node").groupBy("root").agg(F.min("vec_id").alias("name")))
    named = placed.join(names, "root", "left").withColumn("component_id", F.coalesce("name", "vec_id"))
    return named.select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))
