"""Clustering vectors around centroids (Lloyd's rounds on integers) with scalar lookup tables.

Vectors of exactly ``dims`` finite components take part; each component x becomes the integer
floor(``scale`` * x), with x as a double. They are stored once in blocks: per block and dimension the
distinct integers, and for each vector the number of its integer among them. In a round a task
tabulates, for each dimension of a block, the squared difference between every occurring integer and
every centroid. A distance is then a sum of table entries, gathered by numpy for all vectors of the block.

A round is one Spark job over the stored blocks. Each task adds up counts and sums per centroid; Spark
aggregates those, and the driver receives ``k`` x (``dims`` + 1) numbers whatever the number of vectors.
Integers are exact throughout. Blocks are bounded in rows, so no group of vectors meets in one task, and
a lost executor repeats only its blocks.

Nulls: vectors that are null or of another length, or hold null or non-finite components, take no part;
a null vec_id is hashed as an empty text. Repeated rows are vectors like all others. Equal
distances go to the smaller centroid, equal start hashes to the smaller vector. With fewer than ``k``
vectors there are fewer centroids; an empty table gives an empty result. Components are held to
+-2^27, so that every squared distance fits a long; sums of distances end at the largest long. Other
columns, also with names used here, are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.session import materialise

LARGEST = 2**27
LARGEST_LONG = 2**63 - 1
#: Vectors in one block: its tables and distances fit a few dozen MB at any number of dimensions up to 1,024.
BLOCK_VECTORS = 2048


class Clusters(NamedTuple):
    """``rows``: (vec_id, cluster, distance); ``centroids``: a row of integers for each centroid."""

    rows: DataFrame
    centroids: np.ndarray


def whole_numbers(column: str, scale: int) -> Column:
    """The components as integers, held to +-``LARGEST``."""
    edge = F.lit(float(LARGEST))
    return F.transform(column, lambda x: F.floor(F.greatest(F.least(x.cast("double") * scale, edge), -edge)).cast("int"))


def vectors(table: DataFrame, dims: int, scale: int) -> DataFrame:
    """(vec_id, v) of the vectors that take part."""
    good = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    kept = table.filter((F.size("embedding") == dims) & good)
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), whole_numbers("embedding", scale).alias("v"))


def blocks(rows: DataFrame, dims: int) -> DataFrame:
    """Stored blocks: (ids, codes, ends, values). ``values`` holds the distinct integers of all dimensions one after the
    other, ``ends`` where each dimension's end, ``codes`` (vectors x dims) where in ``values`` a component stands."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_VECTORS):
                part = batch.slice(at, BLOCK_VECTORS)
                x = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
                cut = [np.unique(x[:, d], return_inverse=True) for d in range(dims)]
                ends = np.cumsum([len(values) for values, _ in cut])
                codes = np.stack([inverse for _, inverse in cut], axis=1) + np.concatenate([[0], ends[:-1]])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part.column(0).to_pylist()], pa.list_(pa.int64())), _bytes(codes), _bytes(ends),
                     _bytes(np.concatenate([values for values, _ in cut]))],
                    names=["ids", "codes", "ends", "values"])

    return materialise(rows.mapInArrow(run, "ids array<long>, codes binary, ends binary, values binary"), "vector_blocks")


def _bytes(x: np.ndarray) -> pa.Array:
    return pa.array([x.astype("<i4").tobytes()], pa.binary())


def tables(values: np.ndarray, ends: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The squared difference between each occurring integer and its dimension's coordinate of each centroid."""
    dimension = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    return (values.astype("int64")[:, None] - centroids.T[dimension]) ** 2


def nearest(row: dict, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(codes, values, nearest centroid, squared distance) of a block."""
    ends, values = (np.frombuffer(row[c], "<i4") for c in ("ends", "values"))
    codes = np.frombuffer(row["codes"], "<i4").reshape(-1, len(ends))
    table = tables(values, ends, centroids)
    distance = np.zeros((len(codes), len(centroids)), dtype="int64")
    for d in range(len(ends)):
        distance += table[codes[:, d]]
    best = distance.argmin(axis=1)  # the first of equal ones
    return codes, values, best, distance[np.arange(len(codes)), best]


def recentred(stored: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round: floor of the mean of their vectors; one without vectors stays."""
    k, dims = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(k, dtype="int64"), np.zeros((k, dims), dtype="int64")
        for batch in batches:
            for row in batch.to_pylist():
                codes, values, best, _ = nearest(row, centroids)
                x = values[codes].astype("int64")
                for c in range(k):
                    mine = best == c
                    count[c] += mine.sum()
                    total[c] += x[mine].sum(axis=0)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(k, dtype="int32")), pa.array(count), pa.array(total.tolist(), pa.list_(pa.int64()))],
            names=["cluster", "n", "sums"])

    partial = stored.mapInArrow(run, "cluster int, n long, sums array<long>")
    sums = [F.sum(F.col("sums")[d].cast("decimal(38,0)")).alias(f"s{d}") for d in range(dims)]
    out = centroids.copy()
    for row in partial.filter("n > 0").groupBy("cluster").agg(F.sum("n").alias("n"), *sums).collect():
        out[row.cluster] = [int(row[f"s{d}"]) // row.n for d in range(dims)]
    return out


def first_centroids(rows: DataFrame, k: int, seed: int, dims: int) -> np.ndarray:
    """The ``k`` vectors whose hash of seed and id is smallest, in the order of the hashes."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("")))
    hashed = rows.select(F.sha2(key.cast("binary"), 256).alias("hash"), "v")
    first = hashed.orderBy("hash", "v").limit(k).collect()
    return np.array([r.v for r in first], dtype="int64").reshape(-1, dims)


def assigned(stored: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance) of every vector."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                _, _, best, distance = nearest(row, centroids)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["ids"], pa.int64()), pa.array(best.astype("int32")), pa.array(distance)],
                    names=["vec_id", "cluster", "distance"])

    return stored.mapInArrow(run, "vec_id long, cluster int, distance long")


def cluster(table: DataFrame, k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, seed: int = 3) -> Clusters:
    """Cluster the vectors of ``table`` (vec_id, embedding): ``rounds`` rounds, then one more assignment."""
    rows = vectors(table, dims, scale)
    stored = blocks(rows, dims)
    centroids = first_centroids(rows, k, seed, dims)
    if not len(centroids):
        return Clusters(assigned(stored.limit(0), np.zeros((1, dims), dtype="int64")), centroids)
    for _ in range(rounds):
        centroids = recentred(stored, centroids)
    return Clusters(assigned(stored, centroids), centroids)


def with_inertia(found: Clusters) -> DataFrame:
    """The rows of ``found`` with cluster_inertia and inertia (sums of distances) and centroid_sha256.

    The driver adds one sum for each centroid; the rows meet them as constants, without a join.
    """
    rows = materialise(found.rows, "clusters")
    sums = dict(rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)"))).collect())
    each = [min(int(sums.get(c, 0)), LARGEST_LONG) for c in range(len(found.centroids))]
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in found.centroids.tolist()]

    def of_cluster(values: list, kind: str) -> Column:
        return F.element_at(F.array(*map(F.lit, values)).cast(f"array<{kind}>"), F.col("cluster") + 1)

    return rows.select(
        "vec_id", "cluster", "distance", of_cluster(each, "bigint").alias("cluster_inertia"),
        F.lit(min(int(sum(sums.values())), LARGEST_LONG)).cast("long").alias("inertia"),
        of_cluster(names, "string").alias("centroid_sha256"))
