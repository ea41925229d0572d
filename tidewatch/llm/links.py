"""Links inside buckets, and the components they form.

A bucket may hold any number of rows. It is cut into blocks of bounded size and every pair of blocks is
one unit of work, so a hot bucket spreads over many tasks. A unit compares its two blocks with numpy and
returns a spanning forest of the links it found, never all pairs: components are unchanged by that.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.vectors import as_rows
from tidewatch.session import drop_table, store

BLOCK_ROWS = 512


def block_pairs(members: DataFrame, keys: list[str], node: str, block_rows: int = BLOCK_ROWS, *, sorted_join: bool = False) -> DataFrame:
    """Members of buckets with two rows or more, once for each pair of blocks they take part in.

    Adds ``__tw_i``, ``__tw_j`` (the pair, i <= j) and ``__tw_b`` (the row's own block). Sizes are
    pre-aggregated counts; the join with them may be skewed, which adaptive execution splits. ``sorted_join`` asks
    for a sort-merge join where the sizes grow with the members, so that small and large tables take one plan.
    """
    sizes = members.groupBy(*keys).agg(F.count(F.lit(1)).alias("__tw_n")).filter("__tw_n > 1")
    blocks = F.ceil(F.col("__tw_n") / F.lit(block_rows)).cast("int")
    return (
        members.join(sizes.hint("merge") if sorted_join else sizes, keys)
        .withColumn("__tw_nb", blocks)
        .withColumn("__tw_b", F.pmod(F.xxhash64(node), F.col("__tw_nb")).cast("int"))
        .withColumn("__tw_o", F.explode(F.sequence(F.lit(0), F.col("__tw_nb") - 1)))
        .withColumn("__tw_i", F.least("__tw_b", "__tw_o"))
        .withColumn("__tw_j", F.greatest("__tw_b", "__tw_o"))
        .drop("__tw_n", "__tw_nb", "__tw_o")
    )


def in_groups(frames: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[dict[str, np.ndarray]]:
    """Cut sorted batches into whole groups; a group that crosses batches is put together first.

    A group is a dictionary of arrays. Columns of vectors become matrices, filled up with zeros.
    """
    rest: dict[str, np.ndarray] = {}
    for frame in frames:
        if not len(frame):
            continue
        batch = {c: _array(frame[c]) for c in frame.columns}
        if rest:
            batch = {c: _stack(rest[c], batch[c]) for c in batch}
        size = len(batch[keys[0]])
        changes = np.zeros(size, dtype=bool)
        for key in keys:
            changes[1:] |= batch[key][1:] != batch[key][:-1]
        bounds = [0, *np.flatnonzero(changes).tolist()]
        for a, b in zip(bounds, bounds[1:]):
            if b - a > 1:
                yield {c: x[a:b] for c, x in batch.items()}
        rest = {c: x[bounds[-1]:] for c, x in batch.items()}
    if rest:
        yield rest


def _array(column: pd.Series) -> np.ndarray:
    return as_rows(column) if column.dtype == object and isinstance(column.iat[0], (np.ndarray, list)) else column.to_numpy()


def _stack(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    if a.ndim == 2 and a.shape[1] != b.shape[1]:
        width = max(a.shape[1], b.shape[1])
        a, b = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (a, b))
    return np.concatenate([a, b])


def per_unit(
    pairs: DataFrame, keys: list[str], work: Callable[[dict[str, np.ndarray]], tuple[np.ndarray, ...] | None], schema: str
) -> DataFrame:
    """Run ``work`` on every pair of blocks; it returns the columns of ``schema`` as arrays, or nothing.

    Many units share a task; each is bounded by two blocks.
    """
    unit = [*keys, "__tw_i", "__tw_j"]
    names = [field.strip().split(" ")[0] for field in schema.split(",")]

    def frame(made):
        return pd.DataFrame({n: np.concatenate(parts) for n, parts in zip(names, zip(*made))})

    def run(frames):
        made, rows = [], 0
        for group in in_groups(frames, unit):
            if len(group[unit[0]]) > 1 and (out := work(group)) is not None and len(out[0]):
                made.append(out)
                rows += len(out[0])
                if rows > 20000:
                    yield frame(made)
                    made, rows = [], 0
        if made:
            yield frame(made)

    return pairs.repartition(*unit).sortWithinPartitions(*unit).mapInPandas(run, schema)


def forest(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of a symmetric boolean matrix, as two arrays of positions."""
    left = np.ones(len(linked), dtype=bool)
    left[~linked.any(axis=1)] = False
    a: list[int] = []
    b: list[int] = []
    while left.any():
        queue = [int(left.argmax())]
        left[queue[0]] = False
        while queue:
            at = queue.pop()
            new = np.flatnonzero(linked[at] & left)
            left[new] = False
            found = new.tolist()
            a.extend([at] * len(found))
            b.extend(found)
            queue.extend(found)
    return np.array(a, dtype="int64"), np.array(b, dtype="int64")


def upper_pairs(group: dict[str, np.ndarray]) -> np.ndarray:
    """Which pairs (row, column) of a unit it has to compare: each pair of rows in exactly one unit."""
    block, i, j = group["__tw_b"], group["__tw_i"][0], group["__tw_j"][0]
    if i == j:
        return np.triu(np.ones((len(block), len(block)), dtype=bool), 1)
    return (block == i)[:, None] & (block == j)[None, :]


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b: long); root is the smallest node reachable.

    Alternates two steps until nothing changes: hang all larger neighbours of a node on its smallest
    neighbour, then all smaller ones. Each round is a shuffle of the edges, written to the shared
    folder; rounds grow with the logarithm of a component's size. Nothing is collected but a checksum.
    """
    spark = edges.sparkSession
    schema = "u long, v long"
    path = store(
        edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    seen = None
    while True:
        e = spark.read.schema(schema).parquet(path)
        seen = seen or _checksum(e)
        both = e.union(e.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large_path = store(large, "large_star")
        large = spark.read.schema(schema).parquet(large_path)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new_path = store(small.union(low).distinct(), "small_star")
        now = _checksum(spark.read.schema(schema).parquet(new_path))
        drop_table(spark, path)
        drop_table(spark, large_path)
        path = new_path
        if now == seen:
            break
        seen = now
    stars = spark.read.schema(schema).parquet(path)
    return stars.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        stars.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _checksum(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.sum(F.hash("u", "v").cast("long"))).first()
    return tuple(row)


