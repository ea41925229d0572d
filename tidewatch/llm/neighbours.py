"""Nearest neighbours by vantage-point trees, one per shard.

Nearness is the largest inner product. One more coordinate, the square root of what a vector's squared
length lacks to the largest one, makes that the smallest distance, so the triangle inequality holds:
|q - x|^2 = |q|^2 + M^2 - 2 q.x with M the largest length.

The vectors are dealt to shards of about ``SHARD_ROWS`` by a hash. A shard's tree has a vantage point and
the median distance to it at every node. Queries are packed into blocks, and every block visits every
shard's tree: at a node the side that a query lies in is searched first, the other side only where the
triangle inequality leaves room for something nearer than the worst neighbour found so far. ``factor``
shortens that reach: 1 is exact, less visits less. A leaf is compared in one matrix product. The nearest of
each shard are merged per query by a ranked window, which keeps the first rows map-side.

Vectors that are null, empty, zero or hold null or non-finite components take no part, neither as query
nor as candidate; rows with a null vec_id are candidates, last among equals. Vectors of different lengths
are filled up with zeros. Repeated rows are candidates of their own. Empty tables give an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.rows import numbered
from tidewatch.llm.vectors import as_rows, usable, widest
from tidewatch.session import materialise

SHARD_ROWS = 4096
QUERY_ROWS = 2048
LEAF_ROWS = 64
#: Reach of the triangle inequality; 1 is exact.
FACTOR = 1.0
LAST = np.iinfo("int64").max


#: Far above the rounding error of an inner product, relative to the squared lengths.
ROUNDING = 1e-12


def ordered_products(q: np.ndarray, x: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Inner products of rows ``i`` of ``q`` and ``j`` of ``x``, summed from the first component to the last."""
    parts = [np.cumsum(q[i[a : a + 4096]] * x[j[a : a + 4096]], axis=1)[:, -1] for a in range(0, len(i), 4096)]
    return np.concatenate([np.zeros(0), *parts])


class Tree:
    """A vantage-point tree over one shard; nodes are ranges of a reordered matrix."""

    def __init__(self, x: np.ndarray, row: np.ndarray, name: np.ndarray, most: float, leaf: int = LEAF_ROWS):
        self.most = most
        lack = np.sqrt(np.maximum(0.0, most - (x * x).sum(axis=1)))
        order = np.arange(len(x))
        self.nodes: dict[int, tuple[int, int, int, float, int, int]] = {}
        todo = [(0, 0, len(x))]
        count = 1
        while todo:
            at, a, b = todo.pop()
            inside = order[a:b]
            if b - a <= leaf:
                self.nodes[at] = (a, b, -1, 0.0, -1, -1)
                continue
            point = inside[len(inside) // 2]
            far = np.sqrt(np.maximum(0.0, ((x[inside] - x[point]) ** 2).sum(axis=1) + (lack[inside] - lack[point]) ** 2))
            by = np.argsort(far, kind="stable")
            half = (b - a) // 2
            order[a:b] = inside[by]
            self.nodes[at] = (a, b, int(point), float(far[by[half]]), count, count + 1)
            todo += [(count, a, a + half), (count + 1, a + half, b)]
            count += 2
        self.points = {at: (x[n[2]], lack[n[2]]) for at, n in self.nodes.items() if n[2] >= 0}
        self.x, self.row, self.name = x[order], row[order], name[order]

    def search(self, q: np.ndarray, own: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray]:
        """Scores and places (-1: none) of the k best for each query, best first, ties to the smaller name."""
        square = (q * q).sum(axis=1)
        score = np.full((len(q), k), -np.inf)
        place = np.full((len(q), k), -1, dtype="int64")

        def reach(who: np.ndarray) -> np.ndarray:
            worst = score[who, -1]
            found = np.isfinite(worst)
            whole = square[who] + self.most
            # The difference may cancel: a little more than its rounding error is added before the root is taken.
            rest = np.maximum(0.0, whole - 2 * np.where(found, worst, 0.0)) + ROUNDING * whole
            return np.where(found, np.sqrt(rest) * factor, np.inf)

        def visit(at: int, who: np.ndarray) -> None:
            if not len(who):
                return
            a, b, point, radius, inner, outer = self.nodes[at]
            if point < 0:
                # The product only tells which scores may count: its last bits differ between equal vectors.
                rough = q[who] @ self.x[a:b].T
                rough[own[who][:, None] == self.row[None, a:b]] = -np.inf
                enough = rough >= (score[who, -1] - ROUNDING * (square[who] + self.most))[:, None]
                better = enough.any(axis=1) & np.isfinite(rough).any(axis=1)
                who, enough = who[better], (enough & np.isfinite(rough))[better]
                if len(who):
                    new = np.full(enough.shape, -np.inf)
                    i, j = np.nonzero(enough)
                    new[i, j] = ordered_products(q, self.x, who[i], a + j)
                    both = np.concatenate([score[who], new], axis=1)
                    where = np.concatenate([place[who], np.broadcast_to(np.arange(a, b), new.shape)], axis=1)
                    names = np.where(where < 0, LAST, self.name[where])
                    best = np.lexsort((names, -both), axis=1)[:, :k]
                    score[who] = np.take_along_axis(both, best, axis=1)
                    place[who] = np.where(np.isfinite(score[who]), np.take_along_axis(where, best, axis=1), -1)
                return
            vector, lack = self.points[at]
            far = np.sqrt(np.maximum(0.0, ((q[who] - vector) ** 2).sum(axis=1) + lack * lack))
            near = far < radius
            visit(inner, who[near])
            visit(outer, who[~near])
            # The other side of the sphere holds nothing within reach if the reach ends before it.
            slack = 1e-9 * (1.0 + radius)
            left = who[near]
            visit(outer, left[far[near] + reach(left) + slack >= radius])
            right = who[~near]
            visit(inner, right[far[~near] - reach(right) - slack <= radius])

        visit(0, np.arange(len(q)))
        return score, place


def nearest(table: DataFrame, is_query: Column, k: int = 20, factor: float = FACTOR, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows of ``table`` (vec_id, embedding) for each query row."""
    rows = numbered(table.select("vec_id", "embedding", is_query.alias("asks")), "row").filter(usable())
    width = widest(rows)
    count, longest = rows.agg(
        F.count(F.lit(1)), F.max(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))).first()
    most = (longest or 0.0) * (1 + 1e-12)
    shards = max(1, -(-count // shard_rows))
    asked = rows.filter(F.col("asks") & F.col("vec_id").isNotNull())
    blocks = max(1, -(-asked.count() // QUERY_ROWS))

    def packed(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("row", ignore_index=True)
        x = as_rows(group["embedding"])
        x = np.pad(x, ((0, 0), (0, width - x.shape[1])))
        name = group["vec_id"].to_numpy()
        return pd.DataFrame({
            "part": group["part"].iloc[:1].to_numpy(), "x": [x.tobytes()], "row": [group["row"].to_numpy().tobytes()], "name": [name.tobytes()]})

    def pack(df: DataFrame, parts: int) -> DataFrame:
        return (
            df.withColumn("part", F.pmod(F.xxhash64("row"), F.lit(parts)).cast("int"))
            .select("part", "row", F.coalesce("vec_id", F.lit(LAST)).alias("vec_id"), "embedding")
            .groupBy("part").applyInPandas(packed, "part int, x binary, row binary, name binary"))

    def read(r, prefix):
        row = np.frombuffer(r[f"{prefix}row"], dtype="int64")
        return np.frombuffer(r[f"{prefix}x"], dtype="float64").reshape(len(row), -1), row, np.frombuffer(r[f"{prefix}name"], dtype="int64")

    def search(group: pd.DataFrame) -> pd.DataFrame:
        r = group.iloc[0]
        tree = Tree(*read(r, ""), most)
        q, own, name = read(r, "q_")
        score, place = tree.search(q, own, k, factor)
        at, _ = np.nonzero(place >= 0)
        return pd.DataFrame({
            "own": own[at], "query_id": name[at], "vec_id": tree.name[place[place >= 0]], "score": score[place >= 0]})

    index = materialise(pack(rows, shards), "shards")
    questions = pack(asked, blocks).select(
        F.col("part").alias("block"), F.col("x").alias("q_x"), F.col("row").alias("q_row"), F.col("name").alias("q_name"))
    pairs = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).join(questions, "block")
    found = pairs.groupBy("part", "block").applyInPandas(search, "own long, query_id long, vec_id long, score double")
    rank = "row_number() OVER (PARTITION BY own ORDER BY score DESC, vec_id)"
    return (
        found.selectExpr("*", f"{rank} AS rank").filter(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("int").alias("rank"), F.nullif("vec_id", F.lit(LAST)).alias("vec_id"), "score"))
