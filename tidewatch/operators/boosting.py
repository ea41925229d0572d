"""Boosted trees of second order on binned columns, grown level by level with one Spark aggregate each.

Columns are cut at quantiles into at most ``bins`` bins; the bin numbers of every row are stored once and kept by the
executors as arrays, columns of two bins that are never both in the upper one (categories) together as one. A level of a
tree is one job: each task adds up gradients and Hessians per (node, column, bin) of its rows, for the lighter one of two
siblings only, and the driver gets the sums of the bins there are, whose number depends on nodes, columns and bins alone.
Leaf values and gains are those of the second-order objective with an L2 term. Columns are drawn once for each tree; a row
takes part in a tree if a hash of (seed, tree, key) says so. Sums are whole numbers (gradients in units of 2^-24), so files,
order and number of partitions change nothing once the bins are fixed.

The margin of a row is stored every ``refresh`` trees: lineage stays short, and a lost executor repeats at most the trees
since. A tree's first level makes the gradients of its rows, which its other levels find kept, and the loss on the
validation rows. Fitting ends when it has not improved for ``patience`` rounds; the trees up to the lowest loss are kept.
"""

from __future__ import annotations

import pickle
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector, Vectors
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.schema import KEY, LABEL
from tidewatch.session import drop_table, store
from tidewatch.settings import BoostParams

#: Gradients, Hessians and losses are added up in these units.
UNIT = 2.0**24
LEAST_GAIN = 1e-6
ROWS_PER_TASK = 20_000
#: Rows of a stored file, at most; rows of a block of arrays; partitions whose sums the driver adds up itself.
ROWS_PER_FILE = 500_000
ROWS_PER_BLOCK = 50_000
PARTS_AT_ONCE = 32
ROWS = "h long, y double, w double, held boolean, margin double, codes binary"
#: Nodes whose rows the driver makes at once when it saves a model.
NODES_A_FILE = 500_000
NODES = "tree int, node int, feature int, threshold double, left int, right int, value double, cover double, gain double"
MODEL = "n_features int, losses array<double>, tree_weight double"


class Numbers(array):
    """Numbers without an object for each of them; equal to any sequence of the same numbers."""

    def __eq__(self, other: object) -> bool:
        return list(self) == list(other)

    __hash__ = None


def whole_numbers() -> Numbers:
    return Numbers("i")


def doubles() -> Numbers:
    return Numbers("d")


@dataclass
class Tree:
    """Nodes as parallel columns; feature -1 marks a leaf. A row goes left if its bin is at most ``bin``."""

    feature: Numbers = field(default_factory=whole_numbers)
    bin: Numbers = field(default_factory=whole_numbers)
    threshold: Numbers = field(default_factory=doubles)
    left: Numbers = field(default_factory=whole_numbers)
    right: Numbers = field(default_factory=whole_numbers)
    value: Numbers = field(default_factory=doubles)
    cover: Numbers = field(default_factory=doubles)
    gain: Numbers = field(default_factory=doubles)

    def add(self, value: float, cover: float) -> int:
        for name, x in (("feature", -1), ("bin", -1), ("threshold", 0.0), ("left", -1), ("right", -1), ("value", value),
                        ("cover", cover), ("gain", 0.0)):
            getattr(self, name).append(x)
        return len(self.feature) - 1

    def walk(self, x: np.ndarray, limit: list) -> np.ndarray:
        """The node each row of ``x`` ends in; ``limit`` is ``bin`` for bin numbers or ``threshold`` for values."""
        feature, bound = np.array(self.feature), np.array(limit)
        left, right = np.array(self.left), np.array(self.right)
        flat = np.ascontiguousarray(x).ravel()
        node = np.zeros(len(x), dtype="int64")
        rows = np.arange(len(x) if feature[0] >= 0 else 0)  # those that are not in a leaf
        while len(rows):
            at = node[rows]
            goes = flat.take(rows * x.shape[1] + feature[at]) <= bound[at]
            node[rows] = at = np.where(goes, left[at], right[at])
            rows = rows[feature[at] >= 0]
        return node

    def gains(self, n_features: int) -> np.ndarray:
        """Gain by column."""
        inner = np.array(self.feature) >= 0
        return np.bincount(np.array(self.feature)[inner], weights=np.array(self.gain)[inner], minlength=n_features)


@dataclass
class TreeModel:
    """Trees over binned columns; what they say of a row are sums over their leaves."""

    trees: list[Tree]
    n_features: int
    losses: list[float] = field(default_factory=list)

    @property
    def getNumTrees(self) -> int:  # noqa: N802 - the name used by Spark's ensembles
        return len(self.trees)

    @property
    def tree_weight(self) -> float:
        """What a tree's leaf values are multiplied by."""
        return 1.0

    @property
    def featureImportances(self) -> DenseVector:  # noqa: N802
        """Share of each column in the total gain."""
        total = np.zeros(self.n_features)
        for tree in self.trees:
            total += tree.gains(self.n_features)
        return Vectors.dense(total / (total.sum() or 1.0))

    def margins(self, x: np.ndarray) -> np.ndarray:
        total = sum((np.array(t.value)[t.walk(x, t.threshold)] for t in self.trees), np.zeros(len(x)))
        return total * self.tree_weight

    def with_margins(self, df: DataFrame, name: str) -> DataFrame:
        """Add the sum over all trees. Only the feature array passes through Python."""
        shared = df.sparkSession.sparkContext.broadcast(self)  # trees times nodes

        @F.pandas_udf("double")
        def margin(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for batch in batches:
                x = np.stack(batch.to_numpy()) if len(batch) else np.zeros((0, 1))
                yield pd.Series(shared.value.margins(x), index=batch.index)

        return df.withColumn(name, margin(vector_to_array("features")))

    def save(self, path: str) -> str:
        """Write the nodes of all trees as a table; one row for a model without splits as well.

        A file holds some trees, and the driver makes the rows of one file at a time, as Arrow columns.
        """
        spark = SparkSession.active()
        saved = [c.split()[0] for c in NODES.split(", ")[2:]]
        first = 0
        while first < len(self.trees):
            last, nodes = first + 1, len(self.trees[first].feature)
            while last < len(self.trees) and nodes + len(self.trees[last].feature) <= NODES_A_FILE:
                nodes += len(self.trees[last].feature)
                last += 1
            some = self.trees[first:last]
            sizes = [len(t.feature) for t in some]
            columns = [np.repeat(np.arange(first, last, dtype="int32"), sizes), np.concatenate([np.arange(n, dtype="int32") for n in sizes])]
            columns += [np.concatenate([np.array(getattr(t, c)) for t in some]) for c in saved]
            table = pa.table(columns, names=["tree", "node", *saved])
            spark.createDataFrame(table).coalesce(1).write.mode("append" if first else "overwrite").parquet(f"{path}/nodes")
            first = last
        spark.createDataFrame([(self.n_features, self.losses, self.tree_weight)], MODEL).coalesce(1).write.mode(
            "overwrite").parquet(f"{path}/model")
        return path

    @classmethod
    def load(cls, path: str) -> TreeModel:
        spark = SparkSession.active()
        told = spark.read.parquet(f"{path}/model").first()
        # Compact columns of all trees reach the driver, some tens of bytes a node, and are cut into trees there.
        table = spark.read.schema(NODES).parquet(f"{path}/nodes").toArrow()
        number, node = (table.column(c).to_numpy() for c in ("tree", "node"))
        order = np.lexsort((node, number))
        cuts = np.flatnonzero(np.diff(number[order], prepend=-1)).tolist() + [len(order)]
        trees = [Tree() for _ in cuts[1:]]
        for tree, a, b in zip(trees, cuts, cuts[1:]):
            tree.bin.extend([-1] * (b - a))
        for name in [c.split()[0] for c in NODES.split(", ")[2:]]:
            values = table.column(name).to_numpy()[order]
            for tree, a, b in zip(trees, cuts, cuts[1:]):
                getattr(tree, name).frombytes(np.ascontiguousarray(values[a:b]).tobytes())
        return cls(trees, told.n_features, list(told.losses))


class BoostedModel(TreeModel):
    """Trees whose leaf values add up to the log-odds."""

    def transform(self, df: DataFrame) -> DataFrame:
        """Add ``prediction`` and ``probability`` (of both classes)."""
        p = 1 / (1 + F.exp(-F.col("__tw_margin")))
        return (
            self.with_margins(df, "__tw_margin")
            .withColumn("probability", array_to_vector(F.array(1 - p, p)))
            .withColumn("prediction", (F.col("__tw_margin") > 0).cast("double")).drop("__tw_margin"))


def bin_edges(train: DataFrame, n_features: int, bins: int) -> list[list[float]]:
    """Upper edges of each column's bins but the last: quantiles, or all values where they are few. One aggregate."""
    shares = ", ".join(f"{k / bins!r}D" for k in range(1, bins))
    row = train.select(vector_to_array("features").alias("a")).selectExpr(
        *[f"percentile_approx(a[{i}], array({shares}), {100 * bins}) AS q{i}" for i in range(n_features)],
        *[f"max(a[{i}]) AS m{i}" for i in range(n_features)]).first()
    return [sorted({q for q in row[f"q{i}"] or [] if q < row[f"m{i}"]}) for i in range(n_features)]


def number_lists(column: pa.Array) -> np.ndarray:
    """Lists of equally many numbers as the rows of an array."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def binned(rows: DataFrame, edges: list[list[float]]) -> DataFrame:
    """Bin numbers, label, weight and key hash of every row (KEY, LABEL, weight, held, features)."""
    cuts = [np.array(e) for e in edges]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = number_lists(batch.column(4))
            codes = np.stack([np.searchsorted(c, x[:, i], side="left") for i, c in enumerate(cuts)], axis=1).astype("uint8")
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:4], pa.array(np.zeros(batch.num_rows)), pa.array([c.tobytes() for c in codes], pa.binary())],
                names=["h", "y", "w", "held", "margin", "codes"])

    return rows.select(
        F.xxhash64(KEY).alias("h"), F.col(LABEL).cast("double").alias("y"), F.col("weight").cast("double").alias("w"), "held",
        vector_to_array("features").alias("a")).mapInArrow(run, ROWS)


def mixed(h: np.ndarray, seed: int, tree: int) -> np.ndarray:
    """A number in [0, 1] for each key hash, from a mixed hash of (seed, tree, key)."""
    z = h.view("uint64") ^ np.uint64((seed * 0x9E3779B97F4A7C15 + tree * 0xC2B2AE3D27D4EB4F) % 2**64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
    return (z ^ (z >> np.uint64(31))).astype("float64") / 2.0**64


def sampled(h: np.ndarray, seed: int, tree: int, share: float) -> np.ndarray:
    """Whether a row takes part in a tree."""
    return mixed(h, seed, tree) < share


@dataclass(frozen=True)
class Layout:
    """Columns as the executors keep them: one byte for each wide column, and one for columns of which at most one is 1."""

    wide: list[int]
    bundles: list[list[int]]
    #: Bins of each of these.
    sizes: list[int]

    def places(self) -> dict[int, tuple[int, int]]:
        """(byte, number in its bundle or 0) of each column."""
        found = {c: (j, 0) for j, c in enumerate(self.wide)}
        return found | {c: (len(self.wide) + j, k) for j, bundle in enumerate(self.bundles) for k, c in enumerate(bundle, 1)}

    def packed(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate(
            [codes[:, self.wide]] + [(codes[:, b] @ np.arange(1, len(b) + 1, dtype="uint8"))[:, None] for b in self.bundles], axis=1, dtype="uint8")

    def walk(self, tree: Tree, codes: np.ndarray) -> np.ndarray:
        """The node each packed row ends in. It goes right where its byte is one of ``low`` to ``low + span``."""
        n, places = len(tree.feature), self.places()
        byte, base, level = np.zeros(n, dtype="int64"), np.arange(n) - 1, [0] * n  # a leaf stays where it is
        low, span = np.zeros(n, dtype="uint8"), np.full(n, 255, dtype="uint8")
        for node, (column, at) in enumerate(zip(tree.feature, tree.bin)):
            if column >= 0:
                byte[node], number = places[column]
                low[node], span[node] = (number, 0) if number else (at + 1, 254 - at)
                base[node] = tree.left[node]
                level[tree.left[node]] = level[tree.right[node]] = level[node] + 1
        flat, row = codes.ravel(), np.arange(len(codes)) * codes.shape[1]
        node = np.zeros(len(codes), dtype="int64")
        for _ in range(max(level)):
            node = base[node] + (flat.take(row + byte[node]) - low[node] <= span[node])
        return node

    def groups(self, columns: list[int]) -> list[int]:
        """The bytes that hold some columns."""
        places = self.places()
        return sorted({places[c][0] for c in columns})

    def unfolded(self, sums: np.ndarray, columns: list[int], bins: int) -> np.ndarray:
        """(2, nodes, columns, bins) of the sums over the bytes of these columns, (2, nodes, bins there are)."""
        groups, places = self.groups(columns), self.places()
        start = dict(zip(groups, np.cumsum([0] + [self.sizes[g] for g in groups]).tolist()))
        out = np.zeros((*sums.shape[:2], len(columns), bins), dtype="int64")
        for j, column in enumerate(columns):
            byte, number = places[column]
            part = sums[:, :, start[byte]:start[byte] + self.sizes[byte]]
            if number:
                out[:, :, j, 1] = part[:, :, number]
                out[:, :, j, 0] = part.sum(axis=2) - part[:, :, number]
            else:
                out[:, :, j, :part.shape[2]] = part
        return out


def code_rows(batch: pa.RecordBatch) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column(5).to_pylist()), dtype="uint8").reshape(batch.num_rows, -1)


def layout(table: DataFrame, edges: list[list[float]]) -> Layout:
    """Which columns of two bins are never both 1: they are bundled in order of column."""
    wide, narrow = ([i for i, e in enumerate(edges) if e and (len(e) > 1) == many] for many in (True, False))

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(narrow), len(narrow)), dtype="int64")
        for batch in batches:
            if batch.num_rows:
                ones = code_rows(batch)[:, narrow].astype("float64")
                total += (ones.T @ ones).astype("int64")
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["met"])

    both = sum((np.frombuffer(r["met"], dtype="int64") for r in table.mapInArrow(met, "met binary").collect()), np.zeros(len(narrow) ** 2, dtype="int64"))
    both = both.reshape(len(narrow), len(narrow))
    bundles: list[list[int]] = []
    for i in range(len(narrow)):
        for bundle in bundles:
            if len(bundle) < 255 and not both[i, bundle].any():
                bundle.append(i)
                break
        else:
            bundles.append([i])
    return Layout(wide, [[narrow[i] for i in b] for b in bundles], [len(edges[c]) + 1 for c in wide] + [len(b) + 1 for b in bundles])


#: Rows of a partition as arrays: key hash, label, weight, held, stored margin, packed columns.
Block = tuple[np.ndarray, ...]


def blocks(table: DataFrame, form: Layout) -> RDD:
    """The binned rows as arrays in blocks, kept by the executors."""
    def block(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        h, y, w, held, margin = (np.concatenate([b.column(i).to_numpy(zero_copy_only=False) for b in batches]) for i in range(5))
        codes = np.concatenate([form.packed(code_rows(b)) for b in batches])
        return pa.RecordBatch.from_arrays(
            [pa.array([pickle.dumps((h, y, w, held.astype(bool), margin, codes), protocol=5)], pa.binary())], names=["block"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some: list[pa.RecordBatch] = []
        for batch in batches:
            if batch.num_rows:
                some.append(batch)
            if sum(b.num_rows for b in some) >= ROWS_PER_BLOCK:
                yield block(some)
                some = []
        if some:
            yield block(some)

    return table.mapInArrow(packed, "block binary").rdd.map(lambda r: pickle.loads(bytes(r.block))).persist(StorageLevel.MEMORY_AND_DISK)


#: Rows that take part in a tree: packed columns, gradients and Hessians in units; validation loss of the block, its rows.
Ready = tuple[np.ndarray, np.ndarray, np.ndarray, int, int]


def ready(rows: RDD, form: Layout, pending: list[Tree], number: int, params: BoostParams) -> RDD:
    """The rows of a tree, kept for its levels; ``pending`` are the trees since margins were stored."""
    def made(block: Block) -> Ready:
        h, y, w, held, margin, codes = block
        since = np.zeros(len(h))
        for tree in pending:
            since = since + np.array(tree.value)[form.walk(tree, codes)]
        p = 1 / (1 + np.exp(-(margin + since)))
        safe = np.clip(p[held], 1e-16, 1 - 1e-16)
        loss = int(np.rint(-UNIT * np.where(y[held] > 0, np.log(safe), np.log1p(-safe))).sum())
        mine = np.flatnonzero(~held & sampled(h, params.seed, number, params.row_sample))
        parts = np.rint(UNIT * np.stack([(p - y) * w, np.maximum(p * (1 - p), 1e-16) * w])[:, mine])
        if not len(mine) or np.abs(parts).max() < 2**31:
            parts = parts.astype("int32")
        return codes.take(mine, axis=0), *parts, loss, int(held.sum())

    return rows.map(made).persist(StorageLevel.MEMORY_AND_DISK)


def refreshed(table: DataFrame, pending: list[Tree]) -> DataFrame:
    """The stored rows with the trees grown since in their margins."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                codes = code_rows(batch)
                since = sum((np.array(t.value)[t.walk(codes, t.bin)] for t in pending), np.zeros(batch.num_rows))
                yield batch.set_column(4, "margin", pa.array(batch.column(4).to_numpy() + since))

    return table.mapInArrow(run, ROWS)


@dataclass(frozen=True)
class Pass:
    """What a task needs for one level: the tree so far and the nodes whose rows are added up."""

    tree: Tree
    asked: list[int]
    columns: list[int]
    bins: int
    form: Layout

    def sums(self, rows: Iterator[Ready]) -> Iterator[tuple[np.ndarray, int, int]]:
        """(sums of gradients and Hessians for each node and bin of a byte, validation loss, its rows) of a partition."""
        groups = self.form.groups(self.columns)
        ends = np.cumsum([0] + [self.form.sizes[g] for g in groups]).tolist()
        total = np.zeros((2, len(self.asked), ends[-1]), dtype="int64")
        loss = n = 0
        slot_of = np.full(len(self.tree.feature), -1)
        slot_of[self.asked] = np.arange(len(self.asked))
        for codes, *parts, block_loss, held in rows:
            loss, n = loss + block_loss, n + held
            slot = slot_of[self.form.walk(self.tree, codes)]
            if len(self.asked) < len(self.tree.feature):
                at = np.flatnonzero(slot >= 0)
                slot, codes, parts = slot[at], codes.take(at, axis=0), [p[at] for p in parts]
            parts = [p.astype("float64") for p in parts]
            for group, a, b in zip(groups, ends, ends[1:]):
                place = slot * (b - a) + codes[:, group]
                for k in (0, 1):  # whole numbers below 2^53 are added exactly
                    found = np.bincount(place, weights=parts[k], minlength=len(self.asked) * (b - a))
                    total[k, :, a:b] += found.reshape(-1, b - a).astype("int64")
        yield total, loss, n


def level_sums(rows: RDD, step: Pass) -> tuple[np.ndarray, float | None]:
    """((2, nodes, columns, bins) sums of a level in units of 1 / UNIT, validation loss or None)."""
    parts = rows.mapPartitions(step.sums)
    # The sums of many tasks are added up in executors first: the driver gets the square root of their number.
    add_up = parts.reduce if rows.getNumPartitions() <= PARTS_AT_ONCE else parts.treeReduce
    total, loss, n = add_up(lambda a, b: tuple(x + y for x, y in zip(a, b)))
    return step.form.unfolded(total, step.columns, step.bins), loss / UNIT / n if n else None


def all_sums(rows: RDD, step: Pass, open_nodes: list[int], above: np.ndarray | None, parents: list[int]) -> tuple[np.ndarray, float | None]:
    """The sums of all open nodes. Of two siblings only the lighter one's rows are added up; the other has what is left
    of its parent's sums (``above``, at the place in ``parents``), exactly, as all are whole numbers."""
    if above is None:
        return level_sums(rows, replace(step, asked=open_nodes))
    cover = step.tree.cover
    lighter = [k + int(cover[open_nodes[k + 1]] < cover[open_nodes[k]]) for k in range(0, len(open_nodes), 2)]
    found, loss = level_sums(rows, replace(step, asked=[open_nodes[k] for k in lighter]))
    out = np.empty((2, len(open_nodes), *found.shape[2:]), dtype="int64")
    out[:, lighter] = found
    out[:, [k ^ 1 for k in lighter]] = above[:, parents] - found
    return out, loss


def best_splits(sums: np.ndarray, params: BoostParams) -> list[tuple[float, int, int, tuple, tuple] | None]:
    """For each node (gain, column place, bin, (G, H) left, (G, H) right) of its best split, or nothing."""
    left = np.cumsum(sums, axis=3)
    whole = left[:, :, :1, -1:]
    right = whole - left

    def value(part: np.ndarray) -> np.ndarray:
        return part[0] ** 2 / (part[1] + params.l2)

    with np.errstate(invalid="ignore", divide="ignore"):  # empty children without an L2 term; ruled out below
        gain = (value(left) + value(right) - value(whole)) / 2
    gain[(left[1] < params.least_hessian) | (right[1] < params.least_hessian)] = -np.inf
    out = []
    for n in range(sums.shape[1]):
        column, place = np.unravel_index(int(gain[n].argmax()), gain[n].shape)  # the first of equal ones
        best = float(gain[n, column, place])
        out.append(None if best <= LEAST_GAIN else (
            best, int(column), int(place), tuple(left[:, n, column, place]), tuple(right[:, n, column, place])))
    return out


def leaf(part: tuple[float, float], params: BoostParams) -> float:
    return float(-params.rate * part[0] / (part[1] + params.l2))


def grow(
    rows: RDD, number: int, edges: list[list[float]], params: BoostParams, goes_on: Callable[[float | None], bool], form: Layout
) -> Tree | None:
    """One tree. Its first level also gives the validation loss of the model before it; ``goes_on`` says what that means."""
    usable = [i for i, e in enumerate(edges) if e]
    rng = np.random.default_rng([params.seed, number])
    columns = sorted(rng.choice(usable, max(1, round(params.column_sample * len(usable))), replace=False).tolist()) if usable else []
    tree = Tree()
    tree.add(0.0, 0.0)
    step = Pass(tree, [], columns, params.bins, form)
    open_nodes, whole, parents = [0], None, []
    for depth in range(params.depth):
        whole, told = all_sums(rows, step, open_nodes, whole, parents)
        sums = whole / UNIT
        if depth == 0:
            if not goes_on(told):
                return None
            if not columns:
                break
            root = sums[:, 0, 0].sum(axis=1)
            tree.value[0], tree.cover[0] = leaf(root, params), float(root[1])
        grown, parents = [], []
        for place, (node, split) in enumerate(zip(open_nodes, best_splits(sums, params))):
            if split is None:
                continue
            tree.gain[node], column, tree.bin[node], left, right = split
            tree.feature[node] = columns[column]
            tree.threshold[node] = edges[columns[column]][tree.bin[node]]
            tree.left[node], tree.right[node] = (tree.add(leaf(part, params), float(part[1])) for part in (left, right))
            grown += [tree.left[node], tree.right[node]]
            parents.append(place)
        open_nodes = grown
        if not open_nodes:
            break
    return tree


def fit(train: DataFrame, validation: DataFrame, params: BoostParams = BoostParams()) -> BoostedModel:
    """Fit on ``train`` (KEY, LABEL, weight, features) and stop by the log-loss on ``validation``."""
    wanted = [KEY, LABEL, F.col("weight"), "features"]
    first = train.select(F.size(vector_to_array("features"))).first()
    if first is None:
        raise ValueError("no training rows")
    if not 2 <= params.bins <= 256:
        raise ValueError("bins must be between 2 and 256")
    edges = bin_edges(train, first[0], params.bins)
    rows = train.select(*wanted, F.lit(False).alias("held")).unionByName(
        validation.withColumn("weight", F.lit(1.0)).select(*wanted, F.lit(True).alias("held")))
    spark = train.sparkSession
    # A task reads about ``ROWS_PER_TASK`` rows in every level: fewer would spend their time on starting.
    # A number of larger files that the cores divide, so that as many tasks read equal shares of them.
    n_rows, cores = rows.count() or 1, spark.sparkContext.defaultParallelism
    parts = min(-(-n_rows // ROWS_PER_TASK), cores * -(-n_rows // (cores * ROWS_PER_FILE)))
    path = store(binned(rows, edges).repartition(parts, "h"), "binned")

    def table() -> DataFrame:
        return spark.read.schema(ROWS).parquet(path)

    trees: list[Tree] = []
    losses: list[float] = []
    stored = 0

    def goes_on(loss: float | None) -> bool:
        if trees and loss is not None:
            losses.append(loss)
        patient = not losses or len(losses) - 1 - losses.index(min(losses)) < params.patience
        return patient and len(trees) < params.rounds

    form = layout(table(), edges)
    kept = blocks(table(), form)
    while True:
        mine = ready(kept, form, trees[stored:], len(trees), params)
        tree = grow(mine, len(trees), edges, params, goes_on, form)
        mine.unpersist()
        if tree is None:
            break
        trees.append(tree)
        if len(trees) - stored >= params.refresh:
            old, path = path, store(refreshed(table(), trees[stored:]), "binned")
            drop_table(spark, old)
            kept.unpersist()
            kept = blocks(table(), form)
            stored = len(trees)
    kept.unpersist()
    drop_table(spark, path)
    return BoostedModel(trees[: losses.index(min(losses)) + 1] if losses else trees, first[0], losses)
