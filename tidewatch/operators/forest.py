"""Random forest on binned columns: many trees grown together, level by level.

How often a row is in a tree's bootstrap sample is a Poisson number drawn from a hash of (seed, tree, key), and the
columns a node may use are drawn from (seed, tree, node). Nothing depends on where a row lies: files, order and
partitions change no tree, bin edges included, which come from counts of value cells that add up in any order.

Where a tree's sample fits a task, its rows are sent there once, packed, and the task grows the whole tree: the driver gets
its nodes. Larger trees grow level by level. A pass takes open nodes of a level over all trees. Of nodes with many rows, as many as ``cells`` allows, each task adds up
rows and weights by (node, column, bin) of the rows it reads, as whole numbers; one shuffle by node adds up the tasks, and
the best split is found where a node's sums meet. Sums of a small node would be nearly as many as its rows times columns in
every task, so its rows themselves are sent, packed by groups of nodes, and added up there. The driver gets one row for each
node.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector, Vectors
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.operators.boosting import ROWS, UNIT, Tree, TreeModel, binned, code_rows, mixed, number_lists
from tidewatch.schema import KEY, LABEL
from tidewatch.session import drop_table, store
from tidewatch.settings import ForestParams

#: Gain for each unit of weight below which a node stays a leaf.
LEAST_GAIN = 1e-9
ROWS_PER_TASK = 4_000
CELLS_PER_TASK = 500_000
#: Rows of small nodes that meet in a group, that a pass sends, and that a task holds before it hands them on. A larger
#: node is added up where its rows lie.
ROWS_PER_GROUP = 250_000
ROWS_PER_PASS = 40_000_000
ROWS_HELD = 1_000_000
#: Groups of rows that a task takes of a whole tree, and kinds of rows (label, weight) that it counts apart.
GROUPS_PER_TREE = 16
KINDS = 4
#: Rows that a task works on at once, and rows and tasks for each core that a whole pass is dealt out to.
ROWS_AT_ONCE = 1 << 13
ROWS_PER_PART = 1_000_000
PARTS_PER_CORE = 4
#: Distribution function of a Poisson number with mean 1.
POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(16)])
#: Bits of a double that tell value cells apart: sign, exponent and 8 bits of the fraction.
CELL_SHIFT = 64 - 20
SUMS = "slot int, cell int, n long, w long, y long"
PACKED = "bucket int, rows binary"
SAMPLES = "part int, tree int, rows binary"
#: Columns of a tree, as bytes.
FIELDS = ["feature", "bin", "threshold", "left", "right", "value", "cover", "gain"]
GROWN = ", ".join(["tree int", *[f"{c} binary" for c in FIELDS]])
SPLITS = "slot int, place int, bin int, gain double, n_left long, w_left long, y_left long, n long, w long, y long"


class ForestModel(TreeModel):
    """Trees whose leaves hold the weighted share of churned rows; the forest says their mean."""

    @property
    def tree_weight(self) -> float:
        return 1.0 / len(self.trees)

    @property
    def featureImportances(self) -> DenseVector:  # noqa: N802 - the name used by Spark's ensembles
        """Mean over the trees of each column's share in the tree's gain."""
        total = np.zeros(self.n_features)
        for tree in self.trees:
            gains = tree.gains(self.n_features)
            total += gains / (gains.sum() or 1.0)
        return Vectors.dense(total / (total.sum() or 1.0))

    def transform(self, df: DataFrame) -> DataFrame:
        """Add ``prediction`` and ``probability`` (of both classes)."""
        p = F.least(F.col("__tw_share"), F.lit(1.0))
        return (
            self.with_margins(df, "__tw_share")
            .withColumn("probability", array_to_vector(F.array(1 - p, p)))
            .withColumn("prediction", (p > 0.5).cast("double")).drop("__tw_share"))


def drawn(h: np.ndarray, seed: int, tree: int) -> np.ndarray:
    """How often each row is in a tree's bootstrap sample."""
    return np.searchsorted(POISSON, mixed(h, seed, tree), side="right")


def value_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(feature, cell, n, top): rows and largest value by cell of neighbouring values; cells are ordered like values."""
    for batch in batches:
        if not batch.num_rows:
            continue
        x = number_lists(batch.column(0)) + 0.0  # -0.0 is 0.0
        bits = x.view("int64")
        cells = (bits ^ ((bits >> 63) & np.int64(2**63 - 1))) >> CELL_SHIFT
        for i in range(x.shape[1]):
            known, at, n = np.unique(cells[:, i], return_inverse=True, return_counts=True)
            top = np.full(len(known), -np.inf)
            np.maximum.at(top, at, x[:, i])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(known), i, dtype="int32")), pa.array(known), pa.array(n), pa.array(top)],
                names=["feature", "cell", "n", "top"])


def bin_edges(train: DataFrame, n_features: int, bins: int) -> list[list[float]]:
    """Upper edges of each column's bins but the last: every cell where there are at most ``bins``, else quantiles.

    Cells are counted, not sketched, so the edges are the same for any order of the rows. A column has about a
    thousand occupied cells for each power of two its values span, whatever their number.
    """
    cells = train.select(vector_to_array("features").alias("a")).mapInArrow(
        value_cells, "feature int, cell long, n long, top double").groupBy("feature", "cell").agg(
        F.sum("n").alias("n"), F.max("top").alias("top"))
    column = Window.partitionBy("feature")
    upto = F.sum("n").over(column.orderBy("cell"))
    counted = cells.select(
        "feature", "top", "n", upto.alias("upto"), F.sum("n").over(column).alias("rows"), F.count(F.lit(1)).over(column).alias("cells"))
    part = lambda rows: F.floor(rows * F.lit(bins) / F.col("rows"))
    edges = counted.filter("upto < rows").filter((F.col("cells") <= bins) | (part(F.col("upto")) > part(F.col("upto") - F.col("n"))))
    found: list[list[float]] = [[] for _ in range(n_features)]
    for r in edges.select("feature", "top").collect():  # fewer than ``bins`` a column
        found[r["feature"]].append(r["top"])
    return [sorted(e) for e in found]


def outline(tree: Tree) -> Tree:
    """What a task needs of a tree to find a row's node."""
    return Tree(*(np.array(x, dtype="int32") for x in (tree.feature, tree.bin)), [], *(np.array(x, dtype="int32") for x in (tree.left, tree.right)))


@dataclass(frozen=True)
class Level:
    """What a task needs for one pass: the trees so far, the open nodes in order of tree, and the columns of each."""

    trees: dict[int, Tree]
    nodes: np.ndarray
    columns: np.ndarray
    bins: int
    seed: int
    #: The group of each open node, where rows are sent.
    groups: np.ndarray | None = None

    def met(self, batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(first slot, last slot, rows, their slot after the first, times drawn, codes of the slot's columns) by tree."""
        owner = self.nodes[:, 0]
        h = batch.column(0).to_numpy(zero_copy_only=False)
        codes = code_rows(batch)
        for number, tree in self.trees.items():
            first, last = (int(np.searchsorted(owner, number, side=side)) for side in ("left", "right"))
            slot_of = np.full(len(tree.feature), -1)
            slot_of[self.nodes[first:last, 1]] = np.arange(last - first)
            times = drawn(h, self.seed, number)
            rows = np.flatnonzero(times)
            slot = slot_of[tree.walk(codes[rows], tree.bin)]
            rows, slot = rows[slot >= 0], slot[slot >= 0]
            yield first, last, rows, slot, times[rows], codes[rows[:, None], self.columns[first + slot]]

    def rows(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(bucket, rows): the rows in open nodes, one packed array for each group of nodes."""
        held, n = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            y, w = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
            unit = np.rint(UNIT * w)
            for first, _, rows, slot, times, codes in self.met(batch):
                part = np.empty(len(rows), dtype=row_type(codes.shape[1]))
                part["slot"], part["n"], part["w"], part["y"], part["codes"] = first + slot, times, unit[rows], y[rows], codes
                held.append(part)
                n += len(part)
                if n >= ROWS_HELD:
                    yield self.packed(held)
                    held, n = [], 0
        if n:
            yield self.packed(held)

    def packed(self, parts: list[np.ndarray]) -> pa.RecordBatch:
        together = np.concatenate(parts)
        bucket = self.groups[together["slot"]]
        order = np.argsort(bucket, kind="stable")
        known, start = np.unique(bucket[order], return_index=True)
        return pa.RecordBatch.from_arrays(
            [pa.array(known, pa.int32()), pa.array([x.tobytes() for x in np.split(together[order], start[1:])], pa.binary())],
            names=["bucket", "rows"])

    def sums(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(slot, cell, n, w, y): rows, weight and weight of churned rows by open node and (column, bin)."""
        places = np.arange(self.columns.shape[1])
        width = len(places) * self.bins
        total = np.zeros((3, len(self.nodes) * width), dtype="int64")
        for batch in batches:
            if not batch.num_rows:
                continue
            y, w = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
            unit = np.rint(UNIT * w)
            for first, last, rows, slot, times, codes in self.met(batch):
                span = slice(first * width, last * width)
                total[:, span] += added(slot, times, unit[rows], y[rows], codes, last - first, self.bins)
        there = np.flatnonzero(total[0])
        for start in range(0, len(there), 100_000):
            at = there[start:start + 100_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array((at // width).astype("int32")), pa.array((at % width).astype("int32")), *[pa.array(t[at]) for t in total]],
                names=["slot", "cell", "n", "w", "y"])


def row_type(columns: int) -> np.dtype:
    """A row of an open node: slot, times drawn, weight in units, label, and the codes of the node's columns."""
    return np.dtype([("slot", "i4"), ("n", "u1"), ("w", "f8"), ("y", "f8"), ("codes", "u1", (columns,))])


def added(slot: np.ndarray, times: np.ndarray, unit: np.ndarray, y: np.ndarray, codes: np.ndarray, slots: int, bins: int) -> np.ndarray:
    """(n, w, y) by (slot, column, bin): whole numbers below 2^53 are added exactly."""
    columns = codes.shape[1]
    place = ((slot[:, None] * columns + np.arange(columns)) * bins + codes).ravel()
    weight = times * unit
    return np.stack([
        np.bincount(place, weights=np.repeat(part, columns), minlength=slots * columns * bins).astype("int64")
        for part in (times, weight, weight * y)])


@dataclass(frozen=True)
class Packing:
    """Rows as bytes: times drawn and kind together, a byte for each column with many bins, a bit for one with two."""

    kinds: list[tuple[float, float]]
    n_features: int
    bins: int
    wide: list[int]
    narrow: list[int]

    def packed(self, kind: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Rows with times 0."""
        return np.hstack([kind[:, None], codes[:, self.wide], np.packbits(codes[:, self.narrow], axis=1)])

    def unpacked(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(times drawn, codes counted in kinds: code * kinds + kind)."""
        kinds = len(self.kinds)
        times, kind = np.divmod(rows[:, 0], np.uint8(kinds))
        codes = np.zeros((len(rows), self.n_features), dtype="uint8" if self.bins * kinds <= 256 else "uint16")
        codes[:, self.wide] = rows[:, 1:1 + len(self.wide)]
        codes[:, self.narrow] = np.unpackbits(rows[:, 1 + len(self.wide):], axis=1, count=len(self.narrow))
        codes *= codes.dtype.type(kinds)
        codes += kind[:, None]
        return times, codes

    @property
    def width(self) -> int:
        return 1 + len(self.wide) + -(-len(self.narrow) // 8)


@dataclass(frozen=True)
class Samples:
    """The rows drawn into some trees, each sent to its tree's part."""

    packing: Packing
    parts: dict[int, int]
    seed: int

    def rows(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {tree: [] for tree in self.parts}
        n = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            h, y, w = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            kind = np.zeros(batch.num_rows, dtype="uint8")
            for k, (label, weight) in enumerate(self.packing.kinds):
                kind[(y == label) & (w == weight)] = k
            rows = self.packing.packed(kind, code_rows(batch))
            for tree, parts in held.items():
                times = drawn(h, self.seed, tree)
                there = np.flatnonzero(times)
                part = rows[there]
                part[:, 0] += times[there].astype("uint8") * np.uint8(len(self.packing.kinds))
                parts.append(part)
                n += len(there)
            if n >= ROWS_HELD:
                yield self.sent(held)
                held, n = {tree: [] for tree in self.parts}, 0
        if n:
            yield self.sent(held)

    def sent(self, held: dict[int, list[np.ndarray]]) -> pa.RecordBatch:
        trees = list(held)
        return pa.RecordBatch.from_arrays(
            [pa.array([self.parts[t] for t in trees], pa.int32()), pa.array(trees, pa.int32()),
             pa.array([b"".join(map(np.ndarray.tobytes, held[t])) for t in trees], pa.binary())], names=["part", "tree", "rows"])


@dataclass(frozen=True)
class Search:
    """The best split of nodes by their sums over (column, bin)."""

    columns: int
    bins: int
    min_leaf: int

    def splits(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The best split of every node whose sums lie in this partition; bin -1 where there is none."""
        parts = [[batch.column(i).to_numpy() for i in range(5)] for batch in batches if batch.num_rows]
        if not parts:
            return
        slot, cell, *sums = (np.concatenate(p) for p in zip(*parts))
        known, at = np.unique(slot, return_inverse=True)
        total = np.zeros((3, len(known) * self.columns * self.bins), dtype="int64")
        total[:, at.astype("int64") * (self.columns * self.bins) + cell] = sums
        yield self.best(known, total)

    def row_splits(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The best split of every node whose rows lie in this partition, a stretch of nodes at a time."""
        packed = [x for batch in batches for x in batch.column(1).to_pylist()]
        if not packed:
            return
        rows = np.frombuffer(b"".join(packed), dtype=row_type(self.columns))
        del packed
        rows = rows[np.argsort(rows["slot"], kind="stable")]
        known, start = np.unique(rows["slot"], return_index=True)
        ends = np.append(start, len(rows))
        step = max(1, CELLS_PER_TASK // (self.columns * self.bins))
        for a in range(0, len(known), step):
            b = min(a + step, len(known))
            some = rows[ends[a]:ends[b]]
            at = np.repeat(np.arange(b - a), np.diff(ends[a:b + 1]))
            yield self.best(known[a:b], added(at, some["n"], some["w"], some["y"], some["codes"], b - a, self.bins))

    def best(self, known: np.ndarray, total: np.ndarray) -> pa.RecordBatch:
        left = np.cumsum(total.reshape(3, len(known), self.columns, self.bins), axis=3)
        whole = left[:, :, :1, -1:]
        gain = gains(left, whole, self.min_leaf).reshape(len(known), -1)
        best = gain.argmax(axis=1)  # the first of equal ones
        rows, (column, place) = np.arange(len(known)), np.divmod(best, self.bins)
        told = np.where(np.isfinite(gain[rows, best]), place, -1)
        return pa.RecordBatch.from_arrays(
            [pa.array(known, pa.int32()), pa.array(column.astype("int32")), pa.array(told.astype("int32")), pa.array(gain[rows, best]),
             *[pa.array(left[k, rows, column, place]) for k in range(3)], *[pa.array(whole[k, :, 0, 0]) for k in range(3)]],
            names=[c.split()[0] for c in SPLITS.split(", ")])


def gains(left: np.ndarray, whole: np.ndarray, min_leaf: int) -> np.ndarray:
    """Fall of the weighted Gini impurity for (n, w, y) left of a split, -inf where the split is not allowed."""
    def purity(part: np.ndarray) -> np.ndarray:
        w, y = part[1] / UNIT, part[2] / UNIT
        return (y * y + (w - y) * (w - y)) / w

    right = whole - left
    with np.errstate(invalid="ignore", divide="ignore"):  # sides without weight, ruled out below
        gain = purity(left) + purity(right) - purity(whole)
    allowed = (left[0] >= max(1, min_leaf)) & (right[0] >= max(1, min_leaf)) & (left[1] > 0) & (right[1] > 0)
    return np.where(allowed & (gain > LEAST_GAIN * whole[1] / UNIT), gain, -np.inf)


@dataclass(frozen=True)
class Grower:
    """Grows whole trees from their samples, level by level like ``fit``."""

    packing: Packing
    edges: list[list[float]]
    usable: list[int]
    size: int
    params: ForestParams

    def trees(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: dict[int, list[bytes]] = {}
        for batch in batches:
            for tree, rows in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                sent.setdefault(tree, []).append(rows)
        for number in sorted(sent):
            rows = np.frombuffer(b"".join(sent.pop(number)), dtype="uint8").reshape(-1, self.packing.width)
            if len(rows):
                tree = self.grown(number, *self.packing.unpacked(rows))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number], pa.int32()), *[pa.array([getattr(tree, c).tobytes()], pa.binary()) for c in FIELDS]],
                    names=["tree", *FIELDS])

    def grown(self, number: int, times: np.ndarray, codes: np.ndarray) -> Tree:
        """A tree; rows lie in the order of their open nodes, those in leaves are left out."""
        kinds = len(self.packing.kinds)
        tree = Tree()
        tree.add(0.5, 0.0)
        nodes, ends = np.array([0]), np.array([0, len(times)])
        for _ in range(self.params.depth):
            columns = node_columns(self.usable, self.size, self.params.seed, np.stack([np.full(len(nodes), number), nodes], axis=1))
            found = self.found(columns, ends, times, codes)
            child, _ = enter(tree, nodes, columns, self.edges, found, self.params.min_leaf)
            if not len(child):
                break
            slot_of = np.full(len(tree.feature) + 1, -1)  # -1, no child, is the last one
            slot_of[child] = np.arange(len(child))
            to = np.stack([slot_of[np.array(side)[nodes]] for side in (tree.left, tree.right)], axis=1).ravel()
            rows, slots = [], []
            split, limit = columns[np.arange(len(nodes)), found["place"]], (found["bin"] + 1) * kinds
            for a, b, first, last in stretches(ends, len(nodes)):
                at = np.repeat(np.arange(a, b), np.minimum(ends[a + 1:b + 1], last) - np.maximum(ends[a:b], first))
                goes = codes[first:last].ravel().take(np.arange(last - first) * codes.shape[1] + split[at]) >= limit[at]
                slot = to[2 * at + goes]
                stays = np.flatnonzero(slot >= 0)
                rows.append(first + stays)
                slots.append(slot[stays])
            slot = np.concatenate(slots)
            order = np.concatenate(rows)[np.argsort(slot.astype("uint16") if len(child) <= 1 << 16 else slot, kind="stable")]
            times, codes = times[order], codes.take(order, axis=0)
            nodes, ends = child, np.append(0, np.cumsum(np.bincount(slot, minlength=len(child))))
        return tree

    def found(self, columns: np.ndarray, ends: np.ndarray, times: np.ndarray, codes: np.ndarray) -> dict[str, np.ndarray]:
        """The best split of every open node."""
        bins, kinds, n_columns = self.params.bins, len(self.packing.kinds), columns.shape[1]
        search = Search(n_columns, bins, self.params.min_leaf)
        unit = np.array([np.rint(UNIT * w) for _, w in self.packing.kinds])
        factors = np.stack([np.ones(kinds), unit, unit * [y for y, _ in self.packing.kinds]]).astype("int64")
        told = []
        step = max(1, CELLS_PER_TASK // (n_columns * bins))
        for low in range(0, len(columns), step):
            high = min(low + step, len(columns))
            counts = np.zeros((n_columns, (high - low) * bins * kinds))
            for a, b, first, last in stretches(ends[low:high + 1], high - low):
                held = np.minimum(ends[low + a + 1:low + b + 1], last) - np.maximum(ends[low + a:low + b], first)
                weight = times[first:last].astype("float64")
                if b - a == 1:  # a large node
                    for j, column in enumerate(columns[low + a].tolist()):
                        counts[j, a * bins * kinds:b * bins * kinds] += np.bincount(codes[first:last, column], weights=weight, minlength=bins * kinds)
                    continue
                flat, row = codes[first:last].ravel(), np.arange(last - first) * codes.shape[1]
                base = np.repeat(np.arange(b - a) * (bins * kinds), held)
                for j in range(n_columns):
                    place = base + flat.take(row + np.repeat(columns[low + a:low + b, j], held))
                    counts[j, a * bins * kinds:b * bins * kinds] += np.bincount(place, weights=weight, minlength=(b - a) * bins * kinds)
            counts = counts.astype("int64").reshape(n_columns, high - low, bins, kinds).transpose(1, 0, 2, 3)
            total = np.stack([sum(f[k] * counts[..., k] for k in range(kinds)) for f in factors])
            told.append(search.best(np.arange(low, high), total))
        table = pa.Table.from_batches(told)
        return {c: table.column(c).to_numpy() for c in table.column_names}


def stretches(ends: np.ndarray, nodes: int) -> Iterator[tuple[int, int, int, int]]:
    """(first node, last node, first row, last row) of stretches of rows that are worked on at once."""
    for first in range(int(ends[0]), int(ends[-1]), ROWS_AT_ONCE):
        last = min(first + ROWS_AT_ONCE, int(ends[-1]))
        yield int(np.searchsorted(ends, first, side="right")) - 1, int(np.searchsorted(ends, last, side="left")), first, last


def columns_a_node(subset: str, n_features: int) -> int:
    sizes = {"all": n_features, "sqrt": math.ceil(math.sqrt(n_features)), "log2": math.ceil(math.log2(max(2, n_features))),
             "onethird": math.ceil(n_features / 3)}
    if subset not in sizes:
        raise ValueError(f"feature_subset must be one of {sorted(sizes)}")
    return sizes[subset]


def node_columns(usable: list[int], size: int, seed: int, nodes: np.ndarray) -> np.ndarray:
    """The columns each (tree, node) may split: the first ``size`` by a mixed hash of (seed, tree, node, column)."""
    tree, node = nodes.astype("uint64").T
    key = ((tree << np.uint64(32)) + node)[:, None] * np.uint64(0x9E3779B97F4A7C15) + np.array(usable, dtype="uint64") * np.uint64(0xC2B2AE3D27D4EB4F)
    order = np.argsort(mixed(key.view("int64"), seed, -1), axis=1, kind="stable")
    return np.array(usable)[np.sort(order[:, :size], axis=1)]


def enter(tree: Tree, nodes: np.ndarray, columns: np.ndarray, edges: list[np.ndarray], found: dict[str, np.ndarray], min_leaf: int) -> list[np.ndarray]:
    """Enter what was found of a tree's open nodes; returns the children that are open in turn, and their rows."""
    if nodes[0] == 0:
        tree.value[0], tree.cover[0] = found["y"][0] / found["w"][0] if found["w"][0] else 0.5, found["w"][0] / UNIT
    cut = np.flatnonzero(found["bin"] >= 0)
    size, nodes = len(tree.feature), nodes[cut]
    feature, place = columns[cut, found["place"][cut]], found["bin"][cut]
    sides = [np.stack([found[f"{c}_left"][cut], found[c][cut] - found[f"{c}_left"][cut]], axis=1).ravel() for c in "nwy"]
    child = size + np.arange(2 * len(cut))
    threshold = [edges[f][b] for f, b in zip(feature.tolist(), place.tolist())]
    for name, values in (("feature", feature), ("bin", place), ("threshold", threshold), ("left", child[::2]), ("right", child[1::2]),
                         ("gain", found["gain"][cut])):
        column = getattr(tree, name)
        np.frombuffer(column, dtype=column.typecode)[nodes] = values
    n, w, y = sides
    for name, values in (("feature", -1), ("bin", -1), ("threshold", 0.0), ("left", -1), ("right", -1), ("value", y / w),
                         ("cover", w / UNIT), ("gain", 0.0)):
        column = getattr(tree, name)
        column.frombytes(np.full(len(child), values, dtype=column.typecode).tobytes())
    wide = (n >= 2 * min_leaf) & (0 < y) & (y < w)
    return [child[wide], n[wide]]


def passes(n: np.ndarray, step: int) -> list[np.ndarray]:
    """Positions of the open nodes (of ``n`` rows) taken together: small ones by their rows, the others ``step`` at a time."""
    small = n <= ROWS_PER_GROUP
    large, rest = np.flatnonzero(~small), np.flatnonzero(small)
    out = [large[a:a + step] for a in range(0, len(large), step)]
    part = (np.cumsum(n[rest]) - 1) // ROWS_PER_PASS
    return out + [rest[part == p] for p in np.unique(part)]


def whole_trees(table: DataFrame, trees: list[Tree], grower: Grower, n_rows: int) -> None:
    """Grow each tree in one task; a pass sends the samples of as many trees as ``ROWS_PER_PASS`` allows."""
    spark = table.sparkSession
    cores = spark.sparkContext.defaultParallelism
    a_pass = max(1, ROWS_PER_PASS // n_rows)
    if a_pass > cores:
        a_pass -= a_pass % cores
    for first in range(0, len(trees), a_pass):
        some = range(first, min(first + a_pass, len(trees)))
        parts = min(len(some), max(PARTS_PER_CORE * cores, -(-len(some) * n_rows // ROWS_PER_PART)))
        samples = Samples(grower.packing, {t: (t - first) % parts for t in some}, grower.params.seed)
        sent = table.mapInArrow(samples.rows, SAMPLES)
        dealt = getattr(sent, "repartitionById", sent.repartition)(parts, "part")  # by hash before Spark 4.1: less even
        grown = dealt.mapInArrow(grower.trees, GROWN).toArrow()
        for row in grown.to_pylist():  # one a tree
            tree = trees[row["tree"]] = Tree()
            for c in FIELDS:
                getattr(tree, c).frombytes(row[c])


def fit(train: DataFrame, params: ForestParams = ForestParams()) -> ForestModel:
    """Fit on ``train`` (KEY, LABEL, weight, features). A tree without any row in its sample says 0.5."""
    first = train.select(F.size(vector_to_array("features"))).first()
    if first is None:
        raise ValueError("no training rows")
    if not 2 <= params.bins <= 256:
        raise ValueError("bins must be between 2 and 256")
    edges = bin_edges(train, first[0], params.bins)
    usable = [i for i, e in enumerate(edges) if e] or [0]
    size = columns_a_node(params.feature_subset, first[0])
    spark = train.sparkSession
    rows = train.select(KEY, LABEL, "weight", "features", F.lit(False).alias("held"))
    n_rows = rows.count()
    path = store(binned(rows, edges).repartition(-(-n_rows // ROWS_PER_TASK), "h"), "binned")
    table = spark.read.schema(ROWS).parquet(path)
    trees = [Tree() for _ in range(params.trees)]
    for tree in trees:
        tree.add(0.5, 0.0)
    kinds = [tuple(r) for r in table.select("y", "w").distinct().limit(KINDS + 1).collect()]
    if n_rows * (1 - POISSON[0]) <= GROUPS_PER_TREE * ROWS_PER_GROUP and len(kinds) <= KINDS:
        packing = Packing(sorted(kinds), first[0], params.bins, *([i for i, e in enumerate(edges) if (len(e) > 1) == many and e] for many in (True, False)))
        whole_trees(table, trees, Grower(packing, edges, usable, size, params), n_rows)
        drop_table(spark, path)
        return ForestModel(trees, first[0])
    # Open nodes in order of tree and node, with the rows drawn into them; a whole sample has about as many as the table.
    nodes, n = np.array([(t, 0) for t in range(params.trees)]), np.full(params.trees, n_rows)
    step = max(1, params.cells // (min(size, len(usable)) * params.bins))
    for _ in range(params.depth):
        level = []
        for taken in passes(n, step):
            here = nodes[taken]
            columns = node_columns(usable, size, params.seed, here)
            outlines = {t: outline(trees[t]) for t in np.unique(here[:, 0]).tolist()}
            search = Search(columns.shape[1], params.bins, params.min_leaf)
            if n[taken[0]] <= ROWS_PER_GROUP:
                groups = (np.cumsum(n[taken]) - 1) // ROWS_PER_GROUP
                sent = Level(outlines, here, columns, params.bins, params.seed, groups)
                packed = table.mapInArrow(sent.rows, PACKED).repartition(int(groups[-1]) + 1, "bucket")
                found = packed.mapInArrow(search.row_splits, SPLITS)
            else:
                sums = table.mapInArrow(Level(outlines, here, columns, params.bins, params.seed).sums, SUMS)
                found = sums.repartition(-(-columns.size * params.bins // CELLS_PER_TASK), "slot").groupBy("slot", "cell").agg(
                    *[F.sum(c).alias(c) for c in "nwy"]).mapInArrow(search.splits, SPLITS)
            table_of = found.toArrow().sort_by("slot")  # one row a node
            told = {c: table_of.column(c).to_numpy() for c in table_of.column_names}
            level.append((taken[told["slot"]], columns[told["slot"]], told))
        at = np.concatenate([a for a, _, _ in level])
        order = np.argsort(at)
        columns = np.concatenate([c for _, c, _ in level])[order]
        found = {c: np.concatenate([f[c] for _, _, f in level])[order] for c in level[0][2]}
        nodes = nodes[at[order]]
        grown = []
        for t, a, b in zip(*np.unique(nodes[:, 0], return_index=True), [*np.flatnonzero(np.diff(nodes[:, 0])) + 1, len(nodes)]):
            child, rows_of = enter(trees[t], nodes[a:b, 1], columns[a:b], edges, {c: f[a:b] for c, f in found.items()}, params.min_leaf)
            grown.append((np.stack([np.full(len(child), t), child], axis=1), rows_of))
        if not sum(len(r) for _, r in grown):
            break
        nodes, n = (np.concatenate([g[k] for g in grown]) for k in (0, 1))
    drop_table(spark, path)
    return ForestModel(trees, first[0])
