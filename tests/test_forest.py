"""The forest against a plain search on all rows, and its independence of where rows lie."""

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tidewatch.operators import attribution as A
from tidewatch.operators import forest as R
from tidewatch.operators.boosting import Tree
from tidewatch.session import checkpoint_root, work_path
from tidewatch.settings import ForestParams

SMALL = ForestParams(trees=6, depth=4, min_leaf=5, bins=16)


@pytest.fixture(scope="module")
def rows(spark):
    checkpoint_root(spark)
    rng = np.random.default_rng(5)
    x = np.column_stack([rng.normal(size=600), rng.integers(0, 3, 600), -rng.exponential(size=600), np.ones(600)])
    y = (x[:, 0] + 0.7 * (x[:, 1] == 1) + 0.4 * rng.normal(size=600) > 0.2).astype(int)
    df = spark.createDataFrame([(i, int(y[i]), 1.25 if y[i] else 0.5, x[i].tolist()) for i in range(600)], "customer_id long, Churned int, weight double, a array<double>")
    return df.withColumn("features", array_to_vector("a")).drop("a"), x, y


def plain_tree(x, y, w, times, edges, params, number):
    """(feature, threshold, gain) or share of every node in the order in which levels grow."""
    usable = [i for i, e in enumerate(edges) if e]
    nodes, opened = [None], [(0, times > 0)]
    at = {0: times > 0}

    def purity(m):
        total, ones = (w * times)[m].sum(), (w * times * y)[m].sum()
        return (ones**2 + (total - ones) ** 2) / total

    for _ in range(params.depth):
        grown = []
        for node, mine in opened:
            best = None
            for c in R.node_columns(usable, R.columns_a_node(params.feature_subset, x.shape[1]), params.seed, np.array([(number, node)]))[0]:
                for edge in edges[c]:
                    left, right = mine & (x[:, c] <= edge), mine & (x[:, c] > edge)
                    if min(times[left].sum(), times[right].sum()) < params.min_leaf:
                        continue
                    gain = purity(left) + purity(right) - purity(mine)
                    if gain > R.LEAST_GAIN * (w * times)[mine].sum() and (best is None or gain > best[0] + 1e-9):
                        best = (gain, c, edge, left, right)
            if best is None:
                continue
            nodes[node] = best[:3]
            for side in best[3:]:
                nodes.append(None)
                at[len(nodes) - 1] = side
                ones = y[side].sum()
                if times[side].sum() >= 2 * params.min_leaf and 0 < ones < side.sum():
                    grown.append((len(nodes) - 1, side))
        opened = grown
    shares = [(w * times * y)[at[n]].sum() / (w * times)[at[n]].sum() for n in range(len(nodes))]
    return nodes, shares


def test_trees_equal_a_plain_search(spark, rows):
    df, x, y = rows
    edges = R.bin_edges(df, 4, SMALL.bins)
    assert edges[1] == [0.0, 1.0] and edges[3] == []
    hashes = np.array([r[0] for r in spark.range(600).select("id", F.xxhash64("id").alias("h")).orderBy("id").select("h").collect()])
    model = R.fit(df, SMALL)
    for number, tree in enumerate(model.trees):
        times = R.drawn(hashes, SMALL.seed, number)
        nodes, shares = plain_tree(x, y, np.where(y, 1.25, 0.5), times, edges, SMALL, number)
        assert len(nodes) == len(tree.feature) > 5
        for n, want in enumerate(nodes):
            assert tree.value[n] == pytest.approx(shares[n], abs=1e-12)
            if want is None:
                assert tree.feature[n] == -1
            else:
                assert (tree.feature[n], tree.threshold[n]) == want[1:] and tree.gain[n] == pytest.approx(want[0], abs=1e-6)


def test_partitions_and_passes_change_nothing(rows):
    df = rows[0]
    tables = [df.repartition(4), df.repartition(16), df.repartition(64), df.repartition(3, "Churned").sortWithinPartitions("weight")]
    models = [R.fit(t, SMALL) for t in tables]
    models.append(R.fit(df, ForestParams(trees=6, depth=4, min_leaf=5, bins=16, cells=100)))  # three nodes a pass
    assert all(m.trees == models[0].trees for m in models[1:])


@pytest.mark.parametrize("group, sent", [(0, 10**6), (150, 10**6), (10**6, 700)])
def test_rows_and_sums_give_the_same_trees(rows, monkeypatch, group, sent):
    """Nodes that are added up where their rows lie, nodes whose rows are sent, and rows sent in several passes."""
    want = R.fit(rows[0], SMALL)
    monkeypatch.setattr(R, "ROWS_PER_GROUP", group)
    monkeypatch.setattr(R, "ROWS_PER_PASS", sent)
    assert R.fit(rows[0].repartition(5), SMALL).trees == want.trees


def test_whole_trees_grow_in_tasks(spark, rows, monkeypatch):
    """Trees whose samples fit a task: the same ones as level by level, in a number of jobs that does not depend on depth."""
    deep = ForestParams(trees=6, depth=12, min_leaf=1, bins=16)
    spark.sparkContext.setJobGroup("whole", "")
    model = R.fit(rows[0], deep)
    spark.sparkContext.setJobGroup("other", "")
    assert max(len(t.feature) for t in model.trees) > 60
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("whole")) < 16
    monkeypatch.setattr(R, "ROWS_AT_ONCE", 7)
    monkeypatch.setattr(R, "CELLS_PER_TASK", 40)
    assert R.fit(rows[0].repartition(3), deep).trees == model.trees
    monkeypatch.setattr(R, "GROUPS_PER_TREE", 0)
    assert R.fit(rows[0], deep).trees == model.trees


def test_weights_of_many_kinds(spark, rows):
    """Rows that differ in weight are not counted by kind; trees still equal a plain search."""
    df, x, y = rows
    df = df.withColumn("weight", 0.5 + (F.col("customer_id") % 8) / 8)
    hashes = np.array([r[0] for r in spark.range(600).select("id", F.xxhash64("id").alias("h")).orderBy("id").select("h").collect()])
    edges, weights = R.bin_edges(df, 4, SMALL.bins), 0.5 + (np.arange(600) % 8) / 8
    for number, tree in enumerate(R.fit(df, SMALL).trees):
        nodes, shares = plain_tree(x, y, weights, R.drawn(hashes, SMALL.seed, number), edges, SMALL, number)
        assert [w and w[1:] for w in nodes] == [(f, t) if f >= 0 else None for f, t in zip(tree.feature, tree.threshold)]
        assert tree.value.tolist() == pytest.approx(shares, abs=1e-12)


def test_rows_of_small_nodes_are_sent_packed():
    """One record a group of nodes and a few bytes a row, instead of one record a (node, column, bin)."""
    h = np.arange(3000, dtype="int64") * 0x9E3779B97F4A7C
    codes = np.random.default_rng(1).integers(0, 16, (3000, 4)).astype("uint8")
    batch = pa.RecordBatch.from_arrays(
        [pa.array(h), pa.array(np.zeros(3000)), pa.array(np.ones(3000)), pa.array(np.zeros(3000, bool)), pa.array(np.zeros(3000)),
         pa.array([c.tobytes() for c in codes])], names=list("abcdef"))
    trees = {}
    for number in range(40):
        tree = Tree()
        tree.add(0.5, 0.0)
        trees[number] = R.outline(tree)
    columns = np.tile([[0, 2]], (40, 1))
    level = R.Level(trees, np.array([(t, 0) for t in range(40)]), columns, 16, 42, np.arange(40) // 20)
    sent = pa.Table.from_batches(level.rows(iter([batch])))
    n = sum(int((R.drawn(h, 42, t) > 0).sum()) for t in range(40))
    assert sent.column("bucket").to_pylist() == [0, 1] and sum(map(len, sent.column("rows").to_pylist())) == n * R.row_type(2).itemsize
    by_rows = pa.Table.from_batches(R.Search(2, 16, 5).row_splits(iter(sent.to_batches())))
    assert by_rows.num_rows == 40 and sum(by_rows.column("n").to_pylist()) == sum(int(R.drawn(h, 42, t).sum()) for t in range(40))


def test_edges_are_near_the_quantiles(spark):
    """At most ``bins`` bins; none holds much more than its share; signs, huge and tiny values keep their order."""
    rng = np.random.default_rng(3)
    x = np.column_stack([rng.normal(size=4000), np.concatenate([-np.exp(rng.normal(0, 40, 2000)), np.exp(rng.normal(0, 40, 2000))])])
    df = spark.createDataFrame([(r.tolist(),) for r in x], "a array<double>").select(array_to_vector("a").alias("features"))
    for i, edges in enumerate(R.bin_edges(df, 2, 20)):
        held = np.bincount(np.searchsorted(edges, x[:, i], side="left"), minlength=20)
        assert len(edges) == 19 and edges == sorted(edges) and held.max() <= 1.2 * 4000 / 20


def test_columns_are_drawn_evenly():
    drawn = R.node_columns([0, 2, 3, 5, 9], 2, 42, np.array([(t, n) for t in range(40) for n in range(100)]))
    assert drawn.shape == (4000, 2) and (drawn[:, 0] < drawn[:, 1]).all()
    assert all(abs((drawn == c).sum() / 4000 - 0.4) < 0.04 for c in (0, 2, 3, 5, 9))


def test_bootstrap_is_poisson():
    times = np.stack([R.drawn(np.arange(20_000, dtype="int64") * 0x9E3779B97F4A7C, 42, t) for t in range(5)])
    assert times.mean() == pytest.approx(1, abs=0.02) and (times == 0).mean() == pytest.approx(math.exp(-1), abs=0.01)
    assert abs(np.corrcoef(times)[np.triu_indices(5, 1)]).max() < 0.03


def test_saved_scored_and_explained(spark, rows):
    df, x, y = rows
    model = R.fit(df, SMALL)
    again = R.ForestModel.load(path := model.save(work_path(spark, "forest")))
    want = np.mean([np.array(t.value)[t.walk(x, t.threshold)] for t in model.trees], axis=0)
    scored = {r.customer_id: r for r in again.transform(A.tree_attributions(df, path)).collect()}
    for i, p in enumerate(want):
        assert scored[i].probability[1] == pytest.approx(p, abs=1e-12) and scored[i].prediction == (p > 0.5)
        assert sum(scored[i].contributions) + scored[i].base == pytest.approx(p, abs=1e-9)
    assert np.mean((want > 0.5) == y) > 0.8
    assert math.isclose(sum(again.featureImportances), 1.0) and again.featureImportances[3] == 0
    assert int(np.argmax(again.featureImportances.toArray())) == 0


def test_odd_inputs(rows):
    df, x, _ = rows
    flat = df.withColumn("features", array_to_vector(F.array(F.lit(1.0), F.lit(2.0))))
    assert all(t.feature == [-1] for t in R.fit(flat, SMALL).trees)
    ones = R.fit(df.filter("Churned = 1"), SMALL)
    assert all(t.feature == [-1] and t.value == [1.0] for t in ones.trees) and ones.transform(df.limit(0)).count() == 0
    single = R.fit(df.filter("customer_id = 0"), ForestParams(trees=30, depth=2))
    assert {t.value[0] for t in single.trees} <= {0.0, 0.5, 1.0}
    with pytest.raises(ValueError, match="no training rows"):
        R.fit(df.limit(0))
    with pytest.raises(ValueError, match="feature_subset"):
        R.fit(df, ForestParams(feature_subset="half"))


def test_attributions_are_spread_over_tasks(spark, rows):
    """Rows of one small file are explained by as many tasks as run at once."""
    df = rows[0]
    path = R.fit(df, ForestParams(trees=2, depth=2)).save(work_path(spark, "spread"))
    parts = A.tree_attributions(df.coalesce(1), path).withColumn("part", F.spark_partition_id())
    sizes = [r["count"] for r in parts.groupBy("part").count().collect()]
    assert len(sizes) == spark.sparkContext.defaultParallelism and max(sizes) < 2 * 600 / len(sizes)
