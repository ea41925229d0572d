"""Boosted trees against a plain implementation on all rows."""

import math

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tidewatch.operators import boosting as B
from tidewatch.session import checkpoint_root, work_path
from tidewatch.settings import BoostParams


@pytest.fixture(scope="module")
def rows(spark):
    checkpoint_root(spark)
    rng = np.random.default_rng(11)
    x = np.column_stack([rng.normal(size=500), rng.integers(0, 3, 500), rng.normal(size=500), np.ones(500)])
    y = (x[:, 0] + 0.7 * (x[:, 1] == 1) + 0.4 * rng.normal(size=500) > 0.2).astype(int)
    df = spark.createDataFrame([(i, int(y[i]), float(1 + y[i]), x[i].tolist()) for i in range(500)], "customer_id long, Churned int, weight double, a array<double>")
    return df.withColumn("features", array_to_vector("a")), x, y


def key_hashes(spark, n):
    return np.array([r[0] for r in spark.range(n).select("id", F.xxhash64("id").alias("h")).orderBy("id").select("h").collect()])


def plain_fit(x, y, w, keys, edges, params):
    """The same trees without Spark, bins or sums by node: every split is tried on the rows themselves."""
    margin, trees = np.zeros(len(x)), []
    for number in range(params.rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = np.rint(B.UNIT * (p - y) * w) / B.UNIT, np.rint(B.UNIT * p * (1 - p) * w) / B.UNIT
        drawn = B.sampled(keys, params.seed, number, params.row_sample)
        usable = [i for i, e in enumerate(edges) if e]
        columns = sorted(np.random.default_rng([params.seed, number]).choice(
            usable, max(1, round(params.column_sample * len(usable))), replace=False).tolist())

        def build(mine, level):
            part = mine & drawn
            out = {"value": -params.rate * g[part].sum() / (h[part].sum() + params.l2)}
            if level == params.depth:
                return out

            def score(m):
                return g[m].sum() ** 2 / (h[m].sum() + params.l2)

            best = None
            for c in columns:
                for edge in edges[c]:
                    left, right = part & (x[:, c] <= edge), part & (x[:, c] > edge)
                    if min(h[left].sum(), h[right].sum()) < params.least_hessian:
                        continue
                    gain = (score(left) + score(right) - score(part)) / 2
                    if gain > B.LEAST_GAIN and (best is None or gain > best[0] + 1e-9):
                        best = (gain, c, edge)
            if best:
                goes = x[:, best[1]] <= best[2]
                out |= {"split": best[1:], "left": build(mine & goes, level + 1), "right": build(mine & ~goes, level + 1)}
            return out

        tree = build(np.ones(len(x), dtype=bool), 0)
        trees.append(tree)
        margin += [plain_value(tree, row) for row in x]
    return trees, margin


def plain_value(tree, row):
    while "split" in tree:
        tree = tree["left"] if row[tree["split"][0]] <= tree["split"][1] else tree["right"]
    return tree["value"]


def test_trees_equal_a_plain_search(spark, rows):
    df, x, y = rows
    params = BoostParams(rounds=7, depth=3, bins=16, refresh=3, patience=99)
    model = B.fit(df, df.limit(0), params)
    edges = B.bin_edges(df, 4, 16)
    assert edges[1] == [0.0, 1.0] and edges[3] == [] and len(edges[0]) == 15
    trees, margin = plain_fit(x, y, 1.0 + y, key_hashes(spark, 500), edges, params)
    assert model.getNumTrees == 7 and np.allclose(model.margins(x), margin, atol=1e-6)
    for tree, want in zip(model.trees, trees):
        assert (tree.feature[0], tree.threshold[0]) == want["split"]
    used = [{f for f in t.feature if f >= 0} for t in model.trees]
    assert all(len(u) <= 2 for u in used) and set().union(*used) == {0, 1, 2}


def test_partitions_change_nothing(rows):
    df, x, _ = rows
    params = BoostParams(rounds=4, depth=4, bins=32, refresh=2)
    models = [B.fit(part, part, params) for part in (df, df.repartition(13), df.repartition(3, "Churned").sortWithinPartitions("weight"))]
    assert models[0].trees == models[1].trees == models[2].trees and models[0].losses == models[1].losses


def test_the_l2_term_shrinks_leaves(rows):
    df, x, y = rows
    params = {k: BoostParams(rounds=1, depth=1, l2=k, row_sample=1.0, column_sample=1.0) for k in (0.0, 50.0)}
    free, held = (B.fit(df, df.limit(0), p).trees[0] for p in params.values())
    g, h = (0.5 - y) * (1.0 + y), 0.25 * (1.0 + y)
    for tree, l2 in ((free, 0.0), (held, 50.0)):
        left = x[:, tree.feature[0]] <= tree.threshold[0]
        assert tree.value[1] == pytest.approx(-0.1 * g[left].sum() / (h[left].sum() + l2), abs=1e-6)
    assert abs(held.value[1]) < abs(free.value[1])


def test_stops_by_the_validation_loss(rows):
    """Validation rows with turned labels get worse from the start; the losses are those of the plain formula."""
    df, x, y = rows
    turned = df.withColumn("Churned", 1 - F.col("Churned"))
    params = BoostParams(rounds=50, depth=3, patience=4, refresh=2)
    model = B.fit(df, turned, params)
    assert len(model.losses) == 5 and model.getNumTrees == 1
    p = 1 / (1 + np.exp(-model.margins(x)))
    assert model.losses[0] == pytest.approx(-np.mean(np.where(y == 1, np.log(1 - p), np.log(p))), abs=1e-6)


def test_saved_and_loaded(spark, rows):
    df, x, _ = rows
    model = B.fit(df, df, BoostParams(rounds=5, depth=3))
    again = B.BoostedModel.load(model.save(work_path(spark, "boosted")))
    assert np.array_equal(again.margins(x), model.margins(x)) and again.losses == model.losses
    assert math.isclose(sum(model.featureImportances), 1.0) and model.featureImportances[3] == 0
    scored = {r.customer_id: r for r in again.transform(df).select("customer_id", "probability", "prediction").collect()}
    p = 1 / (1 + np.exp(-model.margins(x)))
    assert all(scored[i].probability[1] == pytest.approx(p[i], abs=1e-12) and scored[i].prediction == (p[i] > 0.5) for i in range(500))


def test_odd_inputs(rows):
    df, x, _ = rows
    flat = df.withColumn("features", array_to_vector(F.array(F.lit(1.0), F.lit(2.0))))
    model = B.fit(flat, flat, BoostParams(rounds=2))
    assert model.margins(np.zeros((2, 2))).tolist() == [0.0, 0.0]
    assert set(B.fit(df.filter("Churned = 1"), df, BoostParams(rounds=1)).trees[0].feature) <= {-1}
    with pytest.raises(ValueError, match="no training rows"):
        B.fit(df.limit(0), df)
    assert B.fit(df.limit(0).unionByName(df), df.limit(0), BoostParams(rounds=1)).transform(df.limit(0)).count() == 0


def test_rows_are_kept_and_only_lighter_siblings_are_added_up(rows, monkeypatch):
    """A level adds up at most half of the rows of its open nodes' parents, on arrays that the executors keep."""
    df, x, _ = rows
    seen = []
    plain = B.level_sums

    def spy(kept, step):
        total, loss = plain(kept, step)
        seen.append((kept.is_cached, len(step.tree.feature), total[1, :, 0].sum()))
        return total, loss

    monkeypatch.setattr(B, "level_sums", spy)
    B.fit(df, df, BoostParams(rounds=3, depth=4, bins=16, refresh=2))
    roots = [weight for _, nodes, weight in seen if nodes == 1]
    assert all(cached for cached, _, _ in seen) and len(roots) == 4 and len(seen) > 8
    assert all(weight <= max(roots) / 2 for _, nodes, weight in seen if nodes > 1)


def test_trees_are_compact(spark, monkeypatch):
    """Millions of nodes fit the driver: no objects by the node, and files of some trees when a model is saved."""
    import random
    import tracemalloc

    rng = random.Random(2)
    tracemalloc.start()
    trees = []
    for size in (3, 20_000, 1, 7):
        tree = B.Tree()
        tree.add(rng.random(), float(size))
        for n in range(size // 2):
            tree.feature[n], tree.threshold[n], tree.gain[n] = n % 300, rng.random(), rng.random()
            tree.left[n], tree.right[n] = tree.add(rng.random(), 1.0 + n), tree.add(rng.random(), 2.0 + n)
        trees.append(tree)
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert held < 80 * sum(len(t.feature) for t in trees)
    monkeypatch.setattr(B, "NODES_A_FILE", 12)
    model = B.BoostedModel(trees, 300, [0.5])
    again = B.BoostedModel.load(model.save(work_path(spark, "compact")))
    assert again.trees == model.trees and again.losses == [0.5] and again.n_features == 300


def test_categories_are_kept_as_one_column(spark, rows, monkeypatch):
    """Columns of which at most one is 1 share a byte, a task's sums hold only bins there are; the trees are the plain ones."""
    df, x, y = rows
    extra = np.column_stack([np.arange(500) % 3 == k for k in range(3)] + [np.arange(500) % 2 == 0]).astype(float)
    wide = np.column_stack([x[:, :2], extra])
    table = spark.createDataFrame([(i, int(y[i]), float(1 + y[i]), wide[i].tolist()) for i in range(500)], "customer_id long, Churned int, weight double, a array<double>")
    table = table.withColumn("features", array_to_vector("a"))
    params = BoostParams(rounds=5, depth=3, bins=16, refresh=3, patience=99)
    plain, widths = B.level_sums, set()

    def spy(kept, step):
        assert step.form.bundles == [[2, 3, 4], [5]]
        widths.add(kept.mapPartitions(step.sums).first()[0].shape[2])
        return plain(kept, step)

    monkeypatch.setattr(B, "level_sums", spy)
    monkeypatch.setattr(B, "PARTS_AT_ONCE", 0)  # many tasks are added up in executors
    model = B.fit(table, table.limit(0), params)
    assert max(widths) <= 16 + 3 + 4 + 2  # not 16 for each of six columns
    trees, margin = plain_fit(wide, y, 1.0 + y, key_hashes(spark, 500), B.bin_edges(table, 6, 16), params)
    assert np.allclose(model.margins(wide), margin, atol=1e-6)
    for tree, want in zip(model.trees, trees):
        assert (tree.feature[0], tree.threshold[0]) == want["split"]


def test_walks_of_packed_rows():
    """Packed rows end where whole rows end."""
    rng = np.random.default_rng(8)
    codes = np.column_stack([rng.integers(0, 256, 400), rng.integers(0, 7, 400), *(np.arange(400) % 5 == k for k in range(3)), rng.integers(0, 2, 400)]).astype("uint8")
    form = B.Layout([0, 1], [[2, 3, 4], [5]], [256, 7, 4, 2])
    tree = B.Tree()
    tree.add(0.0, 1.0)
    for node in range(40):
        tree.feature[node] = int(rng.integers(6))
        tree.bin[node] = int(rng.integers([255, 6, 1, 1, 1, 1][tree.feature[node]]))
        tree.left[node], tree.right[node] = tree.add(0.0, 1.0), tree.add(0.0, 1.0)
    want = tree.walk(codes, tree.bin)
    assert len(set(want.tolist())) > 8 and np.array_equal(form.walk(tree, form.packed(codes)), want)
    for row, end in zip(codes, want):
        node = 0
        while tree.feature[node] >= 0:
            node = tree.left[node] if row[tree.feature[node]] <= tree.bin[node] else tree.right[node]
        assert node == end
