"""Small ensembles: persistence, additivity, attributions against brute force."""

import time
from itertools import combinations
from math import factorial

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tidewatch.operators import attribution as A
from tidewatch.operators import models, prepare
from tidewatch.operators.prepare import transform_prepared
from tidewatch.session import checkpoint_root, work_path
from tidewatch.settings import AttributionParams, BoostParams, ForestParams


@pytest.fixture(scope="module")
def fitted(spark):
    checkpoint_root(spark)
    x = (F.hash("id", F.lit(1)) % 1000) / 100.0
    y = (F.hash("id", F.lit(2)) % 1000) / 100.0
    df = spark.range(600).select(
        F.col("id").alias("customer_id"), x.alias("Age"), F.when(F.col("id") % 11 > 0, y).alias("Returns_Rate"),
        F.concat(F.lit("g"), (F.col("id") % 3).cast("string")).alias("Gender"),
    ).withColumn("Churned", ((F.col("Age") + F.coalesce("Returns_Rate", F.lit(0.0)) > 1) & (F.col("Gender") != "g0")).cast("int"))
    ready = prepare.fit_preparation(df.filter("customer_id < 400"), ["Age", "Returns_Rate"], ["Gender"])
    table = transform_prepared(ready, df)
    train, val = table.filter("customer_id < 400"), table.filter("customer_id >= 400")
    forest = models.fit_forest(train, ForestParams(trees=8, depth=5))
    boosted = models.fit_boosted(train, val, BoostParams(rounds=12, depth=4, patience=4))
    paths = {k: models.save(m, work_path(spark, k)) for k, m in
             {"preparation": ready, "random_forest": forest, "boosted_trees": boosted}.items()}
    return {k: models.load(k, p) for k, p in paths.items()}, table, paths


def test_names_and_block_order(fitted):
    model, table, _ = fitted
    assert prepare.feature_names(model["preparation"], ["Age", "Returns_Rate"]) == [
        "Age", "Returns_Rate", "Gender_g0", "Gender_g1", "Gender_g2"]
    assert table.select(F.size(vector_to_array("features"))).first()[0] == 5


def test_scores_and_importances(spark, fitted):
    model, table, _ = fitted
    for each in (model["random_forest"], model["boosted_trees"]):
        row = models.score_customers(table, each).agg(
            F.min("y_proba"), F.max("y_proba"), F.avg((F.col("y_pred") == F.col("Churned")).cast("int"))).first()
        assert 0 <= row[0] <= row[1] <= 1 and row[2] > 0.9
    top = models.feature_importances(spark, model["random_forest"], ["a", "b", "c", "d", "e"], top=3).collect()
    assert [r["rank"] for r in top] == [1, 2, 3] and top[0]["importance"] >= top[1]["importance"]


def test_contributions_add_up_to_the_log_odds(fitted):
    model, table, path = fitted
    scored = model["boosted_trees"].transform(A.tree_attributions(table, path["boosted_trees"]))
    total = F.aggregate("contributions", F.lit(0.0), lambda a, x: a + x) + F.col("base")
    p = vector_to_array("probability")[1]
    gap = scored.agg(F.max(F.abs(total - F.log(p / (1 - p))))).first()[0]
    assert gap < 1e-6


def random_tree(rng, depth, n_features, categories=0):
    """Feature 0 is categorical if there are categories."""
    rows, next_id = [], [1]

    def grow(node, level, count):
        if level == depth or count < 4 or rng.random() < 0.15:
            rows.append((node, rng.normal(), count, -1, -1, -1, [], -1))
            return
        left, right = next_id[0], next_id[0] + 1
        next_id[0] += 2
        n_left = int(rng.integers(1, count))
        feature = int(rng.integers(n_features))
        if categories and feature == 0:
            chosen = rng.choice(categories, int(rng.integers(1, categories)), replace=False).astype(float).tolist()
            rows.append((node, 0.0, count, left, right, feature, chosen, categories))
        else:
            rows.append((node, 0.0, count, left, right, feature, [float(rng.normal())], -1))
        grow(left, level + 1, n_left)
        grow(right, level + 1, count - n_left)

    grow(0, 0, 200)
    return pd.DataFrame(rows, columns=["id", "prediction", "rawCount", "leftChild", "rightChild", "feature", "left", "categories"])


def expectation(nodes, x, known, node=0):
    n = nodes[node]
    if n.leftChild < 0:
        return n.prediction
    if n.feature in known:
        goes_left = x[n.feature] <= n.left[0] if n.categories == -1 else x[n.feature] in n.left
        return expectation(nodes, x, known, n.leftChild if goes_left else n.rightChild)
    share = nodes[n.leftChild].rawCount / n.rawCount
    return share * expectation(nodes, x, known, n.leftChild) + (1 - share) * expectation(nodes, x, known, n.rightChild)


@pytest.mark.parametrize("depth, categories", [(4, 0), (5, 5), (12, 3)])
def test_attributions_equal_brute_force_shapley_values(depth, categories):
    rng = np.random.default_rng(5 + depth)
    n_features = 5
    for _ in range(8):
        frame = random_tree(rng, depth, n_features, categories)
        nodes = {r.id: r for r in frame.itertuples(index=False)}
        tree = A.tree_paths(frame, 1.0)
        x = rng.normal(size=(5, n_features))
        if categories:
            x[:, 0] = rng.integers(0, categories, 5)
        got = A.contributions(tree, x, cells=int(rng.integers(1, 5000)))
        for row, phi in zip(x, got):
            for i in range(n_features):
                others = [j for j in range(n_features) if j != i]
                want = sum(
                    factorial(k) * factorial(n_features - 1 - k) / factorial(n_features)
                    * (expectation(nodes, row, {*s, i}) - expectation(nodes, row, set(s)))
                    for k in range(n_features) for s in combinations(others, k))
                assert phi[i] == pytest.approx(want, abs=1e-12)
            assert phi.sum() + A.expected_value([tree]) == pytest.approx(expectation(nodes, row, set(range(n_features))), abs=1e-12)


def test_a_path_of_twenty_features():
    """A chain twenty splits deep, each on a feature of its own: contributions add up to the prediction."""
    rng = np.random.default_rng(1)
    rows, count = [], 2**20
    for level in range(20):
        rows.append((2 * level, 0.0, count, 2 * level + 1, 2 * level + 2, level, [0.0], -1))
        rows.append((2 * level + 1, rng.normal(), count // 2, -1, -1, -1, [], -1))
        count -= count // 2
    rows.append((40, 1.0, count, -1, -1, -1, [], -1))
    frame = pd.DataFrame(rows, columns=["id", "prediction", "rawCount", "leftChild", "rightChild", "feature", "left", "categories"])
    nodes = {r.id: r for r in frame.itertuples(index=False)}
    tree, x = A.tree_paths(frame, 1.0), np.abs(rng.normal(size=(4, 20)))
    x[0, 7] = -1.0
    for row, phi in zip(x, A.contributions(tree, x)):
        assert phi.sum() + A.expected_value([tree]) == pytest.approx(expectation(nodes, row, set(range(20))), abs=1e-10)


def test_forest_contributions_add_up_to_its_probability(fitted):
    model, table, path = fitted
    scored = model["random_forest"].transform(A.tree_attributions(table, path["random_forest"]))
    total = F.aggregate("contributions", F.lit(0.0), lambda a, x: a + x) + F.col("base")
    assert scored.agg(F.max(F.abs(total - vector_to_array("probability")[1]))).first()[0] < 1e-9


def test_seeded_trees_do_not_depend_on_files_or_partitions(fitted):
    _, table, _ = fitted
    train = table.filter("customer_id < 400").select("customer_id", "Churned", "features")
    grown = [models.fit_forest(df, ForestParams(trees=3, depth=4)).trees for df in (train, train.repartition(1), train.repartition(7, "Churned"))]
    assert grown[0] == grown[1] == grown[2]


def test_paths_that_are_not_kept_give_the_same(fitted):
    _, table, path = fitted
    whole, parts = (
        A.tree_attributions(table, path["boosted_trees"], AttributionParams(path_bytes=n, cells=c)).select("customer_id", "contributions").collect()
        for n, c in ((1 << 30, 2_000_000), (0, 50)))
    assert all(np.allclose(a.contributions, b.contributions) for a, b in zip(sorted(whole), sorted(parts)))


def test_too_many_nodes_are_not_broadcast(fitted):
    _, table, path = fitted
    with pytest.raises(ValueError, match="too many to broadcast"):
        A.tree_attributions(table, path["boosted_trees"], AttributionParams(most_nodes=3))


def test_rows_with_the_same_turns_are_explained_once():
    """A tree of the forest's size on a block of rows: a split costs a look-up a row, not all features of all leaves."""
    rng = np.random.default_rng(4)
    n_features, rows, next_id = 30, [], 1
    stack = [(0, 0, 6000)]
    while stack:
        node, level, count = stack.pop()
        if level == 20 or count < 10:
            rows.append((node, rng.normal(), count, -1, -1, -1, [], -1))
            continue
        n_left = int(rng.integers(count // 4, 3 * count // 4) + 1)
        rows.append((node, 0.0, count, next_id, next_id + 1, int(rng.integers(n_features)), [float(rng.normal())], -1))
        stack += [(next_id, level + 1, n_left), (next_id + 1, level + 1, count - n_left)]
        next_id += 2
    frame = pd.DataFrame(rows, columns=["id", "prediction", "rawCount", "leftChild", "rightChild", "feature", "left", "categories"])
    tree, x = A.tree_paths(frame, 1.0), rng.normal(size=(2000, n_features))
    start = time.process_time()
    phi = A.contributions(tree, x)
    assert len(frame) > 1500 and time.process_time() - start < 3  # 6 s and more with a table of rows, leaves and path features
    nodes = {r.id: r for r in frame.itertuples(index=False)}
    want = [expectation(nodes, row, set(range(n_features))) for row in x]
    assert np.allclose(phi.sum(axis=1) + A.expected_value([tree]), want, atol=1e-12)
    assert np.allclose(phi[:40], A.contributions(tree, x[:40], cells=1), atol=1e-12)


def test_scores_are_stored(spark):
    """Metrics read scores several times; the trees are walked once."""
    from tidewatch.plans import data, model_queries

    folder = "/root/testdata/sf0.001"
    for table in (model_queries.predictions(spark, folder, "random_forest"), model_queries.training_scores(spark, folder, "random_forest")):
        assert "Python" not in table._jdf.queryExecution().executedPlan().toString() and table.count() > 0
    data.forget_stages()
