"""Vector dedup and nearest neighbours against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.llm import embedding_dedup, neighbours

SCHEMA = "vec_id long, embedding array<float>, label int"


def near_groups(rng, groups, size, spread, dims=32):
    out = []
    for _ in range(groups):
        centre = rng.standard_normal(dims)
        centre /= np.linalg.norm(centre)
        out += [centre + spread * rng.standard_normal(dims) / dims**0.5 for _ in range(size)]
    return np.array(out, dtype="float32")


def plain_links(x, labels, least):
    u = x.astype("float64")
    u /= np.linalg.norm(u, axis=1)[:, None]
    linked = (u @ u.T >= least) & (labels[:, None] == labels[None, :])
    np.fill_diagonal(linked, False)
    name = list(range(len(x)))
    for i in range(len(x)):
        for j in np.flatnonzero(linked[i]):
            a, b = name[i], name[j]
            if a != b:
                name = [min(a, b) if n in (a, b) else n for n in name]
    return linked.sum(axis=1), name


@pytest.mark.parametrize("spread", [0.05, 0.14])
def test_links_against_all_pairs(spark, spread):
    rng = np.random.default_rng(6)
    x = near_groups(rng, 25, 20, spread)
    labels = rng.integers(0, 2, len(x))
    df = spark.createDataFrame([(i, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(x, labels))], SCHEMA)
    got = {r.vec_id: r for r in embedding_dedup.near_vectors(df).collect()}
    links, names = plain_links(x, labels, 0.98)
    found = np.array([got[i].n_links for i in range(len(x))])
    assert (found <= links).all() and found.sum() >= 0.995 * links.sum()
    assert np.mean([got[i].component_id == names[i] for i in range(len(x))]) >= 0.99
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_a_hot_group_keeps_all_its_links(spark, monkeypatch):
    from tidewatch.llm import links

    monkeypatch.setattr(links.block_pairs, "__defaults__", (64,))
    x = near_groups(np.random.default_rng(3), 1, 500, 0.03)
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], SCHEMA)
    got = embedding_dedup.near_vectors(df).collect()
    assert {r.n_links for r in got} == {499} and {r.component_id for r in got} == {0}


ODD = [
    (1, None, 1), (2, [0.0, 0.0], 1), (3, [1.0, None], 1), (4, [1.0, float("nan")], 1), (5, [float("inf"), 1.0], 1), (6, [], 1),
    (7, [1.0, 2.0], None), (8, [1.0, 2.0], 1), (9, [2.0, 4.0], 1), (9, [1.0, 2.0], 1), (None, [1.0, 2.0], 1), (10, [1.0, 2.0, 0.0], 1),
    (11, [1e30, 2e30], 1), (12, [-1.0, 5.0], 1)]


def test_a_third_of_all_rows_in_one_group(spark):
    rng = np.random.default_rng(12)
    x = np.concatenate([near_groups(rng, 1, 300, 0.12), near_groups(rng, 600, 1, 0.0)])
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], SCHEMA)
    links, _ = plain_links(x, np.ones(len(x)), 0.98)
    found = {r.vec_id: r.n_links for r in embedding_dedup.near_vectors(df).collect()}
    assert links.sum() > 10000 and sum(found.values()) >= 0.999 * links.sum()


def test_awkward_vectors(spark):
    got = sorted((tuple(r) for r in embedding_dedup.near_vectors(spark.createDataFrame(ODD, SCHEMA)).collect()), key=str)
    want = [(i, 0, i, True) for i in (1, 2, 3, 4, 5, 6, 7, 10, 12)] + [
        (8, 4, 8, True), (9, 4, 8, False), (9, 4, 8, False), (11, 4, 8, False), (None, 4, 8, False)]
    assert got == sorted(want, key=str)
    assert embedding_dedup.near_vectors(spark.createDataFrame([], SCHEMA)).count() == 0
    assert embedding_dedup.near_vectors(spark.createDataFrame(ODD[:6], SCHEMA)).count() == 6


def plain_nearest(ids, x, asks, k):
    out = {}
    for q in np.flatnonzero(asks):
        score = x @ x[q]
        order = [i for i in np.lexsort((ids, -score)) if i != q][:k]
        out[int(ids[q])] = [int(ids[i]) for i in order]
    return out


def test_exact_search(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.standard_normal((900, 16)), near_groups(rng, 4, 25, 0.1, 16)]).round(1).astype("float32")
    ids = np.arange(len(x))
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<float>")
    rows = neighbours.nearest(df, F.col("vec_id") % 20 == 0, k=20, factor=1.0, shard_rows=200).collect()
    want = plain_nearest(ids, x.astype("float64"), ids % 20 == 0, 20)
    got = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append(r)
        assert r.score == pytest.approx(float(x[r.vec_id].astype("float64") @ x[r.query_id].astype("float64")), abs=1e-9)
    assert got.keys() == want.keys()
    for q, rs in got.items():
        assert [r.rank for r in rs] == list(range(1, 21))
        scores = [round(r.score, 9) for r in rs]
        exact = x.astype("float64") @ x[q].astype("float64")
        assert scores == [round(float(exact[i]), 9) for i in want[q]]


def test_reach_trades_recall_for_work():
    rng = np.random.default_rng(5)
    x = rng.standard_normal((4000, 12))
    tree = neighbours.Tree(x, np.arange(4000), np.arange(4000), float((x * x).sum(axis=1).max()))
    q, own = x[:200], np.arange(200)
    exact = tree.search(q, own, 20, 1.0)[0]
    brute = np.sort(np.where(np.arange(4000)[None, :] == own[:, None], -np.inf, q @ x.T), axis=1)[:, ::-1][:, :20]
    assert np.allclose(exact, brute)
    recall = [np.mean([len(np.intersect1d(a.round(9), b.round(9))) / 20 for a, b in zip(tree.search(q, own, 20, f)[0], brute)]) for f in (0.0, 0.5, 0.9)]
    assert recall == sorted(recall) and recall[-1] > 0.9 > recall[0]


def test_awkward_search(spark):
    odd = [(i, v) for i, v, _ in ODD] + [(20, [1.0, 1.0]), (40, None), (60, [0.0])]
    df = spark.createDataFrame(odd, "vec_id long, embedding array<float>")
    rows = neighbours.nearest(df, F.col("vec_id") % 20 == 0).collect()
    assert {r.query_id for r in rows} == {20}
    assert [r.vec_id for r in sorted(rows, key=lambda r: r["rank"])] == [11, 9, 12, 7, 8, 9, 10, None]
    assert neighbours.nearest(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 20 == 0).count() == 0


def test_neighbours_settle_ties_by_id(spark):
    """Two hundred copies of each of three vectors, dealt over shards: equal scores must go to the smallest ids."""
    rng = np.random.default_rng(12)
    base = rng.standard_normal((3, 64)).astype("float32")
    x = np.concatenate([np.repeat(base, 200, axis=0), rng.standard_normal((200, 64)).astype("float32")])
    ids = rng.permutation(len(x))
    df = spark.createDataFrame([(int(i), v.tolist(), 1) for i, v in zip(ids, x)], SCHEMA)
    got = {}
    for r in neighbours.nearest(df, F.col("vec_id") % 5 == 0, k=20, shard_rows=150).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    d = x.astype("float64")
    by_id = np.argsort(ids)
    for q in range(0, len(x), 5):
        scores = np.cumsum(d[by_id] * d[by_id[q]], axis=1)[:, -1]
        order = [i for i in np.lexsort((np.arange(len(x)), -scores)) if i != q][:20]
        assert [(i, s) for _, i, s in sorted(got[q])] == [(i, scores[i]) for i in order]
