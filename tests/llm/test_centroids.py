"""Centroid clustering against plain Python and SQL."""

import hashlib
import math

import numpy as np
import pytest

from tests.compare import connect, differences
from tidewatch.llm import centroids, queries

SCHEMA = "vec_id long, embedding array<float>, label int"
FOLDER = "/root/testdata/sf0.01"


def plain(rows, k, rounds, dims, scale=1024, seed=3):
    kept = [
        (i, tuple(math.floor(scale * x) for x in v)) for i, v in rows
        if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centres = [v for _, v in order[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centres))

    for _ in range(rounds):
        groups = [[] for _ in centres]
        for _, v in kept:
            groups[near(v)[1]].append(v)
        centres = [tuple(sum(x) // len(g) for x in zip(*g)) if g else c for c, g in zip(centres, groups)]
    found = [(i, near(v)[1], near(v)[0]) for i, v in kept]
    sums = [sum(d for _, c, d in found if c == n) for n in range(len(centres))]
    return [
        (i, c, d, sums[c], sum(sums), hashlib.sha256(",".join(map(str, centres[c])).encode()).hexdigest()) for i, c, d in found]


def order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1:]))


def test_against_sql(spark):
    got = queries.op12_centroids(spark, FOLDER)
    assert differences(got, connect(FOLDER), queries.ORACLES["op12_centroids"]) == []


@pytest.mark.parametrize("k, rows", [(3, 2000), (8, 5), (5, 60)])
def test_against_plain_python(spark, k, rows):
    """More than one block, fewer vectors than centroids, copies and ties."""
    rng = np.random.default_rng(k)
    data = [(i, rng.normal(rng.integers(0, 4), 0.3, 6).astype("float32").tolist()) for i in range(rows)]
    data += [(i, data[0][1]) for i in range(rows, rows + 30)] + [data[1]] * 3 + [(None, data[2][1])]
    df = spark.createDataFrame([(i, v, 1) for i, v in data], SCHEMA).repartition(3)
    got = [tuple(r) for r in centroids.with_inertia(centroids.cluster(df, k=k, rounds=4, dims=6)).collect()]
    assert order(got) == order(plain(data, k, 4, 6))


def test_what_takes_part(spark):
    odd = [(1, None), (2, []), (3, [1.0, 2.0, 3.0]), (4, [1.0, None]), (5, [1.0, float("nan")]), (6, [float("inf"), 0.0])]
    good = [(7, [0.0, 0.0]), (8, [-0.0004, 0.0]), (9, [1e4, -1e4])]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in odd + good], SCHEMA + ", cluster string")
    got = [tuple(r) for r in centroids.with_inertia(centroids.cluster(df, k=2, rounds=3, dims=2)).collect()]
    assert order(got) == order(plain(odd + good, 2, 3, 2)) and len(got) == 3


def test_huge_components_and_empty_table(spark):
    df = spark.createDataFrame([(1, [3e38, 0.0], 1), (2, [-3e38, 0.0], 1)], SCHEMA)
    got = centroids.with_inertia(centroids.cluster(df, k=1, rounds=1, dims=2)).collect()
    assert [r.distance for r in got] == [2**54, 2**54] and {r.inertia for r in got} == {2**55}
    none = centroids.with_inertia(centroids.cluster(df.limit(0)))
    assert none.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"] and none.collect() == []


def test_tables_hold_every_occurring_integer():
    values, ends = np.array([-3, 0, 2, 5]), np.array([1, 4])
    made = centroids.tables(values, ends, np.array([[1, 2], [0, 5]]))
    assert made.tolist() == [[16, 9], [4, 25], [0, 9], [9, 0]]
