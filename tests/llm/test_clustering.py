import hashlib
import math
import os

import duckdb
import numpy as np
import pytest

from vacantry.llm import clustering as C


def brute(rows, clusters, rounds):
    """The contract's rounds in Python integers: ``(id, cluster, distance)`` sorted, and the centroids."""
    kept = [(i, [math.floor(256 * x) if abs(x) < 2**53 else 256 * int(x) for x in v]) for i, v in rows]
    first = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), x) for i, x in kept if i is not None)[:clusters]
    centroids = [x for _, x in first]

    def nearest(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), k) for k, c in enumerate(centroids))

    for _ in range(rounds):
        own = [nearest(x)[1] for _, x in kept]
        for k in range(len(centroids)):
            mine = [x for (_, x), o in zip(kept, own) if o == k]
            if mine:
                centroids[k] = [sum(c) // len(mine) for c in zip(*mine)]
    out = [(i, nearest(x)[1], nearest(x)[0]) for i, x in kept]
    return sorted((repr(i), k, d if d <= C.LONG else None) for i, k, d in out), centroids


def found(spark, rows, clusters=5, rounds=3, components=8, kind="double"):
    df = spark.createDataFrame([(i, v, 0, "x") for i, v in rows], f"vec_id long, embedding array<{kind}>, cluster int, v string")
    out, centroids = C.cluster(df, clusters=clusters, rounds=rounds, components=components)
    return sorted((repr(r.vec_id), r.cluster, r.distance) for r in out.collect()), centroids


def test_equals_plain_rounds(spark):
    x = np.random.default_rng(1).normal(size=(400, 8))
    x[100:160] = x[3]  # repeated vectors
    x[200:300] = np.round(x[200:300])  # ties
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    assert found(spark, rows) == brute(rows, 5, 3)


def test_odd_rows(spark):
    """Left out: null, other lengths, null or non-finite components. Kept: zero vectors, repeated ids, no id."""
    rng = np.random.default_rng(2)
    good = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(40, 8)))] + [(3, [0.0] * 8), (None, [0.5] * 8), (4, [0.25] * 8), (4, [0.25] * 8)]
    bad = [(90, None), (91, [1.0] * 7), (92, [1.0] * 9), (93, [None] + [1.0] * 7), (94, [math.nan] + [1.0] * 7), (95, [math.inf] + [1.0] * 7), (96, [])]
    assert found(spark, good + bad) == brute(good, 5, 3)


def test_wide_components_stay_exact(spark):
    rng = np.random.default_rng(3)
    rows = [(i, (v * s).tolist()) for i, (v, s) in enumerate(zip(rng.normal(size=(60, 8)), 10.0 ** rng.integers(-3, 9, (60, 1))))]
    rows += [(100, [1e30] * 8), (101, [-1e300] + [1.0] * 7), (102, [1.7e308] * 8), (103, [16384.0] * 8), (104, [-16384.1] * 8)]
    got, centroids = found(spark, rows)
    assert (got, centroids) == brute(rows, 5, 3)
    assert any(d is None for _, _, d in got)


@pytest.mark.parametrize("n", [0, 3])
def test_fewer_vectors_than_clusters(spark, n):
    rows = [(i, [float(i)] * 8) for i in range(n)]
    assert found(spark, rows) == brute(rows, 5, 3)


def test_search_equals_all_distances_and_leaves_some_out():
    rng = np.random.default_rng(4)
    points = np.floor(rng.normal(size=(200, 6)) * 40)
    points[50] = points[10]  # a tie goes to the smaller number
    x = np.floor(points[rng.integers(0, 200, 3000)] + rng.normal(size=(3000, 6)) * 3)
    number, best, took = C.search(C.build(points, np.arange(200)), points, x)
    d = C.distances(x, points)
    assert (number == d.argmin(axis=1)).all() and (best == d.min(axis=1)).all()
    assert 50 not in number
    assert took < 0.4 * d.size


def test_tree_is_rebuilt_over_each_rounds_centroids(spark):
    x = np.random.default_rng(5).normal(size=(50, 8)).tolist()
    rows = list(enumerate(x))
    assert found(spark, rows, rounds=1)[1] != found(spark, rows, rounds=2)[1]


def test_query_equals_sql(spark, sf):
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{os.path.join(sf, 'embeddings.parquet')}'")
    assert sorted(map(tuple, C.query(spark, sf).collect())) == sorted(duck.sql(C.SQL).fetchall())
