import numpy as np
import pytest
from pyspark.sql import functions as F

from vacantry.llm import neighbours as N


def brute(rows, step, k):
    ok = {i: np.array(v, float) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v) and len(v) == 16}
    out = {}
    for q in ok:
        if q % step == 0:
            out[q] = sorted(((-(ok[q] * v).sum(), i) for i, v in ok.items() if i != q))[:k]
    return out


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(0)
    x = (rng.normal(size=(600, 16)) * rng.uniform(0.5, 2, (600, 1))).astype(np.float32)
    x[300:420] = x[7]  # many identical vectors
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    return [*rows, (700, None), (720, [0.0] * 16), (740, [float("nan")] * 16), (760, [None] * 16), (780, [1.0]), (800, [float("inf")] + [1.0] * 15), (None, [1.0] * 16)]


def test_recall_scores_and_ties(spark, rows):
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, rank int, v string")
    got = {}
    for r in N.search(df).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    want, hit, total = brute(rows, 20, 20), 0, 0
    assert set(got) == set(want)
    vectors = {i: np.array(v, float) for i, v in rows if i is not None and i < 700}
    for q, best in got.items():
        assert [r for r, _, _ in best] == list(range(1, 21))
        assert all(s == pytest.approx((vectors[q] * vectors[i]).sum()) for _, i, s in best)
        assert [(-s, i) for _, i, s in best] == sorted((-s, i) for _, i, s in best)
        hit += len({i for _, i, _ in best} & {i for _, i in want[q]})
        total += 20
    assert hit / total >= 0.9
    # a query among identical vectors gets the smallest others
    assert [i for _, i, _ in got[320]] == [i for _, i in want[320]]


def test_few_candidates(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [1.0, 1.0])], "vec_id long, embedding array<double>")
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in N.search(df).orderBy("rank").collect()] == [(0, 1, 1, 1.0), (0, 2, 2, 1.0)]


def found(spark, x):
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in N.search(df).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    return got


def test_few_candidates_are_all_found(spark):
    """Fewer vectors than asked for, far apart: every query gets all the others."""
    x = np.random.default_rng(3).normal(size=(15, 64))
    x[:, 0] *= np.arange(1, 16)
    got = found(spark, x)
    assert got == {0: sorted(range(1, 15), key=lambda i: -(x[0] * x[i]).sum())}


def test_a_long_vector_leaves_no_query_short(spark):
    """One vector 100 times as long: every query still gets 20, and recall stays."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 64))
    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
    x[1] *= 100
    x[20] = -x[1] / 100
    got, hit = found(spark, x), 0
    assert set(got) == set(range(0, 3000, 20)) and all(len(best) == 20 for best in got.values())
    for q, best in got.items():
        s = x @ x[q]
        s[q] = -np.inf
        hit += len(set(np.argsort(-s)[:20].tolist()) & set(best))
    assert hit / (20 * len(got)) >= 0.95


def recall(got, x):
    hit = 0
    for q, best in got.items():
        s = x @ x[q]
        s[q] = -np.inf
        hit += len(set(np.argsort(-s)[:20].tolist()) & set(best))
    return hit / (20 * len(got))


@pytest.mark.parametrize("kind", ["isotropic", "log-normal lengths", "clusters"])
def test_recall_and_full_lists(spark, kind):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(4000, 64))
    if kind == "log-normal lengths":
        x *= rng.lognormal(0, 1, (4000, 1)) / np.sqrt((x * x).sum(axis=1, keepdims=True))
    if kind == "clusters":
        x = 3 * rng.normal(size=(50, 64))[rng.integers(0, 50, 4000)] + 0.5 * x
        x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
    got = found(spark, x)
    assert set(got) == set(range(0, 4000, 20)) and all(len(best) == 20 for best in got.values())
    assert recall(got, x) >= 0.9


def comparisons(spark, x):
    """Comparisons of a query, as a share of all vectors, with the settings that the operator chooses."""
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, v array<double>")
    kept = N.layered(df).cache()
    asked = df.where("vec_id % 20 = 0").cache()
    layers, count = N.settings(asked, kept, 20)
    sizes = N.index(kept, layers).groupBy("t", "key").count()
    met = N.probes(asked, layers, count).join(sizes, ["t", "key"]).agg({"count": "sum"}).first()[0]
    return met / asked.count() / len(x)


def test_comparisons_shrink_as_a_share(spark):
    rng = np.random.default_rng(7)
    centres = 3 * rng.normal(size=(400, 64))

    def made(n):
        x = centres[rng.integers(0, 400, n)] + 0.7 * rng.normal(size=(n, 64))
        return x / np.sqrt((x * x).sum(axis=1, keepdims=True))

    small, large = comparisons(spark, made(5000)), comparisons(spark, made(20000))
    assert large < 0.75 * small and large < 0.2


def test_empty_table(spark):
    assert N.search(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


def test_perturbations_come_in_order_of_their_scores():
    inside = np.array([0.1, 0.45, 0.8])
    changes = N.perturbations(inside, 12)
    score = lambda c: sum(inside[i] ** 2 if d < 0 else (1 - inside[i]) ** 2 for i, d in enumerate(c) if d)
    import itertools

    every = sorted(score(c) for c in itertools.product([-1, 0, 1], repeat=3))
    assert [score(c) for c in changes] == pytest.approx(every[:12])
    assert len({tuple(c) for c in changes}) == 12


def test_a_draw_takes_few_rows_to_one_place(spark):
    """The vectors with the least hashes, of which most partitions hand on hardly any."""
    ids = spark.range(0, 100_000, 1, 16).select(F.col("id").alias("vec_id"))
    every = ids.orderBy(F.xxhash64("vec_id"), "vec_id")
    for count in (64, 4096):
        few = N.drawn(ids, count, 100_000)
        assert [r.vec_id for r in few.collect()] == [r.vec_id for r in every.limit(count).collect()]
        bound = few._jdf.queryExecution().optimizedPlan().toString()
        assert "Filter" in bound and N.drawn(ids, count, 1000).count() == count


def test_nothing_that_grows_is_copied_to_the_driver(spark, monkeypatch):
    """A query of a small file visits hundreds of buckets: no join copies a side to all tasks for the size of its file."""
    plans, written = [], N.written
    plan_of = lambda df: df._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(N, "written", lambda df, name: plans.append(plan_of(df)) or written(df, name))
    x = np.random.default_rng(8).normal(size=(600, 16))
    found = N.search(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>"))
    plans.append(plan_of(found))
    assert sum("SortMergeJoin" in p for p in plans) >= 4 and not any("Broadcast" in p for p in plans)
    assert found.count() == 30 * 20
