import os

import duckdb
import numpy as np
import pytest

from vacantry.llm import embedding_dedup as E


def brute(x, labels, cosine=E.COSINE):
    u = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
    link = (u @ u.T >= cosine) & (labels[:, None] == labels)
    np.fill_diagonal(link, False)
    root = np.arange(len(x))
    while True:
        new = np.minimum(root, np.where(link, root, len(x)).min(axis=1))
        if (new == root).all():
            return link.sum(axis=1).tolist(), root.tolist()
        root = new


@pytest.fixture(scope="module")
def planted():
    """Identical vectors, near copies, chains, and copies of other lengths; half of all in one label."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1200, 24)).astype(np.float32)
    x[300:380] = x[5] + 0.15 * rng.normal(size=(80, 24))
    x[400:440] = x[7]
    x[440:480] = x[8] * np.linspace(1, 3, 40)[:, None]
    for i in range(500, 560):
        x[i] = x[i - 1] + 0.25 * rng.normal(size=24)
    return x, np.where(np.arange(1200) < 600, 1, np.arange(1200) % 4)


@pytest.mark.parametrize("tile", [4096, 100, 16])
def test_equals_all_pairs(spark, planted, tile):
    x, labels = planted
    df = spark.createDataFrame([(i, v.tolist(), int(c), "a", 1.0) for i, (v, c) in enumerate(zip(x, labels))], "vec_id long, embedding array<float>, label int, digest string, n double")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in E.near_duplicates(df, tile=tile).collect()}
    counts, roots = brute(x.astype(float), labels)
    assert max(counts) > 60 and got == {i: (n, c, i == c) for i, (n, c) in enumerate(zip(counts, roots))}


def test_odd_rows(spark):
    one = [1.0, 2.0, 3.0]
    rows = [
        (1, None, 0), (2, [0.0] * 3, 0), (3, [float("nan"), 1.0, 1.0], 0), (4, [None, 1.0, 1.0], 0), (5, [float("inf"), 1.0, 1.0], 0), (6, [], 0),
        (7, one, None), (8, one, None), (10, one, 0), (10, one, 0), (11, [2.0, 4.0, 6.0], 0), (12, one, 1), (13, [1e300, 2e300, 3e300], 0), (14, [1e-300, 2e-300, 3e-300], 0),
        (15, [3.0], 0), (16, [5.0], 0), (17, [-3.0], 0), (None, one, 0), (None, [3.0, -1.0, 0.0], 0), (20, [0.0, -0.0, 1.0], 2), (21, [-0.0, 0.0, 1.0], 2),
    ]
    got = sorted((repr(r.vec_id), r.n_links, r.component_id, r.kept) for r in E.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect())
    alone = [(repr(i), 0, i, True) for i in (1, 2, 3, 4, 5, 6, 7, 8, 12, 17)]
    linked = [("10", 5, 10, True), ("10", 5, 10, True), ("11", 5, 10, False), ("13", 5, 10, False), ("14", 5, 10, False), ("None", 5, 10, False)]
    assert got == sorted([*alone, *linked, ("15", 1, 15, True), ("16", 1, 15, False), ("20", 1, 20, True), ("21", 1, 20, False), ("None", 0, None, True)])


def test_empty_table(spark):
    assert E.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).collect() == []


@pytest.mark.parametrize("d", [1, 3, 64, 3000])
def test_bound_holds_for_every_pair(d):
    """The quantised product is never further from the cosine than the bound says."""
    rng = np.random.default_rng(d)
    x = rng.normal(size=(200, d)) * 10.0 ** rng.integers(-3, 3, (200, d))
    x = E.direction(np.concatenate([x, x[:50] + 0.01 * rng.normal(size=(50, d))]))
    codes, scale, norm, lost = E.quantised(x)
    rough = E.products(codes, codes) * scale[:, None] * scale
    true = (x @ x.T) / (E.norms(x)[:, None] * E.norms(x))
    error = norm[:, None] * lost + lost[:, None] * (norm + lost)
    assert (np.abs(rough - true) <= error + 1e-12).all()


def test_few_pairs_are_computed_in_full():
    rng = np.random.default_rng(7)
    x = E.direction(rng.normal(size=(2000, 64)))
    q = E.quantised(x)
    left = sum(int(may.sum()) for _, may in E.possible(q, q, E.COSINE))
    assert left == 2000  # each vector with itself


def test_cells_out_of_reach_are_not_visited(spark):
    """Vectors in clusters: far fewer tile pairs than all."""
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(16, 32))
    x = centres[rng.integers(0, 16, 3000)] + 0.05 * rng.normal(size=(3000, 32))
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    classes = E.keyed(df, "vec_id", "embedding", "label").cache()
    codes = E.coded(classes, E.pivots_of(classes, 100), E.COSINE).cache()
    pairs = E.tile_pairs(codes, 100).select(*E.PLACE).distinct().count()
    tiles = codes.select("cell", (E.F.col("digest")).alias("x")).groupBy("cell").count().agg(E.F.sum(E.F.ceil(E.F.col("count") / 100))).first()[0]
    assert pairs < 0.3 * tiles * (tiles + 1) / 2
    got = {r.vec_id: r.n_links for r in E.near_duplicates(df, tile=100).collect()}
    assert list(dict(sorted(got.items())).values()) == brute(x, np.zeros(3000))[0]


def test_query_equals_sql(spark, sf):
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{os.path.join(sf, 'embeddings.parquet')}'")
    assert sorted(map(tuple, E.query(spark, sf).collect())) == sorted(duck.sql(E.SQL).fetchall())
