import random
from collections import defaultdict

import pytest

from vacantry.llm import mixing as M


def shared_out(sizes, weights=(5, 2, 1), cap=3):
    """Targets by repeated sharing: what is above a cap goes to the others by weight."""
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, target, capped = sum(sizes.values()), {}, set()
    while True:
        left = total - sum(cap * sizes[s] for s in capped)
        free = [s for s in names if s not in capped]
        target = {s: left * w[s] / sum(w[f] for f in free) for s in free} | {s: cap * sizes[s] for s in capped}
        above = {s for s in free if target[s] > cap * sizes[s]}
        if not above:
            return target
        capped |= above


def docs(spark, seed=1, n=1500):
    rng = random.Random(seed)
    rows = [(i, None if i % 97 == 0 else "w " * rng.randrange(0, 90), rng.choice(["a"] * 40 + ["b", "c", "ä", "z", "Z", None])) for i in range(n)]
    return rows, spark.createDataFrame([(i, t, s, 5.0) for i, t, s in rows], "doc_id long, text string, source string, target double")


def test_targets_and_takes(spark, monkeypatch):
    monkeypatch.setattr(M, "SLOT_ROWS", 16)  # many slots
    rows, df = docs(spark)
    out = M.mix(M.sized(df)).collect()
    sizes, taken = defaultdict(int), defaultdict(int)
    source = {i: s for i, _, s in rows}
    for i, t, s in rows:
        sizes[s] += len((t or "").split())
    want = shared_out(sizes)
    for r in out:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and r.target == pytest.approx(want[s]) and 0 <= r.taken <= 3 * r.size
        taken[s] += r.taken
    assert len(out) == len(rows)
    assert all(abs(taken[s] - want[s]) <= 90 for s in sizes)
    assert sorted(map(tuple, M.mix(M.sized(df.repartition(7))).collect())) == sorted(map(tuple, out))


def test_whole_epochs_come_first(spark):
    """Two sources, 450 and 550 words: targets 714 and 286 (5 to 2), so each of the first stands once and some twice."""
    df = spark.createDataFrame([(i, "w " * 10, "a" if i < 45 else "b") for i in range(100)], "doc_id long, text string, source string")
    copies = {r.doc_id: r.copies for r in M.mix(M.sized(df)).collect()}
    a, b = [copies[i] for i in range(45)], [copies[i] for i in range(45, 100)]
    assert set(a) == {1, 2} and abs(sum(a) * 10 - 5000 / 7) <= 10
    assert set(b) == {0, 1} and abs(sum(b) * 10 - 2000 / 7) <= 10


def test_slots_hold_about_as_many_rows(spark):
    """Whatever the qualities, no slot of a source holds many times the average."""
    for low in (0.05, 0.25, 1.0):
        rows = spark.range(40000).selectExpr("'s' AS `group`", f"{low} + (1 - {low}) * (id % 7) / 7 AS quality", "-ln((xxhash64(id) % 1000000 + 1000000.5) / 2000000) AS e")
        keyed = rows.selectExpr("`group`", "quality", "e / quality AS `order`").join(M.spread(rows), "group")
        below = M.below("order")
        fullest = keyed.groupBy((below * 40).cast("int")).count().agg({"count": "max"}).first()[0]
        assert fullest < 2000


def test_heavier_quality_is_taken_more_often(spark):
    rows = [(i, "a" if i % 2 else "b", 10, 0.9 if i % 4 < 2 else 0.1) for i in range(4000)]
    out = M.mix(spark.createDataFrame(rows, "doc_id long, source string, size long, quality double")).collect()
    a = [r for r in out if r.doc_id % 2 == 0]  # the source of the small weight is taken in part
    share = lambda k: sum(r.copies for r in a if (r.doc_id % 4 < 2) == k)
    assert share(True) > 2 * share(False)


def test_empty_and_wordless_tables(spark):
    assert M.mix(M.sized(spark.createDataFrame([], "doc_id long, text string, source string"))).collect() == []
    out = M.mix(M.sized(spark.createDataFrame([(1, None, None), (2, "", "a")], "doc_id long, text string, source string"))).collect()
    assert sorted((r.doc_id, r.size, r.taken) for r in out) == [(1, 0, 0), (2, 0, 0)]


def test_stage_repeats_documents(spark):
    rows, df = docs(spark, n=300)
    df = df.selectExpr("doc_id", "text", "'en' AS lang", "source", "1L AS n_chars")
    counts = defaultdict(int)
    for r in M.stage(spark, df, "").collect():
        counts[r.doc_id] += 1
    assert dict(counts) == {r.doc_id: r.copies for r in M.mix(M.sized(df)).collect() if r.copies}
