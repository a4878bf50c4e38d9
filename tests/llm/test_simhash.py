import itertools
import random

import numpy as np
import pytest
import xxhash

from vacantry.llm import simhash as S
from vacantry.llm.common import connected_components, signed


def brute_fp(text, n=3):
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w)] if 0 < len(w) < n else [b" ".join(w[k : k + n]) for k in range(len(w) - n + 1)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes)) if hashes else 0


def classes(ids, fps, distance=2):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(ids)), 2):
        if (fps[a] ^ fps[b]).bit_count() <= distance:
            x, y = sorted((find(ids[a]), find(ids[b])))
            parent[y] = x
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("text", [None, "", " \n\t", "one", "One two", "a b c", "Äpfel ÄPFEL a a a a b", "x " * 3000, "  odd\x0bspace\x0c here \x1c stays"])
def test_fingerprint(text):
    assert S.fingerprint(text) == brute_fp(text)


def test_spark_xxhash64_is_the_same_hash(spark):
    from pyspark.sql import functions as F

    got = spark.createDataFrame([("a b c",)], "s string").select(F.xxhash64("s")).first()[0]
    assert got == signed(xxhash.xxh64_intdigest(b"a b c", 42))


@pytest.mark.parametrize("bucket, distance", [(64, 2), (2, 2), (64, 6), (2, 6)])
def test_classes_equal_brute_force(spark, bucket, distance):
    """Chains and a crowd of near copies; with a small bucket the crowd is parted."""
    rng = random.Random(5)
    fps = [rng.getrandbits(64) for _ in range(60)]
    for _ in range(4):
        fps += [f ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for f in rng.sample(fps, 25)]
    fps = sorted(set(fps))
    df = spark.createDataFrame([(signed(f), i) for i, f in enumerate(fps)], "fp long, least long")
    pairs = S.near_pairs(df, distance, bucket)
    for a, b in pairs.distinct().collect():
        assert 0 < (a % (1 << 64) ^ b % (1 << 64)).bit_count() <= distance
    roots = {r.node: r.root for r in connected_components(pairs).collect()}
    want, seen = classes(range(len(fps)), fps, distance), {}
    for i, f in enumerate(fps):
        seen.setdefault(want[i], set()).add(roots.get(signed(f), signed(f)))
    assert all(len(v) == 1 for v in seen.values()) and len({next(iter(v)) for v in seen.values()}) == len(seen)


def test_forest_connects_with_few_links():
    rng = random.Random(4)
    fps = sorted({sum(1 << rng.randrange(64) for _ in range(3)) % (1 << 64) for _ in range(400)} | {rng.getrandbits(64) for _ in range(50)})
    links = [(int(a), int(b)) for a, b in S.forest(np.array(fps, np.uint64), 6)]
    assert all((a ^ b).bit_count() <= 6 for a, b in links)
    want = classes(fps, fps, 6)
    assert len(links) == len(fps) - len(set(want.values()))
    assert all(want[a] == want[b] for a, b in links)


def test_documents(spark):
    body = " ".join(f"w{i}" for i in range(400))
    texts = [None, "", "one", "ONE", body, body + " tail", body, "quite other words stand here", " "]
    df = spark.createDataFrame([(i + 1, t, "x") for i, t in enumerate(texts)] + [(3, "one", "x")], "doc_id long, text string, fp string")
    got = sorted((r.doc_id, r.fingerprint, r.component_id) for r in S.simhash_dedup(df).collect())
    rows = [(i + 1, t) for i, t in enumerate(texts)] + [(3, "one")]
    ids = sorted({i for i, _ in rows})
    by = {i: brute_fp(t) for i, t in rows}
    comp = classes(ids, [by[i] for i in ids])
    assert got == sorted((i, f"{by[i]:016x}", comp[i]) for i, _ in rows)


def test_empty_table(spark):
    assert S.simhash_dedup(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_thresholds_by_dynamic_programming():
    rng = random.Random(1)
    costs = [[0.0, *sorted(rng.random() for _ in range(3))] for _ in range(3)]
    best = min(
        (sum(costs[k][t + 1] for k, t in enumerate(ts)), list(ts)) for ts in itertools.product(range(-1, 3), repeat=3) if sum(ts) == 2 - 3 + 1
    )
    assert S.allocate(costs, 2) == (pytest.approx(best[0]), best[1])


def test_groups_hold_correlated_bits():
    rng = np.random.default_rng(0)
    half = rng.integers(0, 2, (4000, 32))
    bits = np.concatenate([half, half], axis=1)  # bit k and bit k + 32 are equal
    groups = S.correlated_groups((bits.T @ bits).astype(float), len(bits), 2)
    assert sorted(b for g in groups for b in g) == list(range(64))
    assert all((b + 32) % 64 in g for g in groups for b in g)


def test_components_of_a_long_chain(spark):
    n = 70
    order = list(range(n))
    random.Random(2).shuffle(order)
    edges = spark.createDataFrame([(order[i], order[i + 1]) for i in range(n - 1)] + [(200, 201), (5, 5)], "a long, b long")
    got = {r.node: r.root for r in connected_components(edges).collect()}
    assert got == {**{i: 0 for i in range(1, n)}, 201: 200}
