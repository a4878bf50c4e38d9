import random
import re
from collections import Counter

import numpy as np
import pytest

from vacantry.llm import substring_dedup as D


def brute(texts, span):
    words = {i: re.findall(r"[^\x20\x09-\x0d]+", t or "") for i, t in texts}
    counts = Counter(tuple(w[k : k + span]) for w in words.values() for k in range(len(w) - span + 1))
    out = {}
    for i, w in words.items():
        gone = set()
        for k in range(len(w) - span + 1):
            if counts[tuple(w[k : k + span])] > 1:
                gone.update(range(k, k + span))
        out[i] = (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))
    return out


def corpus(seed, vocabulary, n, passage):
    rng = random.Random(seed)
    make = lambda k: [f"w{rng.randrange(vocabulary)}" for _ in range(k)]
    shared = [make(passage) for _ in range(3)]
    texts = []
    for i in range(n):
        w = make(rng.randrange(0, 120))
        for _ in range(rng.randrange(3)):
            at, s = rng.randrange(len(w) + 1), rng.choice(shared)
            w[at:at] = s[rng.randrange(5) :]
        texts.append((i, " ".join(w)))
    return texts


@pytest.mark.parametrize(("seed", "vocabulary", "span"), [(1, 10**6, 35), (2, 3, 35), (3, 2, 20), (4, 50, 8)])
def test_equals_brute_force(spark, monkeypatch, seed, vocabulary, span):
    monkeypatch.setattr(D, "BUCKET_BYTES", 4000)  # several buckets
    texts = corpus(seed, vocabulary, 60, 60)
    texts += [(100, None), (101, ""), (102, "same " * 200), (103, "a b " * 90), (104, " \t lead  and trail \n"), (105, "ß\x1cü " * 40)]
    df = spark.createDataFrame([(i, t, "b") for i, t in texts], "doc_id long, text string, bucket string")
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in D.substring_dedup(df, span=span).collect()}
    assert got == brute(texts, span)


def test_symbols_depend_on_their_span_only():
    """The same words stand in other surroundings: every symbol whose span lies within them forms again."""
    rng = np.random.default_rng(3)
    inner = rng.integers(0, 40, 60).astype(np.uint64)
    for k in range(20):
        made = []
        for left, right in ((k, 7), (3 * k + 1, 11)):
            ids = np.concatenate([rng.integers(0, 40, left), inner, rng.integers(0, 40, right)]).astype(np.uint64)
            name, size, lo, hi = D.symbols(ids, np.zeros(len(ids), np.int64))
            inside = (lo >= left) & (hi <= left + len(inner))
            made.append({(n, s, a - left, b - left) for n, s, a, b in zip(name.tolist(), size.tolist(), lo.tolist(), hi.tolist()) if a >= left and b <= left + len(inner)})
            assert inside.any()
        assert made[0] == made[1]


def test_empty_table(spark):
    assert D.substring_dedup(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_repeated_rows_repeat_each_other(spark):
    text = " ".join(f"u{i}" for i in range(50))
    df = spark.createDataFrame([(1, text), (1, text)], "doc_id long, text string")
    assert [(r.n_words, r.n_removed, r.kept_text) for r in D.substring_dedup(df).collect()] == [(50, 50, "")] * 2
