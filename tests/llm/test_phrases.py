import os
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from vacantry.llm import phrases as P

NAMES = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute(rows, longest=3, least=10, share=50, best=2000):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", lowered(text)):
            ws = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(ws)
            f.update((lang, *ws[i : i + k]) for k in range(1, longest + 1) for i in range(len(ws) - k + 1))
    candidates = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    most = Counter()
    for (lang, *ws), a in candidates.items():
        for k in range(2, len(ws)):
            for i in range(len(ws) - k + 1):
                inner = (lang, *ws[i : i + k])
                most[inner] = max(most[inner], a)
    scored = {}
    for (lang, *ws), a in candidates.items():
        if 100 * most[(lang, *ws)] < share * a:
            cuts = [(1000000 * a * a // (f[(lang, *ws[:k])] * f[(lang, *ws[k:])]), k) for k in range(1, len(ws))]
            score, k = min(cuts)
            scored.setdefault(lang, []).append((-score, -a, " ".join(ws).encode(), f[(lang, *ws[:k])], f[(lang, *ws[k:])]))
    return sorted((g, i, p.decode(), -a, left, right, n[g], -s) for g, all_ in scored.items() for i, (s, a, p, left, right) in enumerate(sorted(all_)[:best], 1))


def found(spark, rows, **options):
    df = spark.createDataFrame([(*r, "x", 7) for r in rows], "lang string, text string, phrase string, n int")
    return sorted(tuple(r[c] for c in NAMES) for r in P.collocations(df, **options).collect())


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    words = np.array(["a", "b", "C", "d", "é", "New", "york", "city", "x-1", "ﬁ", "the"])
    marks = np.array([" ", " ", " ", " ", "\t", ", ", ".", "\n", "  ", "; ", " "])
    rows = []
    for k in range(300):
        size = int(rng.integers(0, 40))
        text = "".join(w + m for w, m in zip(rng.choice(words, size, p=rng.dirichlet(np.ones(11))), rng.choice(marks, size)))
        rows.append((["en", "de", None, "und"][k % 4], text + (" New York City" if k % 3 == 0 else "")))
    return [*rows, ("en", None), ("en", ""), (None, None), ("fr", "only once"), ("en", " ... ,,, \t"), rows[0], rows[0]]


@pytest.mark.parametrize("shard_bytes", [200, 1 << 24])
@pytest.mark.parametrize("longest", [2, 3, 4])
def test_equals_counting_in_python(spark, rows, longest, shard_bytes):
    got = found(spark, rows, longest=longest, shard_bytes=shard_bytes)
    assert len(got) > 50 and got == brute(rows, longest)


def test_best_and_ties(spark):
    rows = [("en", f"{w} {w}z.") for w in ("b", "a", "é", "z", "A") for _ in range(10)]
    assert found(spark, rows, best=3) == brute(rows, best=3) and len(brute(rows, best=3)) == 3


def test_covered_phrases_go_even_if_the_longer_one_goes(spark):
    rows = [("en", "p q r")] * 20 + [("en", "p q")] * 20 + [("en", "q r s")] * 5
    got = found(spark, rows)
    assert got == brute(rows) and {r[2] for r in got} == {"p q r"}


def test_very_long_text_and_word(spark):
    rows = [("en", "one two three " * 60000 + "w" * 300000), ("en", "two three")]
    assert found(spark, rows, shard_bytes=1000) == brute(rows)


def test_empty_table(spark):
    assert found(spark, []) == [] and found(spark, [(None, None)]) == []


def test_large_counts_stay_exact(spark):
    df = spark.createDataFrame([("en", 1, "u", 10**13), ("en", 1, "v", 10**13 + 3), ("en", 2, "u v", 10**13 - 1)], P.COUNTED)
    real, P.frequent = P.frequent, lambda *_: df
    try:
        row = P.collocations(spark.createDataFrame([], "lang string, text string")).first()
    finally:
        P.frequent = real
    a = 10**13 - 1
    assert row.score == 1000000 * a * a // (10**13 * (10**13 + 3)) and row.n == 2 * 10**13 + 3


def test_intervals_of_both_indexes_hold_the_same_phrase():
    """A phrase's interval in either index has as many rows as the phrase has places."""
    rng = np.random.default_rng(5)
    text = " ".join(rng.choice(["a", "b", "c", "d."], 500))
    shard = P.shard_of(pa.array(["en"]), pa.array([text]))
    seq, words = shard.seq, shard.words.to_pylist()
    forward = sorted(range(len(seq)), key=lambda i: [*np.roll(seq, -i)[:3].tolist(), i])
    backward = sorted(range(len(seq)), key=lambda i: [*np.roll(seq[::-1], -i)[:3].tolist(), i])
    for level in P.levels(shard, {}, 3):
        k = level.words.shape[1]
        for own, lo, lo_back, n in zip(level.words.tolist(), level.lo, level.lo_back, level.n):
            assert {tuple(np.roll(seq, -i)[:k]) for i in forward[lo : lo + n]} == {tuple(own)}
            assert {tuple(np.roll(seq[::-1], -i)[:k]) for i in backward[lo_back : lo_back + n]} == {tuple(own[::-1])}
            found = len(re.findall("(?=(?<![^ .])" + re.escape(" ".join(words[w - 1] for w in own)) + "(?![^ .]))", text)) if k == 1 else n
            assert n == found


def test_query_equals_sql(spark, sf):
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW documents AS SELECT * FROM '{os.path.join(sf, 'documents.parquet')}'")
    assert sorted(tuple(r[c] for c in NAMES) for r in P.query(spark, sf).collect()) == sorted(duck.sql(P.SQL).fetchall())
