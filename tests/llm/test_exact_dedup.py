import hashlib
import random

import pyarrow as pa
import pytest

from vacantry.llm import exact_dedup as E

LONG = "".join(f"word{i * i % 977} " for i in range(20000))
TEXTS = [None, "", "a", "a", "a ", "A", LONG, LONG, LONG + "x", "x" + LONG, "ü\n", "ü\n", " ", "0" * 70000, "0" * 70000]


def brute(rows):
    out = []
    for i, t in rows:
        own = [j for j, u in rows if (u or "") == (t or "")]
        known = [j for j in own if j is not None]
        out.append((i, max(known, default=None), len(own), i == max(known, default=None), hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("id_bytes", [16, 3])
def test_groups_equal_brute_force(spark, id_bytes):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(3, "a"), (None, "only"), (None, "a")]
    df = spark.createDataFrame([(i, t, "k", True) for i, t in rows], "doc_id long, text string, recipe string, kept boolean")
    assert sorted((tuple(r) for r in E.exact_dedup(df, id_bytes=id_bytes).collect()), key=repr) == brute(rows)


def test_unverifiable_identifiers_raise(spark):
    df = spark.createDataFrame([(i, f"text {i}") for i in range(600)], "doc_id long, text string")
    with pytest.raises(RuntimeError):
        E.exact_dedup(df, id_bytes=1)


def test_empty_table(spark):
    assert E.exact_dedup(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_chunks_follow_content():
    rng = random.Random(1)
    text = " ".join(str(rng.randrange(10**6)) for _ in range(20000))
    one, two = (next(iter(E.chunked(pa.array([t])))) for t in (text, "inserted " + text))
    assert b"".join(one).decode() == text and b"".join(two).decode() == "inserted " + text
    assert len(set(map(bytes, one)) & set(map(bytes, two))) >= len(one) - 3
    assert all(len(c) <= E.MAX_BYTES for c in one)


def test_stage_keeps_one_row_of_each_text(spark):
    df = spark.createDataFrame([(i, t, None, "s", 1) for i, t in enumerate(TEXTS)], "doc_id long, text string, lang string, source string, n_chars long")
    out = E.stage(spark, df, "")
    assert out.columns == df.columns
    assert sorted(r.text or "" for r in out.collect()) == sorted({t or "" for t in TEXTS})
