import itertools
import math

import numpy as np
import pytest

from vacantry.llm import toxicity as X
from vacantry.llm.text_words import PUNCTUATION


def test_marginals_equal_enumeration():
    field, rng = X.Field(), np.random.default_rng(0)
    field.move = rng.normal(size=(2, 2))
    sizes = [0, 1, 5, 3, 0, 7]
    starts = np.concatenate([[0], np.cumsum(sizes)])
    u = rng.normal(size=starts[-1]) * 2
    got = field.marginals(u, starts)
    for a, b in zip(starts, starts[1:]):
        total, toxic = 0.0, np.zeros(b - a)
        for y in itertools.product([0, 1], repeat=b - a):
            p = np.exp(sum(u[a + t] * v for t, v in enumerate(y)) + sum(field.move[v, w] for v, w in zip(y, y[1:])))
            total += p
            toxic += p * np.array(y)
        assert got[a:b] == pytest.approx(toxic / total)


@pytest.fixture(scope="module")
def tables(spark):
    rng = np.random.default_rng(1)
    plain = [f"word{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(400):
        w = list(rng.choice(plain, 40))
        if i % 4 == 0:
            w[int(rng.integers(40))] = "Vilest!"
            w[int(rng.integers(40))] = "grobian,"
        rows.append((i, " ".join(w)))
        labels.append((i, int(i % 4 == 0)))
    odd = [(900, None), (901, ""), (902, "vilest " * 20000), (903, "vilest"), (903, "vilest"), (None, "grobian")]
    docs = spark.createDataFrame([(i, t, 0.0) for i, t in rows + odd], "doc_id long, text string, score double")
    return docs, spark.createDataFrame([*labels, (901, None), (5, None)], "doc_id long, toxic int"), rows


def test_finds_toxic_documents_and_words(spark, tables):
    docs, labels, rows = tables
    got = X.score(docs, X.train(docs.dropDuplicates(["doc_id"]).where("doc_id < 900"), labels)).collect()
    assert len(got) == len(rows) + 6
    by = {r.doc_id: r for r in got}
    assert all((by[i].score >= 0.5) == (i % 4 == 0) for i, _ in rows)
    assert [by[i].score >= 0.5 for i in (900, 901, 902, 903, None)] == [False, False, True, True, True]
    text = dict(rows)[0]
    assert sorted(text[s["start"] : s["start"] + s["length"]] for s in by[0].spans) == ["Vilest!", "grobian,"]
    assert by[1].spans == [] and len(by[902].spans) == 20000


def test_one_class_scores_zero(spark, tables):
    docs, labels, _ = tables
    field = X.train(docs, labels.where("toxic = 0"))
    assert field is None and {r.score for r in X.score(docs, field).collect()} == {0.0}


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert X.score(docs, X.train(docs, spark.createDataFrame([], "doc_id long, toxic int"))).collect() == []


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = X.query(spark, sf).toPandas().merge(spark.read.parquet(f"{sf}/labels.parquet").toPandas(), on="doc_id")
    held = got[got.held_out]
    assert (held.predicted == held.toxic).mean() > 0.93
    assert held[held.toxic == 1].score.mean() > 0.5 > 0.2 > held[held.toxic == 0].score.mean()


def plain_score(field, text):
    """One text, word by word: scaled forward and backward sums, then the document's inputs."""
    words = [w.lower().strip(PUNCTUATION) for w in X.WORD.findall(text or "")]
    u = [min(30, max(-30, field.emission(X.hashed([w]))[0])) for w in words]
    e, m = [(1.0, math.exp(x)) for x in u], np.exp(field.move)
    forward, back = [], [np.ones(2)]
    for t, own in enumerate(e):
        f = np.array(own) * (1 if t == 0 else forward[-1] @ m)
        forward.append(f / f.sum())
    for own in e[:0:-1]:
        b = m @ (np.array(own) * back[0])
        back.insert(0, b / b.sum())
    toxic = [(f * b)[1] / (f * b).sum() for f, b in zip(forward, back)]
    inputs = np.array([1, max(toxic, default=0), math.log1p(sum(toxic)), math.log1p(1000 * sum(toxic) / (20 + len(toxic)))])
    return 1 / (1 + math.exp(-min(30, max(-30, inputs @ field.doc)))), [k for k, p in enumerate(toxic) if p >= 0.5]


def test_scores_equal_plain_loops(spark, sf):
    """The query's scores and spans, against a version that reads one text after the other."""
    from vacantry.llm.language_id import held_out

    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    field = X.train(docs, labels.where(~held_out("doc_id", 5, 0)))
    got = {r.doc_id: r for r in X.query(spark, sf).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert set(got) == set(texts)
    for i, text in texts.items():
        score, hits = plain_score(field, text)
        assert got[i].score == pytest.approx(score, abs=1e-6) and got[i].predicted == int(got[i].score >= 0.5)
        at = [m.span() for m in X.WORD.finditer(text or "")]
        assert [(s["start"], s["start"] + s["length"]) for s in got[i].spans] == [at[k] for k in hits]
