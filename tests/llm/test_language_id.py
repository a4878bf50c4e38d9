import re

import numpy as np
import pytest

from vacantry.llm import language_id as L
from vacantry.llm.text_words import PUNCTUATION


@pytest.mark.parametrize("name", ["fx", "fg", "fc", "bx", "bg", "bc", "out", "bias"])
def test_gradients_equal_differences(name):
    """Backpropagation through time against small differences, in double precision."""
    net = L.Network(3, hidden=4, seed=2)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    rng = np.random.default_rng(0)
    x, y = rng.integers(97, 101, (5, 6)).astype(np.uint8), np.array([0, 1, 2, 0, 1])
    grad = net.gradients(x, y)[1][name]
    for _ in range(6):
        at = tuple(rng.integers(0, n) for n in grad.shape)
        if name[1:] == "x":
            at = (int(rng.integers(97, 101)), at[1])
        old, step = net.w[name][at], 1e-3
        net.w[name][at] = old + step
        up = net.gradients(x, y)[0]
        net.w[name][at] = old - step
        down = net.gradients(x, y)[0]
        net.w[name][at] = old
        assert grad[at] == pytest.approx((up - down) / (2 * step), rel=0.03, abs=2e-4)


@pytest.fixture(scope="module")
def rows():
    words = {"xx": ["kolo", "mika", "suta", "pola"], "yy": ["brent", "stark", "kreng", "glump"]}
    rng = np.random.default_rng(1)
    return [(i, " ".join(rng.choice(words[lang], 12)), lang) for i in range(120) for lang in [["xx", "yy"][i % 2]]]


def test_learns_and_handles_odd_rows(spark, rows, monkeypatch):
    monkeypatch.setattr(L, "STEPS", 120)
    odd = [(1000, None, "xx"), (1001, "", "yy"), (1002, "123 ... !!", None), (1003, "Kolo " * 30000, None), (1004, "brent" * 3000, None), (None, "mika suta", None), (1005, "kolo", None), (1005, "kolo", None)]
    df = spark.createDataFrame([(i, t, lang, "s") for i, t, lang in [*rows, *odd]], "doc_id long, text string, lang string, score string")
    net, languages = L.train(df)
    got = [r for r in L.identify(df, net, languages).collect()]
    assert len(got) == len(rows) + len(odd) and languages == ["xx", "yy"]
    by = {r.doc_id: r for r in got}
    assert all(by[i].lang_pred == lang and 0.5 < by[i].score <= 1 for i, _, lang in rows)
    assert [by[i].lang_pred for i in (1000, 1001, 1002, 1003, 1004, None)] == ["und", "und", "und", "xx", "yy", "xx"]
    assert by[1000].score == 0


def test_nothing_learned(spark):
    df = spark.createDataFrame([(1, "text", None)], "doc_id long, text string, lang string")
    net, languages = L.train(df)
    assert [(r.lang_pred, r.score) for r in L.identify(df, net, languages).collect()] == [("und", 0.0)]


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert L.identify(df, *L.train(df)).collect() == []


def test_held_out_accuracy(spark, sf):
    got = L.query(spark, sf).toPandas().merge(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").toPandas(), on="doc_id")
    held = got[got.held_out]
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count() and len(held) > 20
    assert (held.lang == held.lang_pred).mean() > 0.97


def test_stage_rejects_texts_without_letters(spark, rows, monkeypatch):
    monkeypatch.setattr(L, "STEPS", 60)
    df = spark.createDataFrame([(i, t, lang, "s", 1) for i, t, lang in rows] + [(500, None, "xx", "s", 0), (501, "42 - 43", None, "s", 7)], "doc_id long, text string, lang string, source string, n_chars long")
    out = L.stage(spark, df, "")
    assert out.columns == df.columns and {r.doc_id for r in out.collect()} == {i for i, _, _ in rows}


def plain_prediction(net, languages, text):
    """One text, byte by byte: both directions over each word, log probabilities at every position, pooled."""
    sig = lambda v: 1 / (1 + np.exp(-v))
    words = [w.lower().strip(PUNCTUATION).encode() for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    total = np.zeros(len(languages))
    for word in words:
        at = []
        for part in (word[k : k + L.LONGEST] for k in range(0, len(word), L.LONGEST)):
            states = {}
            for d, order in (("f", range(len(part))), ("b", range(len(part) - 1, -1, -1))):
                h = np.zeros(net.hidden)
                for t in order:
                    a, k = net.w[d + "x"][part[t]].astype(float), net.hidden
                    gates = sig(a[: 2 * k] + h @ net.w[d + "g"])
                    c = np.tanh(a[2 * k :] + (gates[k:] * h) @ net.w[d + "c"])
                    h = h + gates[:k] * (c - h)
                    states[d, t] = h
            for t in range(len(part)):
                o = np.concatenate([states["f", t], states["b", t]]) @ net.w["out"] + net.w["bias"]
                at.append(o - o.max() - np.log(np.exp(o - o.max()).sum()))
        if at:
            total += np.mean(at, axis=0)
    total *= min(1, L.EVIDENCE / max(len(words), 1))
    p = np.exp(total - total.max())
    p /= p.sum()
    return (languages[int(p.argmax())], float(p.max())) if any(ch.isalpha() for ch in text or "") else ("und", 0.0)


def test_predictions_equal_plain_loops(spark, sf):
    """The query's predictions, against a version that reads one byte after the other."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    net, languages = L.train(docs.where(~L.held_out("doc_id", 4, 2)))
    got = {r.doc_id: r for r in L.query(spark, sf).collect()}
    for r in docs.where("length(text) < 3000 OR text IS NULL").orderBy("doc_id").limit(60).collect():
        lang, score = plain_prediction(net, languages, r.text)
        assert got[r.doc_id].lang_pred == lang and got[r.doc_id].score == pytest.approx(score, abs=2e-3)


def test_more_languages_than_are_learned(spark, monkeypatch):
    """Labels beyond the bound don't stop the run: the most frequent are learned."""
    monkeypatch.setattr(L, "STEPS", 10)
    monkeypatch.setattr(L, "MOST_LANGUAGES", 3)
    rows = [(i, f"kolo mika {i}", f"l{i % 6}" if i < 60 else f"l{i % 3}") for i in range(120)]
    net, languages = L.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert languages == ["l0", "l1", "l2"] and len(net.w["bias"]) == 3
