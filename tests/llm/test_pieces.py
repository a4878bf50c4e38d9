import itertools
import random

import pyarrow as pa
import pytest

from vacantry.llm import pieces as P

TEXTS = [
    None, "", " ", "  ", "a", " a", "a  b", "tail ", "Hello, world!\nNew line.\tTab", "x▁y ▁ z", "日本語のテキスト 🙂🙂", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaa" * 8, "<s>control</s> <unk> <0x0A>", "Übergrößenträger naïve façade",
    "1234567890 3.14e-10", "\x00\x07 odd", "é combined", "ab" * 300 + " end", "     five", "quick brown fox " * 50, " nbsp wide",
]


def test_equals_the_library_and_decodes(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=P.default_path())
    df = spark.createDataFrame([(i, t, "u", [1]) for i, t in enumerate(TEXTS)], "doc_id long, text string, unit string, ids array<int>")
    got = {r.doc_id: r for r in P.encode(df, decoding=True).withColumnRenamed("decoded", "same").transform(P.decode).collect()}
    for i, t in enumerate(TEXTS):
        assert got[i].ids == sp.encode(t or ""), t
        if "▁" not in (t or ""):
            assert got[i].decoded == got[i].same == (t or ""), t


def toy():
    pieces = ["<unk>", "▁", "a", "b", "c", "ab", "bc", "abc", "▁a", "▁ab", "ca", "cab"]
    scores = [0.0, -3.0, -2.5, -2.6, -2.2, -3.1, -3.3, -5.6, -4.0, -4.4, -3.9, -4.5]
    return P.Model(tuple(pieces), tuple(scores), (False, *[True] * 11), -1, 0, "unigram")


def best(word, model):
    rank = {p: (s, i) for i, (p, s, ok) in enumerate(zip(model.pieces, model.scores, model.plain)) if ok}
    floor = min(s for s, _ in rank.values()) - 10
    found = []
    for cuts in itertools.product([0, 1], repeat=len(word) - 1):
        parts, start = [], 0
        for k, c in enumerate([*cuts, 1]):
            if c:
                parts.append(word[start : k + 1])
                start = k + 1
        if all(p in rank or len(p) == 1 for p in parts):
            found.append((sum(rank[p][0] if p in rank else floor for p in parts), parts))
    return max(s for s, _ in found)


def test_unigram_fold_finds_the_best_path(spark):
    model, rng = toy(), random.Random(1)
    words = sorted({"▁" + "".join(rng.choice("abcx") for _ in range(rng.randrange(1, 8))) for _ in range(40)})
    df = spark.createDataFrame([(w,) for w in words], "unit string")
    score = {i: s for i, s in enumerate(model.scores)}
    floor = min(s for s, ok in zip(model.scores, model.plain) if ok) - 10
    for r in P.encode_units(df, model).collect():
        total = lambda ids: sum(floor if i == 0 else score[i] for i in ids)
        assert total(r.ids) == pytest.approx(best(r.unit, model))


def merged(unit, rank, model):
    """The merges one by one: best score first, then leftmost."""
    parts = list(unit)
    while joins := [(-rank[a + b][0], k) for k, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in rank]:
        k = min(joins)[1]
        parts[k : k + 2] = [parts[k] + parts[k + 1]]
    return [i for p in parts for i in ([rank[p][1]] if p in rank else [model.first_byte + b for b in p.encode()])]


@pytest.mark.parametrize("longest", [20, 400])
def test_fold_is_merging_one_by_one(spark, longest):
    """Long units too: their cuts are kept in several longs."""
    model, rng = P.load(P.default_path()), random.Random(2)
    rank = {p: (s, i) for i, (p, s, ok) in enumerate(zip(model.pieces, model.scores, model.plain)) if ok}
    words = sorted({"▁" + "".join(rng.choice("eatinosr") for _ in range(rng.randrange(1, longest))) for _ in range(60)})
    words += ["▁" * n + "a" for n in (1, 2, 15, 16, 17, 59, 60, 61, 62, 63, 92, 93, 94, 200)] + ["a" * n for n in (60, 61, 62, 1000)] + ["日本語テ" * 40]
    got = {r.unit: r.ids for r in P.encode_units(spark.createDataFrame([(w,) for w in words], "unit string"), model).collect()}
    assert got == {w: merged(w, rank, model) for w in words}


def test_merges_out_of_order(spark):
    """Where a piece scores above what it arises from, one pass over the edges isn't enough."""
    pieces = ["<unk>", "a", "b", "c", "d", "bc", "abc", "cd", "da"]
    model = P.Model(tuple(pieces), (0.0, 0.0, 0.0, 0.0, 0.0, -5.0, -1.0, -2.0, -3.0), (False, *[True] * 8), -1, 0, "bpe")
    assert P.late(model) == {"abc"} and all(set(p) == {"▁"} for p in P.late(P.load(P.default_path())))
    rank = {p: (s, i) for i, (p, s, ok) in enumerate(zip(model.pieces, model.scores, model.plain)) if ok}
    rng = random.Random(3)
    words = sorted({"".join(rng.choice("abcd") for _ in range(rng.randrange(1, 100))) for _ in range(80)})
    got = {r.unit: r.ids for r in P.encode_units(spark.createDataFrame([(w,) for w in words], "unit string"), model).collect()}
    assert got == {w: merged(w, rank, model) for w in words}


def words_of(text):
    out, start = [], 0
    text = "▁" + text.replace(" ", "▁")
    for k in range(1, len(text)):
        if text[k] == "▁" and text[k - 1] != "▁":
            out.append(text[start:k])
            start = k
    return [*out, text[start:]]


def test_words_and_cuts():
    texts = [*TEXTS, "a b", None, "", "a  b ", "b", "  end  "]
    place, words, starts = P.words_in(pa.array(texts))
    own = [[words[int(i)].as_py() for i in place[x:y]] for x, y in zip(starts, starts[1:])]
    assert own == [words_of(t) if t else [] for t in texts]
    model = P.load(P.default_path())
    near = {p[k : k + 2] for p, ok in zip(model.pieces, model.plain) if ok for k in range(len(p) - 1)}
    place, units, starts = P.cut(words, P.Joints(model))
    for w, x, y in zip(words.to_pylist(), starts, starts[1:]):
        found = [units[int(i)].as_py() for i in place[x:y]]
        assert "".join(found) == w and all(a[-1] + b[0] not in near for a, b in zip(found, found[1:]))
        assert all(u[k : k + 2] in near for u in found for k in range(len(u) - 1))


def test_units_of_one_hash_go_by_text(monkeypatch):
    units = pa.array(["d", "b", "", "c", "a"], pa.large_string())
    monkeypatch.setattr(P, "unit_hash", lambda u: P.np.array([5 if x in "bc" and x else 9 for x in u.to_pylist()], P.np.uint64))
    for shuffled in (units, units.take(pa.array([4, 3, 2, 1, 0]))):
        order, part = P.dealt(shuffled, 3)
        assert [shuffled[int(k)].as_py() for k in order] == ["b", "c", "", "a", "d"] and set(part) == {0}


def test_empty_table(spark):
    assert P.encode(spark.createDataFrame([], "doc_id long, text string")).collect() == []
