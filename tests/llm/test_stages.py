"""Pipeline stages on rows with clashing column names, repeated ids and repeated rows."""

import pytest

from vacantry.llm import exact_dedup, language_id, mixing, pieces, simhash

#: Names that the work uses itself, or used once.
CLASHES = ["key", "row", "kept", "count", "id", "fp", "n", "copies", "mix_id", "mix_copy", "mix_copies", "dropped_id", "rejected_id", "text_sha256", "group", "slot", "blob", "bucket", "unit"]


def table(spark, rows):
    names = ", ".join(f"`{c}` string" for c in CLASHES)
    schema = f"doc_id long, text string, lang string, source string, n_chars long, {names}"
    return spark.createDataFrame([(i, t, "xx", s, 1, *(f"{c} of {k}" for c in CLASHES)) for k, (i, t, s) in enumerate(rows)], schema)


def kept(df, out):
    assert out.columns == df.columns
    return sorted(((r.doc_id, r.text) for r in out.collect()), key=repr)


ROWS = [(5, "same", "a"), (9, "same", "a"), (5, "unique text", "a"), (9, "same", "a"), (None, "kolo", "b"), (None, "kolo", "b"), (7, None, "a"), (8, "", None)]


def test_exact_dedup_loses_no_text(spark):
    df = table(spark, ROWS)
    assert kept(df, exact_dedup.stage(spark, df, "")) == [(5, "unique text"), (8, ""), (9, "same"), (None, "kolo")]


def test_simhash_loses_no_class(spark):
    df = table(spark, ROWS)
    assert kept(df, simhash.stage(spark, df, "")) == [(5, "same"), (5, "unique text"), (7, None), (None, "kolo")]


def test_simhash_drops_near_copies_only(spark, monkeypatch):
    """Copies with few edits go; what links by its fingerprint but shares less than 0.8 of its shingles stays."""
    monkeypatch.setattr(simhash, "SALT_ROWS", 4)  # several salts
    words = [f"w{i * 7919 % 10007}" for i in range(900)]
    rows = [(1, " ".join(words), "a"), (50, " ".join(f"z{i}" for i in range(900)), "a")]
    for k in range(20):  # one word changed, or one added
        edited = words[: 40 * k] + [f"new{k}"] + words[40 * k + k % 2 :]
        rows.append((100 + k, " ".join(edited), "b"))
    df = table(spark, rows)
    keys = simhash.simhash_dedup(df, distance=6, shingle=5)
    linked = {r.doc_id for r in keys.where("component_id = 1").collect()} - {1}
    assert len(linked) > 10
    assert {i for i, _ in kept(df, simhash.stage(spark, df, ""))} == {i for i, _, _ in rows} - linked
    monkeypatch.setattr(simhash, "SIMILAR", 1.01)
    assert len(kept(df, simhash.stage(spark, df, ""))) == len(rows)


def test_language_id_judges_each_row(spark, monkeypatch):
    monkeypatch.setattr(language_id, "STEPS", 20)
    df = table(spark, [*ROWS, (5, "12 34", "a")])
    assert kept(df, language_id.stage(spark, df, "")) == sorted(((i, t) for i, t, _ in ROWS if t), key=repr)


def test_mixing_takes_each_row(spark):
    df = table(spark, [(i // 2, f"w{i} " * 5, "a" if i % 4 else "b") for i in range(40)])
    out = mixing.stage(spark, df, "")
    assert out.columns == df.columns
    taken = {(r.doc_id, r.text): 0 for r in df.collect()}
    for r in out.collect():
        taken[r.doc_id, r.text] += 1
    a = [n for (i, t), n in taken.items() if int(t[1:].split()[0]) % 4]
    assert max(taken.values()) <= 3 and sum(a) > 0


def test_pieces_of_each_row(spark):
    df = table(spark, ROWS)
    assert pieces.stage(spark, df, "").count() == len(ROWS)


@pytest.mark.parametrize("stage", [exact_dedup.stage, simhash.stage, language_id.stage, mixing.stage, pieces.stage])
def test_empty_table(spark, stage):
    assert stage(spark, table(spark, []), "").collect() == []
