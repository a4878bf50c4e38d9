"""The pipeline against a plain version of its decisions."""

import hashlib

import pyarrow.parquet as pq

import corpus_pipeline
from tests.llm.test_simhash import brute_fp, classes
from vacantry.llm import mixing, pieces


def similarity(a, b):
    """Common five-word shingles over all of both."""
    x, y = ({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for w in (a.encode().lower().split(), b.encode().lower().split()))
    return len(x & y) / len(x | y)


def test_every_stage(spark, sf):
    import sentencepiece

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    rows = {r["doc_id"]: r for r in pq.read_table(f"{sf}/documents.parquet").to_pylist()}
    (_, language), (_, exact), (_, near), (_, mix), (_, encode) = corpus_pipeline.STAGES
    one = language(spark, docs, sf).cache()
    assert one.columns == columns
    kept = {r.doc_id: r.text for r in one.collect()}
    assert all(any(ch.isalpha() for ch in t) for t in kept.values()) and len(kept) > 0.95 * len(rows)
    two = exact(spark, one, sf).cache()
    last = {}
    for i in sorted(kept):
        last[kept[i]] = i
    assert two.columns == columns and {r.doc_id for r in two.collect()} == set(last.values())
    three = near(spark, two, sf).cache()
    ids = sorted(last.values())
    comp = classes(ids, [brute_fp(kept[i], 5) for i in ids], 6)
    alike = {i for i in ids if comp[i] != i and similarity(kept[i], kept[comp[i]]) >= 0.8}
    assert three.columns == columns and {r.doc_id for r in three.collect()} == set(ids) - alike
    four = mix(spark, three, sf).cache()
    copies = {r.doc_id: r.copies for r in mixing.mix(mixing.sized(three)).collect()}
    assert four.columns == columns and sorted(r.doc_id for r in four.collect()) == sorted(i for i, n in copies.items() for _ in range(n))
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.default_path())
    out = encode(spark, four, sf).collect()
    assert sorted(r.doc_id for r in out) == sorted(r.doc_id for r in four.collect())
    assert all(r.n_pieces == len(sp.encode(kept[r.doc_id])) for r in out)


def test_run_returns_the_last_stage(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert out.columns == ["doc_id", "n_pieces", "ids", "ids_sha256", "decoded_sha256"]
    texts = {r["doc_id"]: r["text"] for r in pq.read_table(f"{sf}/documents.parquet").to_pylist()}
    for r in out.collect():
        assert len(r.ids) == r.n_pieces and r.ids_sha256 == hashlib.sha256(",".join(map(str, r.ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest() or "▁" in texts[r.doc_id]
