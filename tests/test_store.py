"""The store: runs, compaction, crashes, rows set aside, and the feed of changes."""

import os
import random

import pytest
from pyspark.sql import functions as F

from vacantry.operators import merge as U
from vacantry.schemas import RAW_POSTING, STORED, names
from vacantry.streaming import store as T

NOW = None  # a column, which needs a session
RAW = "seq long, " + RAW_POSTING


@pytest.fixture(autouse=True, scope="module")
def now(spark):
    globals()["NOW"] = F.expr("TIMESTAMP '2024-01-01 00:00:00'")


def make(i, **given):
    row = dict.fromkeys(names(RAW)) | {"seq": i, "title": f"t{i}", "source_url": f"https://x/{i}", "source_platform": "B"} | given
    return tuple(row[c] for c in names(RAW))


def frame(spark, rows):
    return spark.createDataFrame(rows, RAW).coalesce(1)


def batches(n, size, seed=0):
    """Batches that meet each other's postings, with skills beyond the limits' order."""
    rng = random.Random(seed)
    skill = lambda: [f"s{rng.randrange(60)}" for _ in range(rng.randrange(40))]
    out = []
    for b in range(n):
        rows = []
        for k in range(size):
            i = rng.randrange(size * 2)
            rows.append(make(b * size + k, title=f"t{i}", description=f"d{i} " + "w" * rng.randrange(4), source_url=f"https://x/{rng.randrange(9)}/{i}", required_skills=skill(), preferred_skills=skill(), salary=rng.choice([None, "5"])))
        out.append(rows)
    return out


def state(df):
    return sorted((tuple(r) for r in df.select(*names(STORED)).collect()), key=repr)


def size_of(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(path) for f in fs)


@pytest.fixture(scope="module")
def fed(spark, tmp_path_factory):
    """Seven batches taken with compaction after each second, and what a plain upsert makes of them."""
    store = T.PostingStore(spark, str(tmp_path_factory.mktemp("fed") / "store"), parts=4)
    plain, states, runs = spark.createDataFrame([], STORED), [], []
    for k, rows in enumerate(batches(7, 12)):
        store.ingest(frame(spark, rows), k, NOW)
        if k % 2:
            store.compact()
        runs.append(store.runs())
        folded = U.fold_batch(U.validate(frame(spark, rows), NOW).where("reason IS NULL"))
        plain = spark.createDataFrame(U.upsert(plain, folded, NOW).select(*names(STORED)).collect(), STORED)
        states.append((state(plain), state(store.postings())))
    return store, states, runs


def test_reader_equals_upserts_of_all_batches(fed):
    for want, got in fed[1]:
        assert got == want
    assert len(fed[1][-1][0]) > 15


def test_runs_stay_few_and_cover_all_batches(fed):
    store, _, runs = fed
    assert [[(r.first, r.last) for r in x] for x in runs[:2]] == [[(0, 0)], [(0, 1)]]
    assert max(map(len, runs)) <= 4
    for k, x in enumerate(runs):
        assert [b for r in x for b in range(r.first, r.last + 1)] == list(range(k + 1))


def test_vacuum_keeps_what_readers_need(fed):
    store, states, _ = fed
    while store.compact():
        pass
    store.ingest(frame(store.spark, batches(1, 3, 5)[0]), 7, NOW)
    want, before = state(store.postings()), store.postings()
    store.compact()
    assert store.vacuum() and state(store.postings()) == want == state(before)
    live = {r.path for r in store.runs()}
    store.vacuum(keep=0)
    left = {f"{store.path}/{kind}/{d}" for kind in ("batches", "merged") if os.path.isdir(f"{store.path}/{kind}") for d in os.listdir(f"{store.path}/{kind}")}
    assert left == live and state(store.postings()) == want


def test_a_batch_writes_in_proportion_to_itself(spark, tmp_path):
    store = T.PostingStore(spark, str(tmp_path / "store"))
    words = random.Random(1)
    text = lambda: "".join(words.choices("abcdefghij", k=400))
    store.ingest(frame(spark, [make(i, description=text()) for i in range(6000)]), 0, NOW)
    store.compact()
    whole = size_of(tmp_path / "store" / "batches")
    store.ingest(frame(spark, [make(7000 + i, title=f"t{i * 7}", description=text()) for i in range(60)]), 1, NOW)
    assert store.runs()[-1].rows == 60 and size_of(tmp_path / "store" / "batches" / "batch=1") < whole / 20
    assert not store.compact()  # too small to rewrite the rest for it


def test_crash_between_write_and_log(spark, tmp_path, monkeypatch):
    store = T.PostingStore(spark, str(tmp_path / "store"), parts=4)
    store.ingest(frame(spark, [make(1), make(2)]), 0, NOW)
    want = state(store.postings())
    with monkeypatch.context() as m:
        m.setattr(T, "counters", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            store.ingest(frame(spark, [make(3), make(4, title="t1", source_url="https://y")]), 1, NOW)
    assert os.path.isdir(store.path + "/batches/batch=1") and state(store.postings()) == want
    assert store.vacuum(0) == []  # what isn't logged yet may be on its way
    store.ingest(frame(spark, [make(5)]), 1, NOW)  # the batch comes again, with other rows
    assert sorted(r.title for r in store.postings().collect()) == ["t1", "t2", "t5"]
    # a merge that died before its log row is not read, and the next one writes it anew
    store._read(store.runs()[0], None).limit(1).withColumn("part", F.lit(0)).write.partitionBy("part").parquet(store.path + "/merged/first=0-last=1")
    assert store.postings().count() == 3 and store.compact() and store.postings().count() == 3
    assert [(r.first, r.last, r.rows) for r in store.runs()] == [(0, 1, 3)]


def test_rows_of_a_failed_batch_are_set_aside(spark, tmp_path):
    store = T.PostingStore(spark, str(tmp_path / "store"), pause=0)
    plain = store.ingest
    store.ingest = lambda df, batch, now: plain(df, batch, now) if batch != 1 else 1 / 0
    for k in range(3):
        store.ingest_or_skip(frame(spark, [make(2 * k), make(2 * k + 1)]), k, NOW)
    assert store.postings().count() == 4 and sorted(r.seq for r in store.aside().collect()) == [2, 3]
    store.ingest = plain
    store.ingest_or_skip(store.aside(), 3, NOW)
    assert store.postings().count() == 6


def test_a_fault_of_the_disk_skips_nothing(spark, tmp_path):
    store = T.PostingStore(spark, str(tmp_path / "store"), pause=0)
    store.ingest(frame(spark, [make(1)]), 0, NOW)
    (tmp_path / "store" / "aside").write_text("in the way")
    store.ingest = lambda *_: 1 / 0
    with pytest.raises(Exception, match="(?i)aside|parent|directory"):
        store.ingest_or_skip(frame(spark, [make(2)]), 1, NOW)
    assert store.changes().count() == 1 and store.last_batch() == 0


def test_subscribers_are_told_each_batch_once(spark, tmp_path):
    store = T.PostingStore(spark, str(tmp_path / "store"), parts=2)
    told = lambda who: [(r.batch_id, r.inserted, r.all_inserted, r.all_updated) for r in spark.read.schema(T.TOLD).parquet(str(tmp_path / who)).orderBy("batch_id").collect()]
    follow = lambda who: T.follow(spark, store.path, who, str(tmp_path / who), str(tmp_path / f"{who}-position"))
    store.ingest(frame(spark, [make(1), make(2)]), 0, NOW)
    store.ingest(frame(spark, [make(3, title=None)]), 1, NOW)  # changes nothing
    follow("a")
    assert told("a") == [(0, 2, 2, 0)]
    follow("a")  # nothing new
    store.ingest(frame(spark, [make(4), make(5, title="t1")]), 2, NOW)
    store.ingest(frame(spark, [make(6)]), 3, NOW)
    follow("a")
    follow("b")
    assert told("a") == told("b") == [(0, 2, 2, 0), (2, 1, 3, 1), (3, 1, 4, 1)]


def test_landed_files_follow_the_input(spark, tmp_path, monkeypatch):
    """As many landed files as the input has partitions, in two batches all the same."""
    from vacantry.plans import queries as P

    rows = spark.range(60).selectExpr("id AS doc_id", "concat('Title ', id, '\nbody') AS text", "'en' AS lang", "'web' AS source", "12L AS n_chars")
    rows.repartition(9).write.parquet(str(tmp_path / "documents.parquet"))
    seen = []
    from vacantry.streaming import store as T

    real = T.read_batches
    monkeypatch.setattr(T, "read_batches", lambda spark, path, schema, n: (seen.append((len(spark.read.text(path).inputFiles()), n)), real(spark, path, schema, n))[1])
    spark.conf.set("spark.sql.files.openCostInBytes", str(1 << 27))
    try:
        got = P.stream_ingest(spark, str(tmp_path)).first()
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert (got.received, got.stored, got.sources) == (60, 60, 60) and seen == [(9, 5)]
