"""Stems against a published vocabulary, and the inverted index against a scan."""

import random
import re

import pytest
from pyspark.sql import functions as F

from vacantry.functions.stem import CHANGED, WHOLE_WORDS, stem
from vacantry.operators import search as Q
from vacantry.schemas import RAW_POSTING, names
from vacantry.streaming.store import PostingStore
from vacantry.streaming.text_index import TextIndex

#: The sample vocabulary published with the algorithm, word and stem in turn, and words for each of its rules.
VOCABULARY = """
consign consign consigned consign consigning consign consignment consign consist consist consisted consist consistency consist consistent consist consistently consist consisting consist
consists consist consolation consol consolations consol consolatory consolatori console consol consoled consol consoles consol consolidate consolid consolidated consolid consolidating consolid
consoling consol consolingly consol consols consol consonant conson consort consort consorted consort consorting consort conspicuous conspicu conspicuously conspicu conspiracy conspiraci
conspirator conspir conspirators conspir conspire conspir conspired conspir conspiring conspir constable constabl constables constabl constance constanc constancy constanc constant constant
knack knack knackeries knackeri knacks knack knag knag knave knave knaves knave knavish knavish kneaded knead kneading knead knee knee kneel kneel kneeled kneel kneeling kneel kneels kneel
knees knee knell knell knelt knelt knew knew knick knick knif knif knife knife knight knight knightly knight knights knight knit knit knits knit knitted knit knitting knit knives knive
knob knob knobs knob knock knock knocked knock knocker knocker knockers knocker knocking knock knocks knock knopp knopp knot knot knots knot
generate generat general general generously generous dying die hopping hop hoping hope cry cri by by say say ties tie skies sky agreed agre feed feed sized size exceedingly exceed
proceeds proceed nationally nation nationalism nation organization organ electricity electr sensibility sensibl geology geolog happily happili decisiveness decis replacement replac
adoption adopt rate rate roll roll controlling control youth youth gas gas this this kiwis kiwi gaps gap possibly possibl hopefulness hope conditional condit analogously analog
formative format formality formal c++ c++ node.js node.js äußern äußern at at
"""


def test_words_begin_like_their_stems(spark):
    """What keyword search relies on when it stems only words that begin like a term."""
    draw = random.Random(7)
    suffixes = ("s", "ies", "eed", "edly", "ingly", "ed", "ing", "y", "ability", "iviti", "ization", "ational", "ousness", "fulness", "logi", "alize", "iciti", "ative", "ement", "ion", "e", "ll", "")
    words = {"".join(draw.choices("aeiouybdlrstz", k=draw.randint(0, 6))) + draw.choice(suffixes) + draw.choice(suffixes) for _ in range(6000)}
    words = sorted(w for w in words if w not in WHOLE_WORDS)
    rows = spark.createDataFrame([(w,) for w in words], "word string").select("word", stem(F.col("word")).alias("term")).collect()
    assert [r for r in rows if not r.word.startswith(r.term[: max(len(r.term) - CHANGED, 2)])] == []


def test_stems_equal_the_published_vocabulary(spark):
    words = VOCABULARY.split()
    df = spark.createDataFrame(list(zip(words[::2], words[1::2])), "word string, stem string")
    assert df.select("word", "stem", stem(F.col("word")).alias("got")).where("stem <> got").collect() == []


def make(i, title, **given):
    raw = names("seq long, " + RAW_POSTING)
    row = dict.fromkeys(raw) | {"seq": i, "title": title, "source_url": f"https://x/{i}", "source_platform": "B", "posted_date": f"2024-01-{i % 28 + 1:02}"} | given
    return tuple(row[c] for c in raw)


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    """Three batches: a merged run, and a newer one that changes a description; all indexed."""
    schema, now = "seq long, " + RAW_POSTING, F.expr("TIMESTAMP '2024-02-01 00:00:00'")
    store = PostingStore(spark, str(tmp_path_factory.mktemp("index") / "store"), parts=4)
    long = "w " * 60 + "x" * 100  # a hash takes the first 100 characters of a description
    batches = [
        [make(1, "Python developer", description="developing pythons daily", required_skills=["Python", "C++"]), make(2, "Cook", company="Developers Ltd", description=long + " soups")]
        + [make(10 + i, f"Job {i}", description="nothing") for i in range(30)],
        [make(3, "Node.js engineer", description="node.js and C++ development")] + [make(60 + i, f"Post {i}", description="nothing") for i in range(30)],
        [make(4, "Cook", company="Developers Ltd", description=long + " soups and pythons")],
    ]
    for k, rows in enumerate(batches):
        store.ingest(spark.createDataFrame(rows, schema), k, now)
        if k == 1:
            assert store.compact()
    assert [r.merged for r in store.runs()] == [True, False]
    assert TextIndex(store, 8).refresh() == 2 and TextIndex(store, 8).refresh() == 0
    return store, now


@pytest.mark.parametrize("q", ["python", "Developed", "c++ soup", "jobs", "node.js the", "nothing job", "the", "absent", "engineering cooks"])
def test_index_equals_scan(store, q):
    store, now = store
    spec = Q.plan_search({"q": q, "limit": "100"})
    index, scan = TextIndex(store, 8).search(spec, now), Q.search(store.postings(), spec, now)
    columns = ["dedupe_hash", "title", "score"]
    got = [tuple(r) for r in index.select(columns).collect()]
    assert got == [tuple(r) for r in scan.select(columns).collect()]
    assert bool(got) == (q not in ("the", "absent"))


def test_filters_and_pages_hold_with_the_index(store):
    store, now = store
    spec = Q.plan_search({"q": "nothing", "limit": "7", "page": "3", "sort": "oldest", "source": "b"})
    index, scan = TextIndex(store, 8).search(spec, now), Q.search(store.postings(), spec, now)
    assert [r.dedupe_hash for r in index.collect()] == [r.dedupe_hash for r in scan.collect()] and index.count() == 7


def test_newer_states_hide_older_entries(store):
    store, _ = store
    rows = {r.term: r for r in TextIndex(store, 8).found(["soup"]).collect()}
    assert len(rows) == 1 and TextIndex(store, 8).found(["soup"]).count() == 1


def test_a_search_reads_only_its_terms_buckets(store):
    """The plan filters partitions of the merged run and pushes the terms to the scan."""
    store, _ = store
    index = TextIndex(store, 8)
    found = index.found(["python"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket#\d+ = \d", plan) and re.search(r"PushedFilters: \[[^\n]*EqualTo\(term,python\)|PushedFilters: \[[^\n]*In\(term", plan)


def test_entries_are_shuffled_once(spark, store):
    """Hashes stay behind, words are counted in their row; two postings with one number are numbered anew."""
    from vacantry.streaming import text_index

    store, _ = store
    run = store.runs()[0]
    index = TextIndex(store, 8)
    made = text_index.entries(store._read(run, None), index.bucket)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange hashpartitioning", plan)) == 1 and "doc" in made.columns and "dedupe_hash" not in made.columns
    again = index.numbered(run)
    assert again == 0
    real = text_index.number
    text_index.number = lambda seed: F.lit(7).cast("long") if seed == 0 else real(seed)
    try:
        assert index.numbered(run) == 1 and index.numbers(run).select("doc").distinct().count() == run.rows
    finally:
        text_index.number = real
        index.numbered(run)
