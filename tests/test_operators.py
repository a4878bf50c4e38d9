"""Operators against small truth tables and plain versions."""

import random
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from vacantry.operators import cv as V
from vacantry.operators import match as M
from vacantry.operators import merge as U
from vacantry.operators import normalize as N
from vacantry.operators import search as Q
from vacantry.operators import skills as K
from vacantry.schemas import POSTING, RAW_POSTING
from vacantry.sources import jsonld as J
from vacantry.streaming import store as T

NOW = None


@pytest.fixture(scope="module", autouse=True)
def clock(spark):
    """Columns need a session, so the moment is made here."""
    global NOW
    NOW = F.expr("TIMESTAMP '2026-07-15 00:00:00'")


@pytest.fixture(scope="module")
def aliases(spark):
    return K.alias_table(spark, K.POSTING_SKILLS)


@pytest.fixture(scope="module")
def cv_aliases(spark):
    return K.alias_table(spark, K.POSTING_SKILLS | {"R": ("r programming",), "Human Resources": ("hr", "human resource")}, "cv")


def columns(schema):
    """Column names of a schema whose types hold no commas outside brackets."""
    depth, out, start = 0, [], 0
    for i, ch in enumerate(schema + ","):
        depth += (ch == "<") - (ch == ">")
        if ch == "," and depth == 0:
            out.append(schema[start:i].split()[0])
            start = i + 1
    return out


def skills_of(spark, aliases, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [r.skills for r in K.extract_skills(df, aliases, "i", "t").orderBy("i").collect()]


def test_extraction_boundaries(spark, aliases):
    got = skills_of(spark, aliases, ["We use node.js and React Native, not javascripty", "C++/C# and .NET; ci/cd", "asp.net", "", None, "MS Excel, excellent"])
    assert got[0] == ["React", "Node.js", "React Native"]
    assert got[1] == ["C#", ".NET", "C++", "CI/CD"]
    assert got[2] == [".NET"] and got[3] == got[4] == [] and got[5] == ["Excel"]


def test_scanning_in_cvs(spark, cv_aliases):
    assert skills_of(spark, cv_aliases, ["R&D, 8 hr shifts, spring 2023, SEO Python"]) == [["Python", "Digital Marketing"]]


def test_required_and_preferred(spark, aliases):
    df = spark.createDataFrame([(1, "Need Python and SQL. Nice to have: Docker, python; bonus react"), (2, "Java only"), (3, None)], "i int, t string")
    got = {r.i: (r.required, r.preferred) for r in K.required_and_preferred(df, aliases, "i", "t").collect()}
    assert got == {1: (["Python", "SQL"], ["React", "Docker"]), 2: (["Java"], []), 3: ([], [])}


def test_canonical_lists(spark, aliases):
    df = spark.createDataFrame([(1, ["reactjs", "React (advanced)", "Knitting", " knitting ", "Python - 3 years", ""]), (2, []), (3, None)], "i int, xs array<string>")
    got = {r.i: r.skills for r in K.canonicalise_lists(df, aliases, "i", "xs").collect()}
    assert got == {1: ["React", "Knitting", "Python"], 2: [], 3: []}
    more = {r.i: r.skills for r in K.canonicalise_by_extraction(df, aliases, "i", "xs").collect()}
    assert more[1][:2] == ["React", "Knitting"] and more[2] == more[3] == []


def posting(**given):
    row = dict.fromkeys(columns(POSTING)) | {"description": "", "required_skills": [], "preferred_skills": [], "experience_level": "unspecified", "education_requirement": "unspecified", "location": "Nepal", "sources": []} | given
    row["sources"] = row["sources"] or [(row["source_platform"], row["source_url"])]
    return tuple(row[k] for k in columns(POSTING))


def fold_one(rows):
    """The rows of a group merged two by two in order."""
    out = dict(zip(columns(POSTING), rows[0]))
    for row in rows[1:]:
        b = dict(zip(columns(POSTING), row))
        if len(b["description"]) > len(out["description"]):
            out["title"], out["description"] = b["title"], b["description"]
        first = lambda xs: [v for i, v in enumerate(xs) if v.lower() not in [w.lower() for w in xs[:i]]]
        out["required_skills"] = first(out["required_skills"] + b["required_skills"])
        out["preferred_skills"] = [v for v in first(out["preferred_skills"] + b["preferred_skills"]) if v.lower() not in [w.lower() for w in out["required_skills"]]]
        for k, blank in (("experience_level", "unspecified"), ("education_requirement", "unspecified"), ("location", "Nepal")):
            out[k] = out[k] if out[k] != blank else b[k]
        for k in ("salary", "deadline", "apply_url"):
            out[k] = out[k] if out[k] is not None else b[k]
        out["sources"] = out["sources"] + [s for s in b["sources"] if s[1] not in [t[1] for t in out["sources"]]]
    return out


def random_postings(seed, n, hashes):
    rng = random.Random(seed)
    return [
        posting(
            seq=i, title=f"t{i}", company=f"c{i}", description="d" * rng.randrange(6), required_skills=rng.sample(["A", "a", "B", "C"], rng.randrange(3)), preferred_skills=rng.sample(["c", "D", "E"], rng.randrange(3)),
            experience_level=rng.choice(["unspecified", "mid"]), location=rng.choice(["Nepal", "X", "Y"]), salary=rng.choice([None, f"s{i}"]), source_platform="p", source_url=f"u{rng.randrange(n)}", dedupe_hash=f"h{rng.randrange(hashes)}",
        )
        for i in range(n)
    ]


CHECKED = ("seq", "title", "company", "description", "required_skills", "preferred_skills", "experience_level", "location", "salary")


def test_fold_equals_pairwise_merging(spark):
    rows = random_postings(1, 120, 25)
    groups = {}
    for r in rows:
        groups.setdefault(r[columns(POSTING).index("dedupe_hash")], []).append(r)
    got = {r.dedupe_hash: r for r in U.fold_batch(spark.createDataFrame(rows, POSTING)).collect()}
    assert set(got) == set(groups)
    for h, own in groups.items():
        want = fold_one(own)
        assert {k: got[h][k] for k in CHECKED} == {k: want[k] for k in CHECKED}
        assert [tuple(s) for s in got[h].sources] == want["sources"] and got[h].copies == len(own)


def test_upsert_equals_folding_everything(spark):
    rows = random_postings(2, 90, 30)
    df = spark.createDataFrame(rows, POSTING)
    stored = U.fold_batch(df.where("seq < 50")).drop("copies").withColumn("last_seen_at", F.lit(None).cast("timestamp"))
    got = {r.dedupe_hash: r for r in U.upsert(stored, U.fold_batch(df.where("seq >= 50")), NOW).collect()}
    whole = {r.dedupe_hash: r for r in U.fold_batch(df).collect()}
    assert set(got) == set(whole)
    for h, r in whole.items():
        assert {k: got[h][k] for k in CHECKED} == {k: r[k] for k in CHECKED}
        assert (got[h].last_seen_at is not None) == (got[h].op != "keep")


def test_merge_duplicates_order_of_richness(spark):
    a = posting(seq=1, title="first", description="same", salary=None, required_skills=["A"], source_platform="x", source_url="u1", dedupe_hash="h")
    b = posting(seq=2, title="second", description="same", salary="9", required_skills=["B"], source_platform="y", source_url="u2", dedupe_hash="h")
    c = posting(seq=3, title="third", description="same longer", required_skills=[], source_platform="z", source_url="u1", dedupe_hash="h")
    d = posting(seq=4, title="lost", dedupe_hash=None)
    out = U.merge_duplicates(spark.createDataFrame([c, a, d, b], POSTING)).collect()
    assert len(out) == 1 and out[0].title == "third" and out[0].required_skills == ["A", "B"] and out[0].salary == "9"
    assert [s.url for s in out[0].sources] == ["u1", "u2"]


def test_merge_duplicates_gathers_no_copies(spark):
    """A group's copies never meet in one row, and only distinct addresses are counted."""
    lines = lambda df: df._jdf.queryExecution().optimizedPlan().toString().splitlines()
    df = spark.createDataFrame(random_postings(4, 40, 3), POSTING)
    for line in lines(U.merge_duplicates(df)):
        assert "collect_list" not in line or "description" not in line.split("collect_list", 1)[1]
    count = U.duplicate_count(df)
    assert not any("collect_list" in line for line in lines(count))
    assert count.first()[0] == sum(len(r.sources) - 1 for r in U.merge_duplicates(df).collect())


def test_merge_duplicates_ties_follow_the_order(spark):
    """Of equally long texts, more skills than were united, a salary or a deadline makes a later copy show."""
    rows = [
        posting(seq=1, title="a", description="12", salary=None, required_skills=["A", "A"], source_url="u1", dedupe_hash="h"),
        posting(seq=2, title="b", description="1", salary="", required_skills=["B"], source_url="u2", dedupe_hash="h"),
        posting(seq=3, title="c", description="12", salary="9", required_skills=["b", "a"], source_url="u1", dedupe_hash="h"),
        posting(seq=4, title="d", description="21", salary="8", required_skills=["C", "D"], source_url="u3", dedupe_hash="h"),
        posting(seq=5, title="e", description="21", salary=None, required_skills=["A", "B", "C", "D", "E"], preferred_skills=["F", "e"], source_url="u3", dedupe_hash="h"),
        posting(seq=6, title="one", required_skills=["A", "A"], source_url="u1", dedupe_hash="g"),
    ]
    got = {r.dedupe_hash: r for r in U.merge_duplicates(spark.createDataFrame(rows[::-1], POSTING)).collect()}
    h = got["h"]
    assert (h.seq, h.title, h.salary, h.required_skills, h.preferred_skills) == (5, "e", "9", ["A", "B", "C", "D", "E"], ["F"])
    assert [s.url for s in h.sources] == ["u1", "u2", "u3"] and got["g"].required_skills == ["A", "A"]


def test_store_is_idempotent(spark, tmp_path):
    raw = "seq long, " + RAW_POSTING
    cols = ["seq", *columns(RAW_POSTING)]
    make = lambda i, **g: tuple((dict.fromkeys(cols) | {"seq": i, "title": f"t{i}", "source_url": f"https://x/{i}", "source_platform": "B"} | g)[c] for c in cols)
    landed = tmp_path / "landed"
    first = [make(1), make(2), make(3, title="t2", source_url="https://y/3"), make(4, title=None), make(5, source_url="ftp://x")]
    spark.createDataFrame(first, raw).coalesce(1).write.json(str(landed / "a"))
    store = T.PostingStore(spark, str(tmp_path / "store"))
    read = lambda: T.read_batches(spark, str(landed / "*"), raw)
    store.stream(read(), str(tmp_path / "checkpoint"), NOW)
    row = store.changes().first()
    assert (row.received, row.inserted, row.updated, row.merged, row.skipped, row.errors) == (5, 2, 0, 1, 2, ["missing title", "sourceUrl must be http(s)"])
    assert store.postings().count() == 2
    spark.createDataFrame([make(6, title="t1"), make(7)], raw).coalesce(1).write.json(str(landed / "b"))
    store.stream(read(), str(tmp_path / "checkpoint"), NOW)
    assert store.postings().count() == 3 and store.changes().count() == 2
    again = store.last_batch()
    store.ingest(spark.createDataFrame([make(8)], raw), again, NOW)  # a replayed batch
    assert store.postings().count() == 3
    assert T.pending_new(store.changes(), F.expr("TIMESTAMP '2020-01-01'")).first()[0] == 3
    assert T.totals(store.changes()).first().inserted == 3


def test_failing_batches_are_skipped_and_counted(spark, tmp_path):
    raw = "seq long, " + RAW_POSTING
    cols = ["seq", *columns(RAW_POSTING)]
    make = lambda i, **g: tuple((dict.fromkeys(cols) | {"seq": i, "title": f"t{i}", "source_url": f"https://x/{i}", "source_platform": "B"} | g)[c] for c in cols)
    store = T.PostingStore(spark, str(tmp_path / "store"))
    tried = []
    plain, bad = store.ingest, spark.createDataFrame([make(9), make(10)], raw).withColumn("title", F.expr("raise_error('no')").cast("string"))
    store.ingest = lambda df, batch, now: (tried.append(batch), plain(df, batch, now))
    store.ingest_or_skip(spark.createDataFrame([make(1)], raw), 0, NOW)
    store.ingest_or_skip(bad, 1, NOW)
    store.ingest_or_skip(spark.createDataFrame([make(2)], raw), 2, NOW)
    assert tried == [0, 1, 1, 1, 2] and store.postings().count() == 2
    rows = {r.batch_id: r for r in store.changes().collect()}
    assert (rows[1].received, rows[1].skipped, rows[1].changed, rows[1].inserted) == (2, 2, None, 0) and rows[1].errors[0].startswith("batch failed")
    assert rows[2].inserted == 1 and T.totals(store.changes()).first().skipped == 2


def test_batches_write_only_their_parts(spark, tmp_path):
    raw = "seq long, " + RAW_POSTING
    cols = ["seq", *columns(RAW_POSTING)]
    make = lambda i, **g: tuple((dict.fromkeys(cols) | {"seq": i, "title": f"t{i}", "source_url": f"https://x/{i}", "source_platform": "B"} | g)[c] for c in cols)
    store = T.PostingStore(spark, str(tmp_path / "store"), parts=8)
    store.ingest(spark.createDataFrame([make(i) for i in range(40)], raw), 0, NOW)
    store.ingest(spark.createDataFrame([make(50, title="t7", source_url="https://y/7")], raw), 1, NOW)
    assert len(store.versions()) == 8 and sorted(store.versions().values()) == [0] * 7 + [1]
    store.ingest(spark.createDataFrame([make(60, title=None)], raw), 2, NOW)  # nothing usable
    rows = {r.title: [s.url for s in r.sources] for r in store.postings().collect()}
    assert len(rows) == 40 and rows["t7"] == ["https://x/7", "https://y/7"] and sorted(store.versions().values()) == [0] * 7 + [1]


@pytest.mark.parametrize("threshold", [0.8, 0.3, -0.2])
def test_semantic_pairs_equal_all_pairs(spark, monkeypatch, threshold):
    """Vectors in clusters, of any length and none; small blocks, so that layers have parts."""
    monkeypatch.setattr(M, "CANDIDATE_BLOCK", 40)
    monkeypatch.setattr(M, "REQUIREMENT_BLOCK", 16)
    draw = np.random.default_rng(5)
    centres = draw.normal(size=(12, 16))
    x = centres[draw.integers(0, 12, 900)] + draw.normal(scale=0.25, size=(900, 16))
    x[:800] /= np.linalg.norm(x[:800], axis=1, keepdims=True)
    x[100:300] = x[100]  # one vector many times
    x[850] = 0
    x = x.astype(np.float32)
    vectors = spark.createDataFrame([(f"k{i}", v.tolist()) for i, v in enumerate(x)] + [("none", None)], "key string, vector array<float>")
    asked = [f"k{i}" for i in range(0, 900, 7)] + ["none", "unknown", "k0"]
    reqs = spark.createDataFrame([(k,) for k in asked], "key string")
    config = M.ScoreConfig(threshold=threshold, engine="semantic")
    got = {(r.req_key, r.cand_key): r.sim for r in M.semantic(reqs, vectors.select("key"), config, vectors).collect()}
    sims = np.round(x.astype(float) @ x.astype(float).T, 4)
    want = {(f"k{i}", f"k{j}"): sims[i, j] for i in range(0, 900, 7) for j in np.flatnonzero(sims[i] >= threshold)}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1.1e-4 for k in want)
    work = M.semantic_plan(reqs, vectors.select("key"), threshold, vectors).work().first()
    assert work.pairs == 129 * 900 and len(want) <= work.compared and (threshold < 0.8 or work.compared < 0.4 * work.pairs)


def test_semantic_pairs_of_nothing(spark):
    vectors = spark.createDataFrame([], "key string, vector array<float>")
    some = spark.createDataFrame([("a", [1.0, 0.0])], "key string, vector array<float>")
    config = M.ScoreConfig(engine="semantic")
    assert M.semantic(some.select("key"), vectors.select("key"), config, vectors).collect() == []
    assert M.semantic(some.select("key"), vectors.select("key"), config, some).collect() == []
    assert M.semantic(vectors.select("key"), some.select("key"), config, some).collect() == []


def test_graphs_at_any_depth(spark):
    deep = '{"@type": "JobPosting", "title": "deep"}'
    for _ in range(7):
        deep = '{"@graph": [' + deep + "]}"
    html = f'<script type="application/ld+json">{deep}</script>'
    df = spark.createDataFrame([(1, html), (2, None)], "page_id int, html string")
    assert J.job_postings(df, "page_id", "html").selectExpr("page_id", "try_variant_get(node, '$.title', 'string') t").collect() == [(1, "deep")]


def test_graphs_keep_their_order_and_pages_are_read_once(spark, tmp_path):
    block = lambda j: f'<script type="application/ld+json">{j}</script>'
    many = block('[{"n": 0, "\\u0040graph": [{"n": 1, "@graph": [{"n": 2}, 7, [{"n": 9}]]}, {"n": 3, "@graph": {"n": 9}}]}, {"n": 4, "@graph": []}]') + block('{"n": 5}') + block("[") + block("[]")
    spark.createDataFrame([(1, many), (2, ""), (3, None), (4, block('"text"') + block("null"))], "page_id int, html string").write.parquet(str(tmp_path / "pages"))
    nodes = J.json_nodes(spark.read.parquet(str(tmp_path / "pages")), "page_id", "html")
    got = nodes.selectExpr("page_id", "block", "path", "try_variant_get(node, '$.n', 'int') n").collect()
    want = [(1, 0, [0], 0), (1, 0, [0, 0], 1), (1, 0, [0, 0, 0], 2), (1, 0, [0, 1], 3), (1, 0, [1], 4), (1, 1, [0], 5)]
    assert sorted(tuple(r) for r in got) == want
    assert nodes._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1


def test_search_plan():
    spec = Q.plan_search({"limit": "0", "page": "x", "job_type": "Remote,boss", "sort": "relevance"})
    assert (spec.limit, spec.page, spec.job_types, spec.warnings, spec.sort) == (20, 1, ("remote",), ("ignored unknown jobType: boss",), "relevance")
    assert [Q.plan_search({"limit": v}).limit for v in ("-5", "500", "junk", None, 7)] == [1, 100, 20, 20, 7]
    assert Q.plan_search({"q": "a b"}).sort == "relevance" and Q.plan_search({"sort": "odd"}).sort == "newest"


def test_keyword_relevance(spark):
    rows = [posting(seq=1, title="Python dev", company="c", description="python python", required_skills=["Python"], dedupe_hash="1"), posting(seq=2, title="Cook", company="Python Ltd", description="", dedupe_hash="2"), posting(seq=3, title="the", company="", dedupe_hash="3")]
    got = Q.search(spark.createDataFrame(rows, POSTING), Q.plan_search({"q": "the PYTHON"}), NOW).collect()
    assert [(r.seq, r.score) for r in got] == [(1, 16), (2, 5)]  # title 10, company 5, required skills 4, description 1


def cvs_and_jobs(spark):
    cvs = spark.createDataFrame([(1, ["ReactJS", "Node.js", "MongoDB", "Tailwind CSS", "Git"], 36, "bachelor"), (2, [], 0, "diploma")], "cv_id int, skills array<string>, total_experience_months int, highest_education string")
    jobs = spark.createDataFrame(
        [(10, ["React", "Node.js"], ["Docker"], "mid", "bachelor"), (11, ["React", "Node.js"], [], "mid", "bachelor"), (12, [], [], "unspecified", "unspecified"), (13, ["Mongo database"], ["Postgress"], "senior", "master")],
        "job_id int, required_skills array<string>, preferred_skills array<string>, experience_level string, education_requirement string",
    )
    return cvs, jobs


def test_scores(spark, aliases):
    cvs, jobs = cvs_and_jobs(spark)
    got = {(r.cv_id, r.job_id): r for r in M.score_matches(cvs, jobs, aliases).collect()}
    assert len(got) == 8
    r = got[1, 10]
    assert (r.required_percent, r.preferred_percent, r.experience_percent, r.education_percent, r.overall_score) == (100, 0, 100, 100, 80.0)
    assert [(m.required, m.matched_with, m.via) for m in r.matched_skills] == [("React", "ReactJS", "alias"), ("Node.js", "Node.js", "exact")] and r.missing_preferred_skills == ["Docker"]
    assert got[1, 11].overall_score == 100.0 and got[1, 12].overall_score == 0.0 and got[1, 12].w_required == 0.0
    assert (got[1, 13].experience_percent, got[1, 13].education_percent) == (60.0, 70.0)
    assert (got[2, 13].education_percent, got[2, 13].experience_percent) == (40.0, 0.0)
    with pytest.raises(ValueError):
        M.ScoreConfig(required=0.9)


def test_lexical_similarity_loses_nothing(spark):
    rng = random.Random(3)
    names_ = sorted({" ".join(rng.sample(["react", "native", "node", "js", "sql", "server", "data", "base", "ml", "c++", "and", "skills"], rng.randrange(1, 4))) for _ in range(40)} | {"reactt", "postgress", "postgresql", "and"})
    stop = set(M.STOP_WORDS)
    import re

    def score(a, b):
        ta, tb = ({t for t in re.findall(r"[a-z0-9+#.]+", x) if t not in stop} for x in (a, b))
        ratio = SequenceMatcher(None, a, b).ratio()
        if a == b:
            return 1.0
        if not ta or not tb:
            return round(ratio * 0.9, 4)
        shared = ta & tb
        contained = 0.8 if ta <= tb or tb <= ta else 0.55 * len(shared) / min(len(ta), len(tb))
        return round(min(1.0, max(len(shared) / len(ta | tb), contained, ratio * 0.85)), 4)

    df = spark.createDataFrame([(n,) for n in names_], "key string")
    got = {(r.req_key, r.cand_key): r.sim for r in M.lexical(df, df, M.ScoreConfig()).collect()}
    want = {(a, b): s for a in names_ for b in names_ if (s := score(a, b)) >= 0.75}
    assert set(got) == set(want) and all(got[k] == pytest.approx(v, abs=1e-4) for k, v in want.items())


CV = """RAM BAHADUR THAPA
ram.thapa@example.com | +977 9841-234567

SUMMARY
Developer with 2019 enthusiasm.

TECHNICAL SKILLS
• Frontend: React, Tailwind CSS
Knitting, Node.js

WORK EXPERIENCE
Frontend Developer at Leapfrog Pvt. Ltd., Jan 2022 - Dec 2024
Did many things in prose.
Junior Developer
Acme Solutions | Jul 2021 to Dec 2021

EDUCATION
Bachelor of Computer Engineering, Kathmandu University, 2021

CERTIFICATIONS
AWS Certified Cloud Practitioner.
"""


def test_cv(spark, cv_aliases):
    df = spark.createDataFrame([(1, CV), (2, None), (3, "  ")], "cv_id int, text string")
    got = {r.cv_id: r for r in V.parse_cvs(df, cv_aliases, F.expr("DATE '2026-07-15'"), "unknown").collect()}
    r = got[1]
    assert r.email == "ram.thapa@example.com" and r.phone == "+977 9841-234567" and r.name == "RAM Bahadur Thapa"
    assert r.skills[:5] == ["React", "CSS", "Tailwind CSS", "Knitting", "Node.js"]
    assert [(e.role, e.company, e.months) for e in r.experience] == [("Frontend Developer", "Leapfrog Pvt. Ltd", 35), ("Junior Developer", "Acme Solutions", 5)]
    assert r.total_experience_months == 40 and r.highest_education == "bachelor" and r.education[0].institution == "Kathmandu University" and r.education[0].year == "2021"
    assert r.certifications == ["AWS Certified Cloud Practitioner"] and r.warnings == [] and r.confidence == 1.0
    assert got[2].warnings == [V.WARNINGS["empty"]] == got[3].warnings and got[2].skills == [] and got[2].confidence == 0
    assert {x.cv_id for x in V.usable(V.parse_cvs(df, cv_aliases, NOW)).collect()} == {1}


def test_normalize(spark, aliases):
    raw = "seq long, " + RAW_POSTING
    cols = ["seq", *columns(RAW_POSTING)]
    make = lambda i, **g: tuple((dict.fromkeys(cols) | {"seq": i} | g)[c] for c in cols)
    rows = [
        make(1, title=" Intern ", source_url="https://x/1", description="Apply now\nKnow Python.\n\n\nPreferred: docker", source_platform="p", deadline="5 Mar 2026", apply_url="https://x/1"),
        make(2, title="", source_url="https://x/2"), make(3, title="x"),
    ]
    out = N.normalize_postings(spark.createDataFrame(rows, raw), aliases, NOW).collect()
    assert len(out) == 1
    r = out[0]
    assert (r.title, r.company, r.description, r.required_skills, r.preferred_skills, r.job_type, r.location, r.apply_url) == ("Intern", "Not disclosed", "Know Python.\n\nPreferred: docker", ["Python"], ["Docker"], "internship", "Nepal", None)
    assert str(r.deadline) == "2026-03-05 00:00:00" and str(r.posted_date) == "2026-07-15 00:00:00"


def test_automaton_finds_what_the_join_finds(spark, aliases):
    """Both ways, on texts of aliases within, before and behind others and odd characters."""
    rng = random.Random(4)
    pieces = [a for names in K.POSTING_SKILLS.values() for a in names] + ["c", "java", " ", ".", "+", "#", "x", "é", "İ", "-", "\n", "9"]
    texts = [(i, "".join(rng.choice(pieces) + rng.choice(["", " ", " ", ",", "."]) for _ in range(rng.randrange(60)))) for i in range(300)] + [(300, None), (301, ""), (302, "C++ c# .NET asp.net node.js!")]
    df = spark.createDataFrame(texts, "i int, t string")
    rows = lambda hits: sorted(map(tuple, hits.select("i", "canonical", "ord", "pos").collect()))
    got = rows(K.skill_hits(df, aliases, "i", "t"))
    assert got == rows(K.joined_hits(df, aliases, "i", "t")) and len(got) > 2000
    assert {r[1] for r in got if r[0] == 302} == {"C++", "C#", ".NET", "Node.js"}
    assert "Generate" not in K.skill_hits(df, aliases, "i", "t")._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("engine,n", [("exact", 1), ("exact", 4), ("lexical", 3)])
def test_top_matches_equal_all_pairs(spark, aliases, engine, n):
    """A skill that all have, CVs and postings without any, nulls, ties: the best of all pairs, from few pairs."""
    rng = random.Random(n)
    names = ["Communication"] + ["".join(rng.choices("abcdefghij", k=9)) for _ in range(40)] + ["React", "Postgres", "k8s"]
    some = lambda most: ["Communication"] * rng.randrange(2) + rng.sample(names[1:], rng.randrange(most))
    cvs = [(i, some(6), rng.choice([None, 0, 10, 30, 70]), rng.choice([None, "phd", "slc", "bachelor", "unspecified"])) for i in range(40)] + [(40, [], 0, None), (41, None, None, None)]
    jobs = [(i, rng.choice([None, [], some(5), ["Communication"]]), some(3), rng.choice([None, "entry", "mid", "senior", "unspecified"]), rng.choice([None, "master", "slc", "unspecified"])) for i in range(150)]
    cv = spark.createDataFrame(cvs, "cv_id int, skills array<string>, total_experience_months int, highest_education string")
    job = spark.createDataFrame(jobs, "job_id int, required_skills array<string>, preferred_skills array<string>, experience_level string, education_requirement string")
    config = M.ScoreConfig(engine=engine)
    every = {(r.cv_id, r.position): (r.job_id, r.overall_score) for r in M.best_matches(M.score_matches(cv, job, aliases, config), n).collect()}
    got = {(r.cv_id, r.position): (r.job_id, r.overall_score) for r in M.top_matches(cv, job, aliases, n, config).collect()}
    assert got == every and len(got) == 42 * n
    hits = M.resolve_hits(M.cv_skills(cv, aliases), M.requirements(job, aliases), config)
    pairs = M.top_pairs(cv, job, aliases, hits, n, config)
    assert pairs.count() < 0.25 * 42 * 150
    left = M.pairs_to_score(cv, job, M.cv_fingerprint(cv).where("cv_id < 20").join(job, F.lit(True)).select("cv_fp", "job_id"), pairs)
    assert 0 < left.count() <= pairs.where("cv_id >= 20").count()


@pytest.mark.parametrize("rounds", [(32,), (64, 128)])
def test_few_names_that_many_share_make_few_pairs(spark, monkeypatch, rounds):
    """Most CVs are done after the first postings; the others, and one whose best comes last, meet the rest under a higher bound."""
    monkeypatch.setattr(M, "ROUNDS", rounds)
    rng = random.Random(3)
    names = [f"Skill{i}" for i in range(12)]
    cvs = [(i, rng.sample(names, 6), rng.choice([0, 10, 30, 70]), rng.choice(["phd", "slc", "bachelor", None])) for i in range(60)] + [(60, ["Odd"], 70, "phd"), (61, [], 0, None), (62, None, None, "slc")]
    jobs = [(i, rng.sample(names, rng.randrange(1, 4)), rng.sample(names, rng.randrange(2)), rng.choice(["entry", "mid", "senior", None]), rng.choice(["master", "slc", None])) for i in range(600)]
    jobs[590] = (590, ["Odd"], [], "senior", "master")
    cv = spark.createDataFrame(cvs, "cv_id int, skills array<string>, total_experience_months int, highest_education string")
    job = spark.createDataFrame(jobs, "job_id int, required_skills array<string>, preferred_skills array<string>, experience_level string, education_requirement string")
    config, aliases, n = M.ScoreConfig(engine="exact"), K.alias_table(spark, {}), 3
    every = {(r.cv_id, r.position): (r.job_id, r.overall_score) for r in M.best_matches(M.score_matches(cv, job, aliases, config), n).collect()}
    got = {(r.cv_id, r.position): (r.job_id, r.overall_score) for r in M.top_matches(cv, job, aliases, n, config).collect()}
    assert got == every and len(got) == 63 * n and got[60, 1][0] == 590
    hits = M.resolve_hits(M.cv_skills(cv, aliases), M.requirements(job, aliases), config)
    assert M.top_pairs(cv, job, aliases, hits, n, config).count() < 0.1 * 63 * 600


def test_scores_of_pairs_look_at_their_rows_once(spark, aliases):
    """CVs and postings in no pair aren't computed, the others once, however many parts of the score read them."""
    cvs, jobs = cvs_and_jobs(spark)
    config = M.ScoreConfig(engine="exact")
    every = {(r.cv_id, r.job_id): r for r in M.score_matches(cvs, jobs, aliases, config).collect()}
    seen = spark.sparkContext.accumulator(0)

    def counted(xs):
        seen.add(1)
        return xs

    count = F.udf(counted, "array<string>")
    pairs = spark.createDataFrame([(1, 10), (1, 13), (7, 10)], "cv_id int, job_id int")
    scores = M.score_matches(cvs.withColumn("skills", count("skills")), jobs.withColumn("required_skills", count("required_skills")), aliases, config, pairs=pairs)
    assert {(r.cv_id, r.job_id): r for r in scores.collect()} == {k: every[k] for k in ((1, 10), (1, 13))}
    assert seen.value <= cvs.count() + jobs.count()


def test_common_tokens_make_few_pairs(spark):
    """A token that all names have gives no pairs by itself, and nothing that reaches the threshold is lost."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=rng.randrange(7, 12)))
    names = sorted({f"{word()} {rng.choice([word(), ''])} developer".replace("  ", " ") for _ in range(150)})
    names += [n[:-1] for n in names[:20]] + [n.replace("a", "e", 1) for n in names[20:40]] + ["developer", "and", "a", "of the", "c++", "c", "js", "jss"]
    keys = spark.createDataFrame([(n,) for n in sorted(set(names))], "key string")
    for threshold in (0.5, 0.75, 0.85, 0.95):
        pairs = M.lexical_pairs(keys, keys, threshold)
        every = keys.select(F.col("key").alias("req_key"), M.skill_tokens(F.col("key")).alias("req_tokens")).join(keys.select(F.col("key").alias("cand_key"), M.skill_tokens(F.col("key")).alias("cand_tokens")), F.lit(True))
        want = {tuple(r) for r in M.lexical_similarity(every).where(F.col("sim") >= threshold).collect()}
        got = {tuple(r) for r in M.lexical(keys, keys, M.ScoreConfig(threshold=threshold)).collect()}
        assert got == want and len(want) >= len(set(names))
        if threshold >= 0.75:
            assert pairs.count() < 0.6 * len(names) ** 2 and M.bounded(pairs, threshold).where("able").count() < 0.1 * len(names) ** 2
