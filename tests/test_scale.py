"""Plans of queries whose rows are small beside their work: where rows are dealt, and what is done once."""

import pytest
from pyspark.sql import functions as F

from vacantry.functions import dates as D
from vacantry.functions import text as X
from vacantry.operators import cv as V
from vacantry.operators import skills as K
from vacantry.plans import queries as Q
from vacantry.streaming import store as T


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_jsonld_postings_deals_rows_and_parses_blocks_once(spark, sf):
    """A small file of many rows is one task's: they are dealt once, below the parsing, which happens once for each block."""
    plan = plan_of(Q.QUERIES["jsonld_postings"](spark, sf))
    assert plan.count("parseJson") == 1
    assert plan.count("Exchange") == 1 and plan.index("Exchange") > plan.index("Generate posexplode")


@pytest.mark.parametrize("name", ["extracted_lists", "canonical_lists"])
def test_lists_are_dealt_by_id_before_they_are_sorted(spark, sf, name):
    """No sort or aggregate stands in the tasks that read the file, and nothing that grows with the rows is copied to all tasks."""
    plan = plan_of(Q.QUERIES[name](spark, sf))
    for below in plan.split("FileScan")[:-1]:  # from the last scan's end up to this one: what is nearest to it stands last
        near = below[max(below.rfind("Exchange"), 0) :]
        assert not any(step in near for step in ("Sort ", "SortAggregate", "ObjectHashAggregate"))
    assert "LeftOuter, BuildRight" not in plan.split("SortAggregate")[0]


def test_values_without_a_skill_pass_through_extraction(spark):
    """Rows without values, blank and null values, values without a skill, and a table of aliases that is joined."""
    rows = spark.createDataFrame([(1, ["  ", None, "Odd", "sql, python", "Odd"]), (2, []), (3, None), (4, ["python", "SQL"])], "i long, xs array<string>")
    aliases = K.alias_table(spark, K.POSTING_SKILLS)
    want = {1: ["Odd", "Python", "SQL"], 2: [], 3: [], 4: ["Python", "SQL"]}
    assert {r.i: r.skills for r in K.canonicalise_by_extraction(rows, aliases, "i", "xs").collect()} == want
    texts = spark.createDataFrame([(1, "python odd"), (2, "odd"), (3, ""), (4, "?")], "i long, t string")
    found = {most: sorted(map(tuple, K.skill_hits(texts, aliases, "i", "t", every=True).select("i", "canonical").collect()), key=repr) for most in _automaton_sizes()}
    assert all(v == [(1, "Python"), (2, None), (4, None)] for v in found.values())


def _automaton_sizes():
    """The module's bound, then 0, so that the table of aliases is joined."""
    kept = K.AUTOMATON_ROWS
    try:
        for most in (kept, 0):
            K.AUTOMATON_ROWS = most
            yield most
    finally:
        K.AUTOMATON_ROWS = kept


@pytest.mark.parametrize("name", ["store_batches", "change_feed"])
def test_batches_are_dealt_before_they_are_checked(spark, sf, name, monkeypatch):
    """A file of one row group is read by one task, which must not be that which checks the batch."""
    tasks = []

    class Enough(Exception):
        pass

    def ingest(self, raw, batch, now):
        tasks.append(raw.rdd.getNumPartitions())
        raise Enough

    monkeypatch.setattr(T.PostingStore, "ingest", ingest)
    with pytest.raises(Enough):
        Q.QUERIES[name](spark, sf)
    assert tasks == [4]


def test_hash_reads_the_start_of_a_description_alone(spark):
    """The hash is that of the whole text's first characters in hash form, and white space goes as a pattern takes it."""
    spaces = "\t\x0b\x85\xa0    　 "
    texts = ["", " ", "-" * 5000 + "A" * 300, "a" * 100 + "-b", "a" * 99 + " - B - c", "a-" * 300, "İK" * 60 + "é9", "É" * 500 + "x", "a\r\n\rb\r", spaces + "\n​x y" + spaces + "\r\n"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    whole = F.sha2(F.concat_ws("|", F.lit("t"), F.lit("c"), F.substring(X.hash_form(F.col("t")), 1, 100)), 256)
    stripped = F.regexp_replace(F.regexp_replace("t", "\r\n?", "\n"), r"(?U)^\s+|\s+$", "")
    got = df.select(X.dedupe_hash(F.lit("T"), F.lit("C"), F.col("t")).alias("hash"), whole.alias("whole"), X.strip(X.unix_lines(F.col("t"))).alias("strip"), stripped.alias("stripped")).collect()
    assert [r["hash"] for r in got] == [r["whole"] for r in got] and [r["strip"] for r in got] == [r["stripped"] for r in got]
    plan = plan_of(df.select(X.dedupe_hash(F.lit("T"), F.lit("C"), F.col("t"))))
    assert "lower(regexp_extract(" in plan


def test_lines_of_cvs_are_read_once(spark):
    """A degree's level, a date range and a line without marks are computed once for a line, not anew in each filter and column that names them."""
    cvs = spark.createDataFrame([(1, "Education\nBE in Civil, 2001\nExperience\nTester at Acme Ltd, Jan 2001 - Mar 2002\nCertifications\nAWS Certified")], "cv_id int, text string")
    lines = V.cv_lines(cvs).localCheckpoint()
    plan = plan_of(V.education(cvs, lines))
    assert plan.count("doctorate") == 1 and plan.count("Polytechnic") == 1
    plan = plan_of(V.experience(cvs, lines, F.expr("DATE '2024-01-15'")))
    assert plan.count("regexp_extract(line") == 1 and plan.count("through") < 20
    plan = plan_of(V.certifications(cvs, lines))
    assert plan.count("regexp_replace(") < 20


ODD = ["", " ", "•", "- \t*» Skills:\r", "x-\u2028", "x;\u2028-", "x \x85", "- x\u2029", "•\u2028", "a\xa0", "\xa0- b", "★ EDUCATION ★", "&skills", "& training", "12) Work  Experience (5)", "İT SKILLS", "\u212aey skills", "skillset", "Core-Skills", "Profile\u2028", "x" * 70 + " skills",
       "Skills" + "." * 70, "a" * 61, "Courses and a long addition to it", "about me", "About us", "Summary" + " " * 70 + "\u2028"]


def test_shortcuts_of_cv_lines_give_what_patterns_give(spark):
    """Headings, trimmed lines and addresses by their quick ways and by patterns alone, on odd lines."""
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*ODD, *(p.upper() for all_ in V.HEADINGS.values() for p in all_), None])], "cv_id int, text string")
    c, class_ = F.col("text"), rf"\s{V.BULLETS}"
    got = df.select(V.bare(c).alias("bare"), V.strip(c, class_).alias("w_bare"), V.trimmed(c, V.BULLETS, ".;").alias("both"), V.strip(V.strip(c, class_), r"\s.;").alias("w_both"), V.heading(c).alias("head"), V._heading(c).alias("w_head")).collect()
    assert all((r.bare, r.both, r.head) == (r.w_bare, r.w_both, r.w_head) for r in got)
    assert sum(r.head is not None for r in got) > 50
    mails = ["a@b@c.com", "x@y.z@c.com, d@e.org", "..a+b@c.de.", "@c.com", "a@b", "", None, "é.a@b.com;", "a" * 50 + "@b.com"]
    df = spark.createDataFrame(list(enumerate(mails)), "cv_id int, text string")
    want = df.select("cv_id", V.strip(F.regexp_extract(X.text(F.col("text")), X.EMAIL, 0), ".,;").alias("email"))
    assert sorted(V.emails(df).collect()) == sorted(want.collect())


def test_date_ranges_begin_where_they_did(spark):
    texts = ["Jan 2001 - Mar 2002", "sept, 1999–now", "x2001 to 2003", "MAY. 2010 until Present", "augu2001 - dec 2002", "of 1899 - 1901", "mayor 1999 - 2000", "2001-2002-2003", "June,  2001 through till date", "k\u017fep 2001 - 2002", ""]
    plain = D.RANGE.replace("(?=[jfmasond][aepuco]|19|20)", "")
    assert plain != D.RANGE
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select(*[f(F.col("t"), p).alias(f"{n}{k}") for k, p in enumerate((D.RANGE, plain)) for n, f in (("a", lambda c, p: F.regexp_extract_all(c, F.lit(p), F.lit(0))), ("b", lambda c, p: F.regexp_replace(c, p, "-")))]).collect():
        assert r.a0 == r.a1 and r.b0 == r.b1
