"""Search, sort, page, facets and statistics over postings."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from datetime import datetime
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vacantry.functions import classify as C
from vacantry.functions.dates import is_expired, is_open
from vacantry.functions.stem import CHANGED, WHOLE_WORDS, stem
from vacantry.functions.text import all_sources, text

DEFAULT_LIMIT, MOST_LIMIT = 20, 100
#: Weights of the fields in keyword relevance.
WEIGHTS = {"title": 10, "company": 5, "required_skills": 4, "description": 1}
#: Words that keyword search leaves out.
STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "from", "has", "have", "he", "her", "his", "i", "if", "in", "into", "is", "it", "its", "my", "no", "not", "of", "on", "or", "our",
    "she", "so", "such", "that", "the", "their", "then", "there", "these", "they", "this", "to", "was", "we", "were", "will", "with", "you", "your",
)
TOKEN_GAP = r"[^\p{L}\p{N}+#.]+"


@dataclass(frozen=True)
class SearchSpec:
    """A validated search: what to filter, how to sort, which page; ``warnings`` name what was ignored."""

    keyword: str = ""
    location: str = ""
    company: str = ""
    job_types: tuple[str, ...] = ()
    experience_levels: tuple[str, ...] = ()
    education_levels: tuple[str, ...] = ()
    sources: tuple[str, ...] = ()
    any_source: bool = False
    skills: tuple[str, ...] = ()
    include_expired: bool = False
    sort: str = "newest"
    page: int = 1
    limit: int = DEFAULT_LIMIT
    warnings: tuple[str, ...] = field(default=())


def whole_number(value: object) -> int:
    """The number a text begins with, else 0."""
    import re

    m = re.match(r"\s*([+-]?\d+)", str(value if value is not None else ""))
    return int(m[1]) if m else 0


def plan_search(query: Mapping[str, object]) -> SearchSpec:
    """A spec from loose parameters: unknown enumeration values are ignored with a warning, numbers are clamped."""
    clean = lambda v: " ".join(str(v if v is not None else "").split())

    def listed(value: object) -> list[str]:
        items = value if isinstance(value, (list, tuple)) else str(value if value is not None else "").split(",")
        return [x for x in (clean(v).lower() for v in items) if x]

    warnings: list[str] = []

    def enum(name: str, label: str, allowed: tuple[str, ...]) -> tuple[str, ...]:
        values = listed(query.get(name))
        warnings.extend(f"ignored unknown {label}: {v}" for v in values if v not in allowed)
        return tuple(v for v in values if v in allowed)

    keyword = clean(query.get("q") or query.get("keyword"))
    types = enum("job_type", "jobType", C.JOB_TYPES)
    levels = enum("experience_level", "experienceLevel", C.EXPERIENCE_LEVELS)
    education = enum("education_requirement", "educationRequirement", C.EDUCATION_LEVELS)
    sort = str(query.get("sort") or "")
    if sort not in ("newest", "oldest", "deadline", "relevance"):
        sort = "relevance" if keyword else "newest"
    return SearchSpec(
        keyword, clean(query.get("location")), clean(query.get("company")), types, levels, education, tuple(listed(query.get("source") or query.get("source_platform"))),
        bool(query.get("any_source")), tuple(listed(query.get("skills"))), str(query.get("include_expired")).lower() == "true", sort,
        max(whole_number(query.get("page")) or 1, 1), min(max(whole_number(query.get("limit")) or DEFAULT_LIMIT, 1), MOST_LIMIT), tuple(warnings),
    )


def tokens(c: Column) -> Column:
    """Lower-case words; letters, digits and ``+ # .`` belong to words."""
    return F.filter(F.split(F.lower(text(c)), TOKEN_GAP), lambda t: (t != "") & ~t.isin(*STOP_WORDS))


def keyword_terms(keyword: str) -> list[str]:
    import re

    return sorted({t for t in re.split(r"[^\w+#.]+|_", keyword.lower()) if t and t not in STOP_WORDS})


def stemmed_terms(spark: SparkSession, keyword: str) -> list[str]:
    """The stems of a keyword's terms, each once."""
    terms = keyword_terms(keyword)
    rows = spark.createDataFrame([(t,) for t in terms], "term string").select(stem(F.col("term"))).distinct().collect() if terms else []
    return sorted(r[0] for r in rows)


def field_text(name: str) -> Column:
    return F.array_join(F.coalesce(name, F.array().cast("array<string>")), " ") if name == "required_skills" else F.col(name)


def relevance(terms: list[str]) -> Column:
    """Sum over fields of weight times occurrences of words with any of the stems; 0 if there are none.

    Stems are computed only of words that begin like one: a stem and its words share
    all but the stem's last ``CHANGED`` letters, or the word is one of those that the
    stemmer knows as a whole.
    """
    if not terms:
        return F.lit(0)
    heads = sorted({t[: max(len(t) - CHANGED, 2)] for t in terms})

    def near(name: str, weight: int) -> Column:
        words = F.filter(tokens(field_text(name)), lambda t: reduce(or_, (t.startswith(h) for h in heads)) | t.isin(*WHOLE_WORDS))
        return F.transform(words, lambda t: F.struct(t.alias("word"), F.lit(weight).alias("weight")))

    words = F.concat(*[near(name, weight) for name, weight in WEIGHTS.items()])
    return F.aggregate(words, F.lit(0), lambda total, w: F.when(stem(w["word"]).isin(*terms), total + w["weight"]).otherwise(total))


def filtered(postings: DataFrame, spec: SearchSpec, now: Column, scored: bool = False) -> DataFrame:
    """The postings that match, with ``score`` (0 without a keyword); ``scored`` postings have it already."""
    out = postings
    for name, value in (("location", spec.location), ("company", spec.company)):
        if value:
            out = out.where(F.contains(F.lower(name), F.lit(value.lower())))
    for name, values in (("job_type", spec.job_types), ("experience_level", spec.experience_levels), ("education_requirement", spec.education_levels)):
        if values:
            out = out.where(F.col(name).isin(*values))
    if spec.sources:
        own = F.col("source_platform").isin(*spec.sources)
        out = out.where(own | F.exists("sources", lambda s: s["platform"].isin(*spec.sources)) if spec.any_source else own)
    if spec.skills:
        none = F.array().cast("array<string>")
        have = F.transform(F.concat(F.coalesce("required_skills", none), F.coalesce("preferred_skills", none)), F.lower)
        out = out.where(F.arrays_overlap(have, F.array(*map(F.lit, spec.skills))))
    if not spec.include_expired:
        out = out.where(is_open(F.col("deadline"), now))
    if scored:
        return out
    if spec.keyword:
        # a generated column, so that the filter doesn't compute the score a second time
        return out.withColumn("score", F.explode(F.array(relevance(stemmed_terms(postings.sparkSession, spec.keyword))))).where("score > 0")
    return out.withColumn("score", F.lit(0))


def order_of(spec: SearchSpec) -> list[Column]:
    """Sort keys; the hash breaks ties. Postings without a deadline come first by deadline."""
    newest = [F.desc("posted_date"), F.desc("dedupe_hash")]
    return {
        "newest": newest, "oldest": [F.asc("posted_date"), F.asc("dedupe_hash")], "deadline": [F.asc_nulls_first("deadline"), F.asc("dedupe_hash")],
        "relevance": [F.desc("score"), F.desc("posted_date"), F.asc("dedupe_hash")] if spec.keyword else newest,
    }[spec.sort]


def paged(rows: DataFrame, spec: SearchSpec) -> DataFrame:
    return rows.orderBy(*order_of(spec)).offset((spec.page - 1) * spec.limit).limit(spec.limit)


def search(postings: DataFrame, spec: SearchSpec, now: Column) -> DataFrame:
    """One page, in order. Planned as a top-k: no full sort."""
    return paged(filtered(postings, spec, now), spec)


def page_info(postings: DataFrame, spec: SearchSpec, now: Column) -> DataFrame:
    """``page, page_size, total, total_pages, has_next, has_prev`` of a search."""
    total = filtered(postings, spec, now).agg(F.count("*").alias("total"))
    skip = (spec.page - 1) * spec.limit
    return total.select(
        F.lit(spec.page).alias("page"), F.lit(spec.limit).alias("page_size"), "total", F.greatest(F.ceil(F.col("total") / spec.limit), F.lit(1)).cast("long").alias("total_pages"),
        (F.col("total") > skip + spec.limit).alias("has_next"), F.lit(spec.page > 1).alias("has_prev"),
    )


def by_id(postings: DataFrame, job_id: str) -> DataFrame:
    return postings.where(F.col("dedupe_hash") == job_id)


def requirements_of(postings: DataFrame, ids: DataFrame) -> DataFrame:
    """What scoring needs of the postings whose hash is in ``ids`` (column ``dedupe_hash``)."""
    wanted = postings.select(F.col("dedupe_hash").alias("job_id"), "required_skills", "preferred_skills", "experience_level", "education_requirement", "title")
    return wanted.join(ids.select(F.col("dedupe_hash").alias("job_id")), "job_id", "left_semi")


def serialised(postings: DataFrame, now: Column) -> DataFrame:
    """With the computed columns ``all_sources`` and ``is_expired``."""
    return postings.withColumn("all_sources", all_sources(F.col("source_platform"), F.col("source_url"), F.col("sources"))).withColumn("is_expired", is_expired(F.col("deadline"), now))


def counts_by(postings: DataFrame, column: str) -> DataFrame:
    """``value, n``, most frequent first, ties by value; blank values are left out."""
    rows = postings.where(F.col(column).isNotNull() & (F.col(column) != ""))
    return rows.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value")


def counts_by_each(postings: DataFrame, *columns: str) -> DataFrame:
    """``facet, value, n`` of several columns in one pass."""
    facets = F.explode(F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).alias("value")) for c in columns])).alias("f")
    return postings.select(facets).select("f.facet", "f.value").where("value IS NOT NULL AND value <> ''").groupBy("facet", "value").agg(F.count("*").alias("n"))


def stats(postings: DataFrame, now: Column) -> DataFrame:
    """``total, fresh, open_now`` in one pass; fresh is posted in the last 24 hours or to come."""
    return postings.agg(
        F.count("*").alias("total"), F.count_if(F.col("posted_date") >= now - F.expr("INTERVAL 24 HOURS")).alias("fresh"), F.count_if(is_open(F.col("deadline"), now)).alias("open_now")
    )


def facet_values(postings: DataFrame, column: str, limit: int | None = None) -> DataFrame:
    """Distinct values that aren't blank, sorted; the first ``limit`` of them."""
    out = postings.select(F.col(column).alias("value")).where("value IS NOT NULL AND value <> ''").distinct().orderBy("value")
    return out if limit is None else out.limit(limit)


def saved_list(events: DataFrame) -> DataFrame:
    """``user_id, job_id, ts`` of what is saved: an odd number of toggles, by their last time. Input: ``user_id, job_id, ts``."""
    return events.groupBy("user_id", "job_id").agg(F.count("*").alias("n"), F.max("ts").alias("ts")).where("n % 2 = 1").drop("n")


def saved_postings(saved: DataFrame, postings: DataFrame) -> DataFrame:
    """Each user's saved postings, newest first (``position`` from 1); ``missing`` where the posting is gone."""
    order = Window.partitionBy("user_id").orderBy(F.desc("ts"), "job_id")
    placed = saved.withColumn("position", F.row_number().over(order))
    found = placed.join(postings.withColumn("job_id", F.col("dedupe_hash")), "job_id", "left")
    return found.withColumn("missing", F.col("dedupe_hash").isNull())


def at_now(now: datetime) -> Column:
    return F.lit(now)
