"""Landed records of job boards as raw postings.

Every mapping is a plan from a DataFrame of records to the columns of
``RAW_POSTING``; ``SOURCES`` names them. Nothing is fetched here: files are read
with an explicit schema (see the ``*_SCHEMA`` texts) and unknown fields are null.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vacantry.functions.classify import first_mapped, mapped
from vacantry.functions.dates import from_epoch, money
from vacantry.functions.text import blank_to_null, clean_text, find_apply_link, html_to_text, text
from vacantry.schemas import RAW_POSTING, names

#: Names of levels, education and job types on the boards and what they mean here.
LEVELS = {"entry level": "entry", "fresher": "entry", "junior level": "entry", "mid level": "mid", "senior level": "senior", "top level": "senior", "top management": "senior"}
EDUCATION = {
    "under graduate (bachelor)": "bachelor", "graduate (masters)": "master", "post graduate": "master", "intermediate (+2)": "diploma",
    "higher secondary (+2/a levels)": "diploma", "diploma": "diploma", "phd": "phd", "slc": "slc", "see": "slc",
}
TYPES = {"full time": "full-time", "part time": "part-time", "internship": "internship", "contract": "contract", "freelance": "contract", "remote": "remote", "traineeship": "internship"}
DETAIL_TYPES = TYPES | {"intern": "internship", "temporary": "contract"}
FEED_TYPES = {
    "full time": "full-time", "full-time": "full-time", "part time": "part-time", "part-time": "part-time", "contract": "contract", "contractor": "contract",
    "freelance": "contract", "temporary": "contract", "internship": "internship", "intern": "internship",
}
SENIORITY = {
    "entry": "entry", "entry-level": "entry", "junior": "entry", "graduate": "entry", "mid": "mid", "mid-level": "mid", "intermediate": "mid", "associate": "mid",
    "senior": "senior", "lead": "senior", "principal": "senior", "staff": "senior", "director": "senior", "executive": "senior", "manager": "senior",
}

PLACE = "struct<name:string>"
LISTING_SCHEMA = (
    "status string, title string, slug string, absolute_url string, client struct<client_name:string>, hide_org_name boolean, hide_salary boolean, description string, "
    "specification string, extra_description string, job_summary string, skills array<string>, job_level string, experience_required string, education_level string, "
    "education_description string, available_for array<string>, job_locations array<struct<address:string,name:string,district:" + PLACE + ",local_government:" + PLACE + ",province:" + PLACE + ">>, "
    "offered_salary struct<minimum:double,maximum:double,currency:string,unit:string>, deadline string, posted_at string, posted_date string, apply_url string, "
    "external_apply_url string, external_url string, application_url string, apply_link string, how_to_apply string, apply_procedure string, apply_instruction string"
)
PAGE_SCHEMA = f"count long, next string, previous string, results array<struct<{LISTING_SCHEMA.replace(' string', ':string').replace(' struct', ':struct').replace(' array', ':array').replace(' boolean', ':boolean')}>>"
FEED_SCHEMA = (
    "guid string, title string, companyName string, description string, excerpt string, employmentType string, seniority array<string>, locationRestrictions array<string>, "
    "minSalary string, maxSalary string, currency string, salaryPeriod string, expiryDate string, pubDate string, applicationLink string"
)
REMOTE_SCHEMA = "url string, title string, company_name string, description string, remote boolean, location string, created_at string"
DETAIL_SCHEMA = (
    "url string, jobTitle string, jobPurpose string, jobDescription string, jobSpecification string, educationRequired string, educationlevel struct<title:string>, joblevel struct<title:string>, "
    "jobtype struct<title:string>, minExperience string, maxExperience string, salaryType string, applyUrl string, externalApplyUrl string, externalUrl string, applyLink string, "
    "applicationUrl string, howToApply string, applyProcedure string"
)


def as_raw(df: DataFrame, platform: str, **columns: Column) -> DataFrame:
    """A frame with all columns of ``RAW_POSTING``; those not given are null."""
    from pyspark.sql.types import StructType

    columns = {"source_platform": F.lit(platform)} | columns
    fields = StructType.fromDDL(RAW_POSTING)
    return df.select(*[columns.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in fields])


def join_parts(separator: str, *parts: Column) -> Column:
    return F.concat_ws(separator, *[blank_to_null(p) for p in parts])


def distinct_places(values: Column) -> Column:
    """The first three different places that aren't blank, with commas."""
    return F.array_join(F.slice(F.array_distinct(F.filter(F.coalesce(values, F.array().cast("array<string>")), lambda v: v.isNotNull() & (v != ""))), 1, 3), ", ")


def listing_pages(spark: SparkSession, path: str) -> DataFrame:
    """The records of paged listing files, one JSON page for each line."""
    return spark.read.schema(PAGE_SCHEMA).json(path).select(F.explode("results").alias("r")).select("r.*")


def from_listing(records: DataFrame, platform: str = "listing", base_url: str = "https://listing.example.com") -> DataFrame:
    """Published records with a title and a path; a hidden company is confidential, a hidden salary is left out."""
    c = F.col
    title = F.trim(text(c("title")))
    path = F.coalesce(blank_to_null(c("absolute_url")), F.when(text(c("slug")) != "", F.concat(F.lit("/"), "slug", F.lit("/"))), F.lit(""))
    rows = records.where((text(c("status")) == "") | (F.lower("status") == "published")).where((title != "") & (path != ""))
    extra = F.when(text(c("extra_description")) == "None", F.lit("")).otherwise(html_to_text(c("extra_description")))
    body = join_parts("\n\n", html_to_text(c("description")), html_to_text(c("specification")), extra)
    place = F.transform("job_locations", lambda p: F.coalesce(*[blank_to_null(F.trim(x)) for x in (p["address"], p["name"], p["district"]["name"], p["local_government"]["name"], p["province"]["name"])]))
    low, high = F.nullif(c("offered_salary.minimum"), F.lit(0.0)), F.nullif(c("offered_salary.maximum"), F.lit(0.0))
    # a range needs an upper end; without one the lower end stands alone
    one = F.format_number(F.coalesce(low, F.lit(0.0)), 0)
    amount = F.when(high.isNull() | low.eqNullSafe(high), one).otherwise(F.concat(F.format_number(F.coalesce(low, F.lit(0.0)), 0), F.lit(" - "), F.format_number(high, 0)))
    salary = F.concat_ws(" ", F.coalesce(blank_to_null(c("offered_salary.currency")), F.lit("NRs")), amount, F.when(text(c("offered_salary.unit")) != "", F.concat(F.lit("/ "), c("offered_salary.unit"))))
    direct = F.coalesce(*[blank_to_null(clean_text(c(k))) for k in ("apply_url", "external_apply_url", "external_url", "application_url", "apply_link")])
    return as_raw(
        rows, platform, title=title, company=F.when(c("hide_org_name"), "Confidential").otherwise(F.trim(text(c("client.client_name")))),
        description=F.coalesce(blank_to_null(body), html_to_text(c("job_summary"))), requirements=html_to_text(c("specification")), required_skills=F.filter("skills", lambda s: text(s) != ""),
        experience_level=mapped(c("job_level"), LEVELS), experience_raw=c("experience_required"), education_requirement=mapped(c("education_level"), EDUCATION),
        education_raw=join_parts(" ", text(c("education_level")), html_to_text(c("education_description"))), job_type=first_mapped(c("available_for"), TYPES), job_type_raw=F.array_join("available_for", ", "),
        location=distinct_places(place), salary=F.when(F.coalesce(c("hide_salary"), F.lit(False)) | (low.isNull() & high.isNull()), "").otherwise(salary), deadline=c("deadline"),
        posted_date=F.coalesce(blank_to_null(c("posted_at")), c("posted_date")), source_url=F.when(path.startswith("http"), path).otherwise(F.concat(F.lit(base_url), path)),
        apply_url=F.coalesce(direct, find_apply_link(c("how_to_apply"), c("apply_procedure"), c("apply_instruction"))),
    )


def from_feed(records: DataFrame, platform: str = "feed") -> DataFrame:
    """A remote board's feed: web addresses only; restrictions become the location, the first known seniority counts."""
    c = F.col
    url = F.trim(text(c("guid")))
    limits = F.filter(F.transform("locationRestrictions", lambda r: F.trim(r)), lambda r: text(r) != "")
    link = F.trim(text(c("applicationLink")))
    return as_raw(
        records.where(url.startswith("http") & (text(c("title")) != "")), platform, title=c("title"), company=c("companyName"), description=html_to_text(F.coalesce(blank_to_null(c("description")), c("excerpt"))),
        job_type=mapped(c("employmentType"), FEED_TYPES), experience_level=first_mapped(c("seniority"), SENIORITY),
        location=F.when(F.size(F.coalesce(limits, F.array().cast("array<string>"))) > 0, F.concat(F.lit("Remote ("), F.array_join(limits, ", "), F.lit(")"))).otherwise("Remote (Worldwide)"),
        salary=money(c("minSalary"), c("maxSalary"), c("currency"), c("salaryPeriod")), deadline=from_epoch(c("expiryDate")).cast("string"), posted_date=from_epoch(c("pubDate")).cast("string"),
        source_url=url, apply_url=F.when((link != "") & (link != url), link),
    )


def from_remote_feed(records: DataFrame, platform: str = "remote") -> DataFrame:
    """A board's feed of which remote postings are kept."""
    c = F.col
    url = F.trim(text(c("url")))
    rows = records.where(F.coalesce(c("remote"), F.lit(False)) & url.startswith("http") & (text(c("title")) != ""))
    location = F.when(text(c("location")) != "", F.concat(F.lit("Remote — "), "location")).otherwise("Remote")
    return as_raw(rows, platform, title=c("title"), company=c("company_name"), description=html_to_text(c("description")), job_type=F.lit("remote"), location=location, posted_date=from_epoch(c("created_at")).cast("string"), source_url=url)


def enriched(postings: DataFrame, details: DataFrame, platform: str = "detail") -> DataFrame:
    """Raw postings joined with optional detail records by address; what the detail says about type, level, education and text wins."""
    c = F.col
    d = details.select(*[F.col(x).alias(f"d_{x}") for x in details.columns])
    rows = postings.join(d, c("source_url") == c("d_url"), "left")
    body = join_parts("\n\n", html_to_text(c("d_jobPurpose")), html_to_text(c("d_jobDescription")), html_to_text(c("d_jobSpecification")))
    kind, level, edu = (F.trim(text(x)) for x in (F.coalesce(blank_to_null(c("d_jobtype.title")), c("job_type_raw")), c("d_joblevel.title"), c("d_educationlevel.title")))
    low, high = F.trim(text(c("d_minExperience"))), F.trim(text(c("d_maxExperience")))
    span = F.when(high.isin("", "-1", "-2", "0"), F.concat(low, F.lit("+ years"))).otherwise(F.concat(low, F.lit("-"), high, F.lit(" years")))
    note = F.when((low != "") & ~low.isin("0", "-1", "-2"), F.trim(F.concat(span, F.lit(" "), level))).otherwise(level)
    direct = F.coalesce(*[blank_to_null(clean_text(c(f"d_{k}"))) for k in ("applyUrl", "externalApplyUrl", "externalUrl", "applyLink", "applicationUrl")])
    given = {x: c(x) for x in names(RAW_POSTING)}
    return as_raw(rows, platform, **(given | {
        "title": F.trim(F.coalesce(blank_to_null(c("title")), c("d_jobTitle"), F.lit(""))), "description": F.coalesce(blank_to_null(body), c("description")),
        "requirements": join_parts("\n", html_to_text(c("d_jobSpecification")), html_to_text(c("d_educationRequired"))),
        "experience_level": F.coalesce(mapped(level, LEVELS), c("experience_level")), "experience_raw": F.coalesce(blank_to_null(note), c("experience_raw")),
        "education_requirement": F.coalesce(mapped(edu, EDUCATION), c("education_requirement")), "education_raw": F.coalesce(blank_to_null(join_parts(" ", edu, html_to_text(c("d_educationRequired")))), c("education_raw")),
        "job_type": F.coalesce(mapped(kind, DETAIL_TYPES), c("job_type")), "job_type_raw": kind,
        "apply_url": F.coalesce(direct, find_apply_link(c("d_howToApply"), c("d_applyProcedure")), c("apply_url")),
    }))


def sitemap_entries(files: DataFrame) -> DataFrame:
    """``path, is_index, pos, loc, lastmod`` of sitemap texts (``path, value``: one whole file in each row)."""
    blocks = F.regexp_extract_all("value", F.lit(r"(?s)(<loc>.*?</loc>\s*(?:<lastmod>.*?</lastmod>)?)"), F.lit(1))
    rows = files.select("path", F.col("value").rlike("(?i)<sitemapindex").alias("is_index"), F.posexplode(blocks).alias("pos", "block"))
    return rows.select("path", "is_index", "pos", F.trim(F.regexp_extract("block", r"(?s)<loc>(.*?)</loc>", 1)).alias("loc"), F.trim(F.regexp_extract("block", r"(?s)<lastmod>(.*?)</lastmod>", 1)).alias("lastmod"))


def sitemap_frontier(entries: DataFrame, roots: DataFrame, patterns: DataFrame, most_sitemaps: int = 3, most_urls: int = 40) -> DataFrame:
    """``source, loc, lastmod, position``: each source's posting addresses, newest first.

    ``roots``: ``source, path`` of the root sitemap. ``patterns``: ``source,
    sitemap_pattern, url_pattern`` (few rows). An index opens its newest
    ``most_sitemaps`` children whose address fits; addresses count once.
    """
    first = entries.join(roots, "path")
    known = first.join(patterns, "source")
    newest = Window.partitionBy("source").orderBy(F.desc("lastmod"), "pos")
    children = known.where(F.col("is_index") & F.rlike("loc", F.col("sitemap_pattern"))).withColumn("n", F.row_number().over(newest)).where(F.col("n") <= most_sitemaps)
    opened = children.select("source", "url_pattern", F.col("loc").alias("path"), F.col("n").alias("opened"))
    nested = entries.join(opened, "path").select("source", "url_pattern", "opened", "pos", "loc", "lastmod")
    flat = known.where(~F.col("is_index")).select("source", "url_pattern", F.lit(0).alias("opened"), "pos", "loc", "lastmod")
    fits = flat.unionByName(nested).where(F.rlike("loc", F.concat(F.lit("^(?:"), "url_pattern", F.lit(")"))))
    order = F.struct(F.col("lastmod").alias("l"), (-F.col("opened")).alias("o"), (-F.col("pos")).alias("p"))
    once = fits.groupBy("source", "loc").agg(F.max("lastmod").alias("lastmod"), F.max(order).alias("k"))
    position = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("k")))
    return once.withColumn("position", position).where(F.col("position") <= most_urls).select("source", "loc", "lastmod", "position")


def limited(raw: DataFrame, platforms: Sequence[str] = (), cap: int | None = None, order: str = "source_url") -> DataFrame:
    """Chosen platforms only, one row for each address of a platform, ``cap`` rows of a platform at most."""
    rows = raw.where(F.col("source_platform").isin(*platforms)) if platforms else raw
    once = Window.partitionBy("source_platform", "source_url").orderBy(order)
    rows = rows.withColumn("_n", F.row_number().over(once)).where("_n = 1").drop("_n")
    if cap is not None:
        rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy("source_platform").orderBy(order))).where(F.col("_n") <= cap).drop("_n")
    return rows


def split_usable(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that can become postings, and the others with a ``reason``."""
    reason = F.when(clean_text(F.col("title")) == "", "missing title").when(clean_text(F.col("source_url")) == "", "missing sourceUrl")
    tagged = raw.withColumn("reason", reason)
    return tagged.where("reason IS NULL").drop("reason"), tagged.where("reason IS NOT NULL")


def united(*frames: DataFrame) -> DataFrame:
    """All sources as one frame."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def source_counts(raw: DataFrame) -> DataFrame:
    return raw.groupBy("source_platform").agg(F.count("*").alias("n"))


def write_json(postings: DataFrame, path: str) -> None:
    """The sink of a run: JSON lines."""
    postings.write.mode("overwrite").json(path)


#: Mappings by name.
SOURCES: dict[str, Callable[..., DataFrame]] = {"listing": from_listing, "feed": from_feed, "remote": from_remote_feed}
