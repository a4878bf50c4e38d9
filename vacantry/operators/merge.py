"""Copies of one vacancy made one row: merges, folds and the upsert into the store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vacantry.functions import classify as C
from vacantry.functions import text as X
from vacantry.functions.dates import lenient_date
from vacantry.schemas import SOURCES

#: Limits of a stored posting.
TITLE_CHARS, LOCATION_CHARS, DESCRIPTION_CHARS, SKILLS = 300, 200, 20000, 60


def source_of(platform: str = "source_platform", url: str = "source_url") -> Column:
    return F.array(F.struct(F.col(platform).alias("platform"), F.col(url).alias("url")))


def merge_duplicates(postings: DataFrame, filled: bool = True) -> DataFrame:
    """Cross-source merge in the order of ``seq``: the richest copy shows, skills and sources are united.

    A copy is richer by length of description, number of required skills (the
    united ones for the copy that shows so far), a salary and a deadline. Rows
    without a hash are dropped. Copies of one ``seq`` follow in the order of a hash.
    A salary and a deadline that were filled in from other copies count for the copy
    that shows so far, unless ``filled`` is false.
    Returns the posting's columns and ``sources``.

    Lists are united by a second aggregation on (hash, value). Which copy shows
    depends on the order: a window over lengths, counts and marks alone leaves
    the few copies that can replace the one that shows or fill its gaps, and
    these are folded. No group gathers its copies in one row.
    """
    cols = [c for c in postings.columns if c not in ("sources", "dedupe_hash", "seq")]
    rows = postings.where("dedupe_hash IS NOT NULL AND dedupe_hash <> ''").withColumn("at", F.struct("seq", F.xxhash64(*cols).alias("mark")))
    none = F.array().cast("array<string>")

    def firsts(values: str) -> DataFrame:
        items = rows.select("dedupe_hash", "at", F.posexplode(X.union_lists(F.col(values))).alias("pos", "v"))
        return items.groupBy("dedupe_hash", F.lower("v").alias("k")).agg(F.min(F.struct("at", "pos", "v")).alias("f"))

    def united(found: DataFrame, name: str) -> DataFrame:
        return found.groupBy("dedupe_hash").agg(F.transform(F.array_sort(F.collect_list("f")), lambda f: f["v"]).alias(name))

    required = firsts("required_skills")
    news = required.groupBy("dedupe_hash", F.col("f.at").alias("at")).agg(F.count("*").alias("news"))
    narrow = rows.select(
        "dedupe_hash", "at", F.length(F.coalesce("description", F.lit(""))).alias("chars"), F.size(F.coalesce("required_skills", none)).alias("skills"),
        (X.text(F.col("salary")) != "").cast("int").alias("paid"), F.col("deadline").isNotNull().cast("int").alias("dated"), "salary", "deadline",
    ).distinct()
    order = Window.partitionBy("dedupe_hash").orderBy("at")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    seen = narrow.join(news, ["dedupe_hash", "at"], "left").select(
        "*", F.row_number().over(order).alias("place"), F.max("chars").over(before).alias("most"), F.lag("skills").over(order).alias("last_skills"),
        F.coalesce(F.sum("news").over(before), F.lit(0)).alias("united"), *[((F.count(c).over(before) == 0) & F.col(c).isNotNull()).alias(f"first_{c}") for c in ("salary", "deadline")],
    )
    # the first copy's list counts as it stands until it is united with another
    seen = seen.withColumn("united", F.when(F.col("place") == 2, F.col("last_skills")).otherwise(F.col("united")).cast("int")).withColumn("early", F.least("place", F.lit(3)))
    tie = (F.col("chars") == F.col("most")) & ((F.col("skills") > F.col("united")) | (F.col("skills") == F.col("united")) & (F.col("paid") + F.col("dated") > 0))
    able = seen.where((F.col("place") <= 2) | (F.col("chars") > F.col("most")) | tie | F.col("first_salary") | F.col("first_deadline"))
    # of copies that are alike in all that is compared, only the first can change anything
    fields = ["at", "chars", "skills", "paid", "dated", "united", "salary", "deadline"]
    alike = able.groupBy("dedupe_hash", "early", "chars", "skills", "paid", "dated", "united", "first_salary", "first_deadline").agg(F.min(F.struct("at", "salary", "deadline")).alias("f"))
    events = alike.select("dedupe_hash", F.struct("f.at", *fields[1:6], "f.salary", "f.deadline").alias("e")).groupBy("dedupe_hash").agg(F.array_sort(F.collect_list("e")).alias("events"))

    def step(acc: Column, j: Column) -> Column:
        richer = F.struct(j["chars"], j["skills"], j["paid"], j["dated"]) > F.struct(acc["chars"], j["united"], acc["paid"], acc["dated"])
        pick = {c: F.when(richer, j[c]).otherwise(acc[c]) for c in fields}
        for c, mark in (("salary", "paid"), ("deadline", "dated")):
            own = F.when(richer, j[c].isNotNull()).otherwise(acc[c].isNull())
            pick[c] = F.when(own, j[c]).otherwise(acc[c])
            if filled:
                pick[mark] = F.when(own, j[mark]).otherwise(acc[mark])
        return F.struct(*[pick[c].alias(c) for c in fields])

    shown = events.select("dedupe_hash", F.aggregate(F.slice("events", 2, 1 << 30), F.element_at("events", 1), step).alias("j"))
    shown = shown.select("dedupe_hash", F.col("j.at").alias("at"), F.col("j.salary").alias("j_salary"), F.col("j.deadline").alias("j_deadline"))
    places = rows.groupBy("dedupe_hash", F.coalesce("source_url", F.lit("")).alias("url")).agg(F.min(F.struct("at", F.coalesce("source_platform", F.lit("")).alias("platform"))).alias("f"), F.count("*").alias("n"))
    sources = places.groupBy("dedupe_hash").agg(F.array_sort(F.collect_list(F.struct("f.at", "f.platform", "url"))).alias("all"), F.sum("n").alias("n"))
    sources = sources.select("dedupe_hash", "n", F.transform("all", lambda s: F.struct(s["platform"].alias("platform"), s["url"].alias("url"))).alias("sources"))
    out = rows.select("dedupe_hash", "at", *cols).join(shown, ["dedupe_hash", "at"]).dropDuplicates(["dedupe_hash"]).join(sources, "dedupe_hash")
    out = out.join(united(required, "all_required"), "dedupe_hash", "left").join(united(firsts("preferred_skills"), "all_preferred"), "dedupe_hash", "left")
    many, all_required = F.col("n") > 1, F.coalesce("all_required", none)
    value = {c: F.col(c) for c in cols} | {
        "salary": F.col("j_salary"), "deadline": F.col("j_deadline"), "required_skills": F.when(many, all_required).otherwise(F.col("required_skills")),
        "preferred_skills": F.when(many, X.without(F.coalesce("all_preferred", none), all_required)).otherwise(F.col("preferred_skills")),
    }
    return out.select("dedupe_hash", F.col("at.seq").alias("seq"), *[value[c].alias(c) for c in cols], "sources")


def duplicate_count(postings: DataFrame) -> DataFrame:
    """How many sources ``merge_duplicates`` would unite with others, from the distinct addresses alone."""
    urls = postings.where("dedupe_hash IS NOT NULL AND dedupe_hash <> ''").groupBy("dedupe_hash").agg((F.countDistinct(F.coalesce("source_url", F.lit(""))) - 1).alias("more"))
    return urls.agg(F.coalesce(F.sum("more"), F.lit(0)).alias("duplicates"))


def validate(raw: DataFrame, now: Column) -> DataFrame:
    """Each row coerced to a posting, with ``reason`` where it must be rejected (else null)."""
    title = F.substring(X.clean_text(F.col("title")), 1, TITLE_CHARS)
    url, platform = X.clean_text(F.col("source_url")), F.lower(X.clean_text(F.col("source_platform")))
    reason = F.when(title == "", "missing title").when(url == "", "missing sourceUrl").when(~url.rlike("(?i)^https?://"), "sourceUrl must be http(s)").when(platform == "", "missing sourcePlatform")
    body = X.strip(X.unix_lines(F.col("description")))
    company = F.coalesce(X.blank_to_null(F.substring(X.clean_text(F.col("company")), 1, TITLE_CHARS)), F.lit("Not disclosed"))
    description = F.coalesce(X.blank_to_null(F.substring(body, 1, DESCRIPTION_CHARS)), title)
    required = F.slice(X.union_lists(F.col("required_skills")), 1, SKILLS)
    own = F.col("sources") if "sources" in raw.columns else F.array().cast(SOURCES)
    return raw.select(
        "seq", reason.alias("reason"), title.alias("title"), company.alias("company"), description.alias("description"), required.alias("required_skills"),
        F.slice(X.without(X.union_lists(F.col("preferred_skills")), required), 1, SKILLS).alias("preferred_skills"),
        C.pick_enum(F.col("experience_level"), C.EXPERIENCE_LEVELS, "unspecified").alias("experience_level"),
        C.pick_enum(F.col("education_requirement"), C.EDUCATION_LEVELS, "unspecified").alias("education_requirement"),
        C.pick_enum(F.col("job_type"), C.JOB_TYPES, "full-time").alias("job_type"),
        F.coalesce(X.blank_to_null(F.substring(X.clean_text(F.col("location")), 1, LOCATION_CHARS)), F.lit("Nepal")).alias("location"),
        X.blank_to_null(X.clean_text(F.col("salary"))).alias("salary"), lenient_date(F.col("deadline")).alias("deadline"),
        F.coalesce(lenient_date(F.col("posted_date")), now).alias("posted_date"), platform.alias("source_platform"), url.alias("source_url"),
        X.clean_apply_url(F.col("apply_url"), url).alias("apply_url"), X.dedupe_hash(title, company, description).alias("dedupe_hash"),
        X.all_sources(platform, url, own).alias("sources"),
    )


def first_where(value: str, condition: Column, order: Column) -> Column:
    """The value of the earliest row that meets the condition, else null."""
    return F.min_by(value, F.when(condition, order))


def fold_batch(rows: DataFrame) -> DataFrame:
    """One row for each hash by aggregates alone; ``copies`` counts the rows.

    The earliest row gives the base. Title and description come from the earliest
    of the longest descriptions; gaps are filled by the earliest row that has a
    value; dates take the minimum. Lists are united in the order of ``seq``: the
    distinct values of a group are found by a second aggregation on (hash, value),
    so that a large group of copies does not gather its lists in one row.
    """
    order = F.col("seq")
    length = F.struct(F.length("description").alias("n"), (-order).alias("o"))
    base = rows.groupBy("dedupe_hash").agg(
        F.count("*").alias("copies"), F.min("seq").alias("seq"), F.max_by(F.struct("title", "description"), length).alias("rich"),
        *[F.min_by(c, order).alias(c) for c in ("company", "job_type", "source_platform", "source_url")],
        F.coalesce(first_where("experience_level", F.col("experience_level") != "unspecified", order), F.lit("unspecified")).alias("experience_level"),
        F.coalesce(first_where("education_requirement", F.col("education_requirement") != "unspecified", order), F.lit("unspecified")).alias("education_requirement"),
        F.coalesce(first_where("location", F.col("location") != "Nepal", order), F.lit("Nepal")).alias("location"),
        *[first_where(c, F.col(c).isNotNull(), order).alias(c) for c in ("salary", "apply_url", "deadline")],
        F.min("posted_date").alias("posted_date"),
    )

    def united(values: str, key: Column, name: str) -> DataFrame:
        items = rows.select("dedupe_hash", "seq", F.posexplode(values).alias("pos", "v"))
        firsts = items.groupBy("dedupe_hash", key.alias("k")).agg(F.min(F.struct("seq", "pos", "v")).alias("f"))
        return firsts.groupBy("dedupe_hash").agg(F.transform(F.array_sort(F.collect_list("f")), lambda f: f["v"]).alias(name))

    none = F.array().cast("array<string>")
    out = base.join(united("required_skills", F.lower("v"), "required_skills"), "dedupe_hash", "left")
    out = out.join(united("preferred_skills", F.lower("v"), "preferred_skills"), "dedupe_hash", "left")
    out = out.join(united("sources", F.col("v.url"), "sources"), "dedupe_hash", "left")
    out = out.withColumn("required_skills", F.slice(F.coalesce("required_skills", none), 1, SKILLS))
    out = out.withColumn("preferred_skills", F.slice(X.without(F.coalesce("preferred_skills", none), F.col("required_skills")), 1, SKILLS))
    return out.select(
        "seq", "rich.title", "company", "rich.description", "required_skills", "preferred_skills", "experience_level", "education_requirement", "job_type", "location",
        "salary", "deadline", "posted_date", "source_platform", "source_url", "apply_url", "dedupe_hash", F.coalesce("sources", F.array().cast(SOURCES)).alias("sources"), "copies",
    )


def upsert(store: DataFrame, folded: DataFrame, now: Column) -> DataFrame:
    """The next state of the store, tagged: ``op`` is insert, update or keep; ``grew`` if an update brought a source.

    ``store`` has the columns of ``STORED``, ``folded`` those of ``fold_batch``. A
    stored row counts as earlier than any batch.
    """
    s, b = store.alias("s"), folded.alias("b")
    old, new = F.col("s.dedupe_hash").isNotNull(), F.col("b.dedupe_hash").isNotNull()
    both = old & new
    joined = s.join(b, F.col("s.dedupe_hash") == F.col("b.dedupe_hash"), "full_outer")
    longer = both & (F.length("b.description") > F.length("s.description"))
    required = F.slice(X.union_lists(F.col("s.required_skills"), F.col("b.required_skills")), 1, SKILLS)
    preferred = F.slice(X.without(X.union_lists(F.col("s.preferred_skills"), F.col("b.preferred_skills")), required), 1, SKILLS)
    none = F.array().cast(SOURCES)
    sources = X.union_sources(F.concat(F.coalesce("s.sources", none), F.coalesce("b.sources", none)))

    def kept(c: str) -> Column:
        return F.when(old, F.col(f"s.{c}")).otherwise(F.col(f"b.{c}")).alias(c)

    def known(c: str, blank: str) -> Column:
        return F.coalesce(F.nullif(F.col(f"s.{c}"), F.lit(blank)), F.col(f"b.{c}"), F.lit(blank)).alias(c)

    def gap(c: str) -> Column:
        return F.coalesce(f"s.{c}", f"b.{c}").alias(c)

    return joined.select(
        kept("seq"), F.when(longer | ~old, F.col("b.title")).otherwise(F.col("s.title")).alias("title"), kept("company"),
        F.when(longer | ~old, F.col("b.description")).otherwise(F.col("s.description")).alias("description"),
        required.alias("required_skills"), preferred.alias("preferred_skills"), known("experience_level", "unspecified"), known("education_requirement", "unspecified"),
        kept("job_type"), known("location", "Nepal"), gap("salary"), gap("deadline"), F.least("s.posted_date", "b.posted_date").alias("posted_date"),
        kept("source_platform"), kept("source_url"), gap("apply_url"), gap("dedupe_hash"), sources.alias("sources"),
        F.when(new, now).otherwise(F.col("s.last_seen_at")).alias("last_seen_at"),
        F.when(both, "update").when(new, "insert").otherwise("keep").alias("op"), (both & (F.size(sources) > F.size("s.sources"))).alias("grew"),
        (both & ~(
            F.struct("s.title", "s.description", "s.required_skills", "s.preferred_skills", "s.experience_level", "s.education_requirement", "s.location", "s.salary", "s.deadline", "s.posted_date", "s.apply_url", "s.sources")
            .eqNullSafe(F.struct(
                F.when(longer, F.col("b.title")).otherwise(F.col("s.title")), F.when(longer, F.col("b.description")).otherwise(F.col("s.description")), required, preferred,
                known("experience_level", "unspecified"), known("education_requirement", "unspecified"), known("location", "Nepal"), gap("salary"), gap("deadline"),
                F.least("s.posted_date", "b.posted_date"), gap("apply_url"), sources,
            ).cast("struct<title:string,description:string,required_skills:array<string>,preferred_skills:array<string>,experience_level:string,education_requirement:string,location:string,salary:string,deadline:timestamp,posted_date:timestamp,apply_url:string,sources:array<struct<platform:string,url:string>>>"))
        )).alias("changed"),
    )


def counters(validated: DataFrame, tagged: DataFrame) -> DataFrame:
    """One row of counts of an ingested batch; ``errors`` holds the reasons of the first 20 rejected rows."""
    rows = validated.agg(
        F.count("*").alias("received"), F.count_if(F.col("reason").isNotNull()).alias("skipped"), F.count_if(F.col("reason").isNull()).alias("good")
    )
    first = validated.where("reason IS NOT NULL").select("seq", "reason").orderBy("seq", "reason").limit(20)
    errors = first.agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "reason"))), lambda r: r["reason"]).alias("errors"))
    ops = tagged.agg(
        F.count_if(F.col("op") == "insert").alias("inserted"), F.count_if(F.col("op") == "update").alias("updated"), F.count_if(F.col("grew")).alias("grew"), F.count_if(F.col("changed")).alias("changed")
    )
    one = rows.crossJoin(F.broadcast(ops)).crossJoin(F.broadcast(errors))  # one row each
    merged = F.col("good") - F.col("inserted") - F.col("updated") + F.col("grew")
    return one.select("received", "inserted", "updated", merged.alias("merged"), "skipped", "changed", "errors")


def in_batch(store: DataFrame, folded: DataFrame) -> DataFrame:
    """Stored rows whose hash the batch has."""
    return store.join(folded.select("dedupe_hash"), "dedupe_hash", "left_semi")


def apply_routes(postings: DataFrame, labels: dict[str, str] | None = None) -> DataFrame:
    """``apply`` (url, label, kind, platform) and ``extras``: the employer's link if there is one, else the first board."""
    boards = F.transform(
        X.all_sources(F.col("source_platform"), F.col("source_url"), F.col("sources")),
        lambda s: F.struct(s["url"].alias("url"), F.concat(F.lit("Apply on "), X.label_for(s["platform"], labels or {}, "Unknown source")).alias("label"), F.lit("board").alias("kind"), s["platform"].alias("platform")),
    )
    url = F.col("apply_url")
    label = F.when(url.rlike("(?i)^mailto:"), F.concat(F.lit("Email your application to "), X.link_host(url))).otherwise(F.concat(F.lit("Apply on "), X.link_host(url)))
    direct = F.when(url.isNotNull(), F.struct(url.alias("url"), label.alias("label"), F.lit("direct").alias("kind"), F.lit(None).cast("string").alias("platform")))
    rows = postings.withColumn("boards", boards)
    return rows.withColumn("apply", F.coalesce(direct, F.get("boards", F.lit(0)))).withColumn("extras", F.when(url.isNotNull(), F.col("boards")).otherwise(F.slice("boards", 2, 1 << 30))).drop("boards")
