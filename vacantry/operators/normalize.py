"""Raw postings of any source as canonical postings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantry.functions import classify as C
from vacantry.functions import dates as D
from vacantry.functions import text as X
from vacantry.operators.skills import required_and_preferred

NOT_DISCLOSED, HOME = "Not disclosed", "Nepal"
#: Fixed value: skills of a posting at most.
MOST_SKILLS = 40


def normalize_postings(raw: DataFrame, aliases: DataFrame, now: Column, key: str = "seq") -> DataFrame:
    """One canonical posting for each raw posting with a title and an address.

    ``raw`` has the columns of ``RAW_POSTING`` and a unique ``key``. Listed skills
    are kept; without a list, skills are read from the text. Known enumeration
    values are kept, others are detected. A missing posting date is ``now``.
    """
    rows = raw.withColumn("title", X.clean_text(F.col("title"))).withColumn("source_url", X.clean_text(F.col("source_url")))
    rows = rows.where("title <> '' AND source_url <> ''")
    body = X.tidy_description(X.clean_block(F.col("description")))
    rows = rows.withColumn("description", F.coalesce(X.blank_to_null(body), F.col("title")))
    rows = rows.withColumn("corpus", F.concat_ws(" ", "description", X.clean_text(F.col("requirements")), "title"))
    found = required_and_preferred(rows.select(key, "corpus"), aliases, key, "corpus")
    rows = rows.join(found, key)

    def listed(given: str, detected: str) -> Column:
        return X.distinct_list(F.when(F.size(F.coalesce(F.col(given), F.array().cast("array<string>"))) > 0, F.col(given)).otherwise(F.col(detected)), MOST_SKILLS)

    rows = rows.withColumn("required_skills", listed("required_skills", "required"))
    rows = rows.withColumn("preferred_skills", X.without(listed("preferred_skills", "preferred"), F.col("required_skills")))
    title, description = F.col("title"), F.col("description")
    company = F.coalesce(X.blank_to_null(X.clean_text(F.col("company"))), F.lit(NOT_DISCLOSED))
    return rows.select(
        key, "title", company.alias("company"), "description", "required_skills", "preferred_skills",
        C.pick_enum(F.col("experience_level"), C.EXPERIENCE_LEVELS, C.experience_level(title, description, X.clean_text(F.col("experience_raw")))).alias("experience_level"),
        C.pick_enum(F.col("education_requirement"), C.EDUCATION_LEVELS[:-1], C.education_level(description, X.clean_text(F.col("education_raw")))).alias("education_requirement"),
        C.pick_enum(F.col("job_type"), C.JOB_TYPES, C.job_type(title, description, X.clean_text(F.col("job_type_raw")))).alias("job_type"),
        F.coalesce(X.blank_to_null(X.clean_text(F.col("location"))), F.lit(HOME)).alias("location"),
        X.blank_to_null(X.clean_text(F.col("salary"))).alias("salary"),
        D.parse_date(F.col("deadline")).alias("deadline"),
        F.coalesce(D.parse_date(F.col("posted_date")), now).alias("posted_date"),
        "source_platform", "source_url", X.clean_apply_url(F.col("apply_url"), F.col("source_url")).alias("apply_url"),
        X.dedupe_hash(title, company, description).alias("dedupe_hash"),
    )
