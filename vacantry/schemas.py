"""Column types of the tables that operators exchange."""

SOURCES = "array<struct<platform:string,url:string>>"

#: A raw posting as sources map it: every column may be null.
RAW_POSTING = (
    "title string, company string, description string, requirements string, required_skills array<string>, preferred_skills array<string>, "
    "job_type string, job_type_raw string, experience_level string, experience_raw string, education_requirement string, education_raw string, "
    "location string, salary string, deadline string, posted_date string, source_platform string, source_url string, apply_url string"
)

#: A canonical posting; ``seq`` is the order of arrival.
POSTING = (
    "seq long, title string, company string, description string, required_skills array<string>, preferred_skills array<string>, "
    "experience_level string, education_requirement string, job_type string, location string, salary string, deadline timestamp, "
    "posted_date timestamp, source_platform string, source_url string, apply_url string, dedupe_hash string, sources " + SOURCES
)

#: A row of the store.
STORED = POSTING + ", last_seen_at timestamp"

#: One ingested batch; ``parts`` are those of the store that it wrote anew.
CHANGE = "batch_id long, at timestamp, received long, inserted long, updated long, merged long, skipped long, changed long, errors array<string>, parts array<int>"


def names(schema: str) -> list[str]:
    """The column names of one of the schemas above."""
    from pyspark.sql.types import StructType

    return StructType.fromDDL(schema).fieldNames()
