"""The given tables as postings, CVs and events, for the registered queries.

The clock is fixed: ``NOW`` for postings made of orders, ``EVENTS_NOW`` for events.
Each view has a twin in SQL (``*_SQL``) that DuckDB runs on the same tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vacantry.functions import text as X

TYPES = {"1-URGENT": "internship", "2-HIGH": "full-time", "3-MEDIUM": "part-time", "4-NOT SPECIFIED": "contract", "5-LOW": "remote"}
LEVELS = {"F": "senior", "O": "entry", "P": "mid"}
DEGREES = {"AUTOMOBILE": "slc", "BUILDING": "diploma", "FURNITURE": "bachelor", "HOUSEHOLD": "master", "MACHINERY": "phd"}


def now() -> Column:
    return F.expr("TIMESTAMP '2000-01-01 00:00:00'")


def events_now() -> Column:
    return F.expr("TIMESTAMP '2024-01-30 00:00:00'")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def choose(c: Column, table_: dict[str, str]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table_.items() for x in kv]), c)


def case_sql(column: str, table_: dict[str, str]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table_.items()) + " END"


def document_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as validated postings: copies on different sources share a hash; the date follows from the id."""
    d = table(spark, sf_dir, "documents")
    title = F.substring(F.substring_index(F.coalesce("text", F.lit("")), "\n", 1), 1, 300)
    none = F.array().cast("array<string>")
    url = F.concat(F.lit("https://"), "source", F.lit(".example.com/"), F.col("doc_id").cast("string"))
    return d.select(
        F.col("doc_id").alias("seq"), title.alias("title"), F.col("lang").alias("company"), F.coalesce("text", F.lit("")).alias("description"), none.alias("required_skills"), none.alias("preferred_skills"),
        F.when(F.col("doc_id") % 5 == 0, "unspecified").otherwise(F.when(F.col("doc_id") % 2 == 0, "mid").otherwise("senior")).alias("experience_level"), F.lit("unspecified").alias("education_requirement"),
        F.lit("full-time").alias("job_type"), F.when(F.col("doc_id") % 3 == 0, "Nepal").otherwise(F.concat(F.lit("Town "), (F.col("doc_id") % 7).cast("string"))).alias("location"),
        F.when(F.col("doc_id") % 4 == 0, F.col("n_chars").cast("string")).alias("salary"), F.lit(None).cast("timestamp").alias("deadline"),
        F.timestamp_seconds(F.lit(946684800) - F.col("doc_id") * 3600).alias("posted_date"), F.col("source").alias("source_platform"), url.alias("source_url"), F.lit(None).cast("string").alias("apply_url"),
        X.dedupe_hash(title, F.col("lang"), F.col("text")).alias("dedupe_hash"), F.array(F.struct(F.col("source").alias("platform"), url.alias("url"))).alias("sources"),
    )


DOCUMENT_POSTINGS_SQL = r"""
doc_postings AS (
  SELECT doc_id AS seq, substr(split_part(coalesce(text, ''), chr(10), 1), 1, 300) AS title, lang AS company, coalesce(text, '') AS description,
         CASE WHEN doc_id % 5 = 0 THEN 'unspecified' WHEN doc_id % 2 = 0 THEN 'mid' ELSE 'senior' END AS experience_level,
         CASE WHEN doc_id % 3 = 0 THEN 'Nepal' ELSE 'Town ' || (doc_id % 7) END AS location, CASE WHEN doc_id % 4 = 0 THEN n_chars::VARCHAR END AS salary,
         TIMESTAMP '2000-01-01 00:00:00' - to_hours(doc_id) AS posted_date, source AS source_platform, 'https://' || source || '.example.com/' || doc_id AS source_url,
         sha256(concat_ws('|', trim(regexp_replace(lower(substr(split_part(coalesce(text, ''), chr(10), 1), 1, 300)), '[^a-z0-9]+', ' ', 'g')),
                               trim(regexp_replace(lower(lang), '[^a-z0-9]+', ' ', 'g')),
                               substr(trim(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]+', ' ', 'g')), 1, 100))) AS dedupe_hash
  FROM documents
)"""


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as postings: their parts are the skills, returned ones only preferred; the latest shipment is the deadline."""
    orders, customer, nation = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_returnflag", "l_shipdate")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    named = lines.join(parts, lines["l_partkey"] == parts["p_partkey"], "left")
    # one aggregation makes both lists: a part is preferred if it is only ever returned
    skills = named.groupBy("l_orderkey").agg(
        F.sort_array(F.collect_set(F.when(F.col("l_returnflag") != "R", F.col("p_name")))).alias("required_skills"),
        F.sort_array(F.collect_set(F.when(F.col("l_returnflag") == "R", F.col("p_name")))).alias("returned"), F.max("l_shipdate").alias("last"),
    )
    none = F.array().cast("array<string>")
    rows = orders.join(customer, orders["o_custkey"] == customer["c_custkey"], "left").join(nation, F.col("c_nationkey") == nation["n_nationkey"], "left").join(skills, orders["o_orderkey"] == skills["l_orderkey"], "left")
    required = F.coalesce("required_skills", none)
    platform = F.concat(F.lit("board"), (F.col("o_custkey") % 6).cast("string"))
    url = F.concat(F.lit("https://"), platform, F.lit(".example.com/"), F.col("o_orderkey").cast("string"))
    return rows.select(
        F.col("o_orderkey").alias("seq"), F.concat(F.lit("Order "), F.col("o_orderkey").cast("string"), F.lit(" "), "o_orderpriority").alias("title"), F.col("c_name").alias("company"), F.col("o_orderpriority").alias("description"),
        required.alias("required_skills"), F.array_except(F.coalesce("returned", none), required).alias("preferred_skills"), choose(F.col("o_orderstatus"), LEVELS).alias("experience_level"),
        choose(F.element_at(F.array(*map(F.lit, DEGREES)), (F.col("o_orderkey") % 5 + 1).cast("int")), DEGREES).alias("education_requirement"), choose(F.col("o_orderpriority"), TYPES).alias("job_type"),
        F.col("n_name").alias("location"), F.col("o_totalprice").cast("string").alias("salary"), F.when(F.col("o_orderkey") % 7 != 0, F.col("last")).cast("timestamp").alias("deadline"),
        F.col("o_orderdate").cast("timestamp").alias("posted_date"), platform.alias("source_platform"), url.alias("source_url"), F.lit(None).cast("string").alias("apply_url"),
        F.col("o_orderkey").cast("string").alias("dedupe_hash"), F.array(F.struct(platform.alias("platform"), url.alias("url"))).alias("sources"),
    )


POSTINGS_SQL = rf"""
line_skills AS (
  SELECT l_orderkey, list_sort(coalesce(list(DISTINCT p_name) FILTER (l_returnflag <> 'R'), [])) AS required_skills,
         coalesce(list(DISTINCT p_name) FILTER (l_returnflag = 'R'), []) AS returned, max(l_shipdate) AS last
  FROM lineitem LEFT JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey
), postings AS (
  SELECT o_orderkey AS seq, 'Order ' || o_orderkey || ' ' || o_orderpriority AS title, c_name AS company, o_orderpriority AS description,
         coalesce(required_skills, []) AS required_skills, list_filter(coalesce(returned, []), lambda x: NOT list_contains(coalesce(required_skills, []), x)) AS preferred_skills,
         {case_sql("o_orderstatus", LEVELS)} AS experience_level, ['{"', '".join(DEGREES.values())}'][o_orderkey % 5 + 1] AS education_requirement, {case_sql("o_orderpriority", TYPES)} AS job_type, n_name AS location,
         CASE WHEN o_orderkey % 7 <> 0 THEN last END::TIMESTAMP AS deadline, o_orderdate::TIMESTAMP AS posted_date, 'board' || (o_custkey % 6) AS source_platform, o_orderkey::VARCHAR AS dedupe_hash
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN line_skills ON l_orderkey = o_orderkey
)"""


def cvs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as CVs: their skills are the parts they bought."""
    orders, customer = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), table(spark, sf_dir, "customer")
    lines, parts = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey"), table(spark, sf_dir, "part").select("p_partkey", "p_name")
    bought = lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"]).join(parts, lines["l_partkey"] == parts["p_partkey"])
    skills = bought.groupBy("o_custkey").agg(F.sort_array(F.collect_set("p_name")).alias("skills"))
    rows = customer.join(skills, customer["c_custkey"] == skills["o_custkey"], "left")
    return rows.select(
        F.col("c_custkey").alias("cv_id"), F.coalesce("skills", F.array().cast("array<string>")).alias("skills"), (F.floor(F.abs("c_acctbal")) % 120).cast("int").alias("total_experience_months"),
        choose(F.col("c_mktsegment"), DEGREES).alias("highest_education"),
    )


CVS_SQL = rf"""
cvs AS (
  SELECT c_custkey AS cv_id, skills, (floor(abs(c_acctbal))::INT % 120) AS months, {case_sql("c_mktsegment", DEGREES)} AS highest_education
  FROM customer LEFT JOIN (
    SELECT o_custkey, list(DISTINCT p_name) AS skills FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY o_custkey
  ) ON c_custkey = o_custkey
)"""
