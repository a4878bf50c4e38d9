"""Structured postings (JSON-LD) within landed pages, read as variants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vacantry.functions.classify import first_mapped
from vacantry.functions.text import blank_to_null, clean_text, find_apply_link, html_to_text, text
from vacantry.sources.postings import as_raw

BLOCK = r"(?is)<script[^>]*type=[\"']application/ld\+json[\"'][^>]*>(.*?)</script>"
#: Employment types of the vocabulary and what they mean here.
TYPES = {
    "full_time": "full-time", "fulltime": "full-time", "part_time": "part-time", "parttime": "part-time", "contractor": "contract", "contract": "contract",
    "temporary": "contract", "intern": "internship", "internship": "internship", "per_diem": "part-time",
}


def at(v: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, path, kind)


def items(v: Column) -> Column:
    """A variant as an array of variants: a list's items, or the value itself."""
    return F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.when(v.isNotNull(), F.array(v)))


def json_nodes(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """``id_col, block, path, node``: every JSON object of the pages' blocks; lists and graphs are opened, bad blocks skipped.

    Graphs are opened as deep as they stand in one another, level by level within the
    row: a graph is a list, so a block has no more levels than brackets. Pages are read once.
    """
    blocks = pages.select(id_col, F.posexplode(F.regexp_extract_all(text(F.col(html_col)), F.lit(BLOCK), F.lit(1))).alias("block", "json"))
    # a bad block is null and so opens to no rows; a filter on it would parse every block twice
    parsed = blocks.select(id_col, "block", F.try_parse_json(F.trim("json")).alias("v"), F.regexp_count("json", F.lit(r"\[")).alias("depth"))
    placed = lambda nodes, path: F.transform(nodes, lambda node, i: F.struct(F.concat(path, F.array(i)).alias("path"), node.alias("node")))
    graph = lambda node: F.try_variant_get(node, "$['@graph']", "array<variant>")

    def deeper(found: Column, _: Column) -> Column:
        graphs = F.filter(F.transform(found["level"], lambda n: placed(graph(n["node"]), n["path"])), lambda g: g.isNotNull())
        return F.when(F.size(found["level"]) == 0, found).otherwise(F.struct(F.flatten(graphs).alias("level"), F.concat(found["nodes"], found["level"]).alias("nodes")))

    top = placed(items(F.col("v")), F.array().cast("array<int>"))
    levels = F.when(F.col("depth") > 0, F.sequence(F.lit(1), F.col("depth"))).otherwise(F.array().cast("array<int>"))
    nodes = F.aggregate(levels, F.struct(top.alias("level"), F.slice(top, 1, 0).alias("nodes")), deeper, lambda found: F.concat(found["nodes"], found["level"]))
    out = parsed.select(id_col, "block", F.inline(nodes))
    return out.where(F.schema_of_variant("node").startswith("OBJECT"))


def job_postings(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """``id_col, node``: each page's first job posting, outer objects before those of their graphs."""
    nodes = json_nodes(pages, id_col, html_col)
    kinds = F.transform(items(F.try_variant_get("node", "$['@type']", "variant")), lambda t: F.lower(F.try_variant_get(t, "$", "string")))
    found = nodes.where(F.exists(kinds, lambda k: k == "jobposting"))
    first = Window.partitionBy(id_col).orderBy("block", F.size("path"), "path")
    return found.withColumn("n", F.row_number().over(first)).where("n = 1").select(id_col, "node")


def organization(v: Column) -> Column:
    """An object's name, the first of a list, or a text."""
    one = F.get(items(v), F.lit(0))
    return clean_text(F.coalesce(at(one, "$.name"), F.when(~F.schema_of_variant(one).startswith("OBJECT"), at(one, "$"))))


def employment_type(v: Column) -> Column:
    return F.coalesce(first_mapped(F.transform(items(v), lambda t: F.replace(at(t, "$"), F.lit("-"), F.lit("_"))), TYPES), F.lit(""))


def location(v: Column) -> Column:
    """The first three different places; of an address the town, else street, region or country."""

    def place(entry: Column) -> Column:
        address = at(entry, "$.address", "variant")
        fields = [at(address, f"$.{k}", "variant") for k in ("addressLocality", "streetAddress", "addressRegion", "addressCountry")]
        named = [blank_to_null(clean_text(F.coalesce(at(f, "$.name"), F.when(~F.schema_of_variant(f).startswith("OBJECT"), at(f, "$"))))) for f in fields]
        return F.coalesce(*named, F.when(~F.schema_of_variant(address).startswith("OBJECT"), blank_to_null(clean_text(at(address, "$")))))

    places = F.filter(F.transform(items(v), place), lambda p: p.isNotNull())
    return F.coalesce(F.array_join(F.slice(F.array_distinct(places), 1, 3), ", "), F.lit(""))


def salary(v: Column) -> Column:
    """A band, one amount, ``Negotiable`` or nothing."""
    currency = F.coalesce(blank_to_null(clean_text(at(v, "$.currency"))), blank_to_null(clean_text(at(v, "$.salaryCurrency"))), F.lit("NPR"))
    inner = at(v, "$.value", "variant")
    nested = F.schema_of_variant(inner).startswith("OBJECT")
    low = clean_text(F.coalesce(blank_to_null(at(inner, "$.minValue")), at(inner, "$.value")))
    high, unit = clean_text(at(inner, "$.maxValue")), clean_text(at(inner, "$.unitText"))
    band = F.when((low != "") & (high != "") & (low != high), F.concat(low, F.lit(" - "), high)).otherwise(F.coalesce(blank_to_null(low), high))
    amount = text(F.when(nested, band).otherwise(clean_text(at(inner, "$"))))
    written = F.concat_ws(" ", currency, amount, F.when(nested & (unit != ""), F.concat(F.lit("/ "), unit)))
    talk = F.lower(text(at(inner, "$"))) == "negotiable"
    return F.when(~F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False)), "").when(F.lower(amount).isin("", "0", "negotiable"), F.when(talk, "Negotiable").otherwise("")).otherwise(written)


def experience(v: Column) -> Column:
    """Whole years of a count of months, else a description."""
    years = F.floor(at(v, "$.monthsOfExperience").try_cast("double") / 12)
    told = clean_text(F.coalesce(blank_to_null(at(v, "$.description")), at(v, "$.experienceRequirements"), F.when(~F.schema_of_variant(v).startswith("OBJECT"), at(v, "$"))))
    return F.when(years >= 1, F.concat(years.cast("string"), F.lit("+ years"))).otherwise(told)


def education(v: Column) -> Column:
    one = lambda e: clean_text(F.coalesce(blank_to_null(at(e, "$.credentialCategory")), at(e, "$.name"), F.when(~F.schema_of_variant(e).startswith("OBJECT"), at(e, "$"))))
    return text(F.array_join(F.filter(F.transform(items(v), one), lambda e: e != ""), " "))


def skills(v: Column) -> Column:
    """A list's texts, or one text cut at commas and semicolons."""
    listed = F.try_variant_get(v, "$", "array<string>")
    parts = F.coalesce(listed, F.split(clean_text(at(v, "$")), "[;,]"))
    return F.filter(F.transform(F.coalesce(parts, F.array().cast("array<string>")), clean_text), lambda s: s != "")


def from_postings(nodes: DataFrame, url: Column, platform: str = "jsonld") -> DataFrame:
    """Raw postings of job posting nodes with a title; ``url`` is the page's address."""
    v = lambda k: at(F.col("node"), f"$.{k}", "variant")
    s = lambda k: at(F.col("node"), f"$.{k}")
    direct = F.trim(F.coalesce(blank_to_null(s("url")), s("applicationUrl")))
    return as_raw(
        nodes.where(clean_text(s("title")) != ""), platform, title=clean_text(s("title")), company=organization(v("hiringOrganization")), description=html_to_text(s("description")),
        requirements=html_to_text(F.coalesce(blank_to_null(s("responsibilities")), s("qualifications"))), required_skills=skills(v("skills")), experience_raw=experience(v("experienceRequirements")),
        education_raw=education(v("educationRequirements")), job_type=employment_type(v("employmentType")), job_type_raw=clean_text(s("employmentType")), location=location(v("jobLocation")),
        salary=salary(v("baseSalary")), deadline=s("validThrough"), posted_date=s("datePosted"), source_url=url,
        apply_url=F.when(direct.startswith("http") | direct.startswith("mailto:"), direct).otherwise(find_apply_link(s("applicationContact"), s("description"))),
    )
