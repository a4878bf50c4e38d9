"""Helpers that several corpus operators share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vacantry.shared import shared_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it again.

    This cuts the lineage with files that survive the loss of an executor.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def signed(value: int) -> int:
    """An unsigned 64-bit number as Spark's long holds it."""
    return value - (1 << 64) if value >= 1 << 63 else value


def row_key(id_: Column, digest: Column) -> Column:
    """One string for a document's id and the digest of its text; ``text_digest`` gives that."""
    return F.concat(F.coalesce(id_.cast("string"), F.lit("null")), F.lit(":"), digest)


def text_digest(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def as_rows(docs: DataFrame, key: Column) -> DataFrame:
    """``row, key``: whole rows in one column, so that names of other columns can't clash with those of the work."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), key.alias("key"))


def without(docs: DataFrame, key: Column, judged: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose key (by ``row_key``) stays.

    ``judged`` has ``key, kept`` for each row. Of kept rows that share id and text,
    one stays: the least by a hash of all its columns.
    """
    rows = as_rows(docs, key)
    out = rows.join(judged.where("NOT kept").select("key").distinct(), "key", "left_anti")
    again = judged.where("kept").groupBy("key").count().where("count > 1").select("key")
    if again.isEmpty():
        return out.select("row.*")
    one = out.join(again, "key", "left_semi").groupBy("key").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    return out.join(again, "key", "left_anti").select("row.*").unionByName(one.select("row.*"))


def connected_components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """Components of an undirected graph by alternating large and small stars.

    ``edges`` has two columns ``a`` and ``b`` of one orderable type. Returns
    ``node, root`` with the smallest node of the component as root, one row for
    each node that has an edge to another node. Every round is one distributed
    job whose result is written to the shared folder.
    """
    hi, lo = F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")
    stars = written(edges.where("a <> b").select(hi, lo).distinct(), "cc")
    seen = None
    for _ in range(max_rounds):
        both = stars.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(
            stars.select(F.col("lo").alias("u"), F.col("hi").alias("v"))
        )
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        moved = large.join(low, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        kept = low.select("hi", F.col("m").alias("lo"))
        stars = written(moved.unionByName(kept).distinct(), "cc")
        state = stars.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if state == seen:
            return stars.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
        seen = state
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
