"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document gets the exponential key ``-ln(u) / quality``, where ``u``
follows from its id, so reruns agree. A source's target is reached by whole
epochs first; what remains is taken in order of the keys until the running sum
of sizes reaches it. The running sums are made in two levels: sums over slots
that part a source's keys about evenly, then within each slot, so no task ever
holds the documents of a source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import as_rows, row_key, table, text_digest, written

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS, MAX_EPOCHS = (5, 2, 1), 3
#: Rows that a slot of a source's key range holds on average, and bands of quality in an octave.
SLOT_ROWS, BANDS = 4096, 16
#: Up to so many sources (one row each) the targets are broadcast, which spares hot sources a shuffle.
BROADCAST_SOURCES = 50_000


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality(text: Column) -> Column:
    """From 0.25 to 1: higher for a larger share of letters, of any script; empty texts have 0.25."""
    share = F.length(F.regexp_replace(text, r"\P{L}+", "")) / F.nullif(F.length(text), F.lit(0))
    return F.least(F.lit(1.0), F.lit(0.25) + F.coalesce(share, F.lit(0.0)) * 0.75)


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``source, source_size, n, target`` from ``source, source_size, n``.

    Sources by code point, null last, take the weights in turn and share the
    sum of all sizes. Filling up in order of size over weight finds the level
    at which each target is the smaller of weight times level and the cap, so
    one pass over the (few) sources replaces repeated sharing.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), (F.col("place") % len(weights) + 1).cast("int"))
    ranked = sizes.withColumn("place", place).withColumn("weight", weight)
    ranked = ranked.withColumn("fill", F.lit(float(max_epochs)) * F.col("source_size") / F.col("weight"))
    before = Window.orderBy("fill", "place").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.orderBy("fill", "place").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = ranked.withColumn("total", F.sum("source_size").over(everything)).withColumn(
        "level", (F.col("total") - max_epochs * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / F.sum("weight").over(after)
    )
    # the first source that need not be capped fixes the level for all behind it
    level = F.min(F.when(F.col("fill") >= F.col("level"), F.struct("fill", "place", "level"))).over(everything)["level"]
    target = F.least(max_epochs * F.col("source_size").cast("double"), F.col("weight") * F.coalesce(level, F.lit(float("inf"))))
    return ranked.select("source", "source_size", "n", target.alias("target"))


def spread(rows: DataFrame) -> DataFrame:
    """``group, kinds``: the mean quality and the share of rows of each band of qualities of a source.

    With them the share of a source's keys below a given key is known closely, whatever the qualities.
    """
    band = F.floor(F.log2("quality") * BANDS).alias("band")
    bands = rows.groupBy("group", band).agg(F.avg("quality").alias("q"), F.count("*").alias("c"))
    listed = F.sort_array(F.collect_list(F.struct("q", "c")))
    total = F.aggregate("kinds", F.lit(0).cast("long"), lambda s, k: s + k["c"])
    return bands.groupBy("group").agg(listed.alias("kinds")).select("group", F.transform("kinds", lambda k: F.struct(k["q"].alias("q"), (k["c"] / total).alias("w"))).alias("kinds"))


def below(order: str) -> Column:
    """About the share of a source's keys below the key ``order``, with the source's ``kinds``."""
    return F.aggregate("kinds", F.lit(0.0), lambda s, k: s + k["w"] * (1 - F.exp(-k["q"] * F.col(order))))


def mix(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, carry: list[str] | None = None) -> DataFrame:
    """Take each source up to its target.

    ``sized`` has ``doc_id``, ``source``, ``size`` (0 at least) and ``quality``
    (above 0); other columns but those of ``carry`` are ignored. Returns a row for each input row:
    ``doc_id, size, source_size, target, copies, taken`` and the columns of ``carry``. A document is taken
    whole: once in each whole epoch, and once more if, in order of the keys, the
    part epoch comes closer to the target with it. Null sources are one source.
    Rows of size 0 are taken 0 words but keep their number of copies. Ties of
    the key go by ``doc_id`` and ``size``; rows repeated in all columns can
    stand in either order.
    """
    carry = carry or []
    sized = written(sized.select("doc_id", "source", "size", "quality", *carry), "sized")
    u = (F.conv(F.substring(F.sha2(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), 256), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)
    # equal sources meet under one name without nulls; a null's name differs from all others'
    group = F.when(F.col("source").isNull(), "n").otherwise(F.concat(F.lit("s"), "source")).alias("group")
    carried = F.struct(F.lit(None).cast("int").alias("_"), *carry).alias("carried")
    rows = sized.select("doc_id", "size", group, (-F.ln(u) / F.col("quality")).alias("order"), carried)
    kinds = spread(sized.select(group, "quality"))
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    goal = targets(sizes, weights, max_epochs).select(
        F.when(F.col("source").isNull(), "n").otherwise(F.concat(F.lit("s"), "source")).alias("group"), "source_size", "target", "n"
    )
    goal = goal.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    goal = goal.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    goal = written(goal.join(kinds, "group"), "targets")
    if goal.count() <= BROADCAST_SOURCES:
        goal = F.broadcast(goal)
    # the slots of the keys' range: about the share of the source's keys below the key, which rises with it
    slots = F.greatest(F.lit(1), F.ceil(F.col("n") / SLOT_ROWS))
    rows = rows.join(goal, "group").withColumn("slot", F.least(F.floor(below("order") * slots), slots - 1).cast("long")).drop("kinds")
    sums = rows.groupBy("group", "slot").agg(F.sum("size").alias("in_slot"))
    base = sums.select("group", "slot", (F.sum("in_slot").over(Window.partitionBy("group").orderBy("slot")) - F.col("in_slot")).alias("base"))
    order = Window.partitionBy("group", "slot").orderBy("order", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = rows.join(base, ["group", "slot"]).withColumn("upto", F.col("base") + F.sum("size").over(order))
    extra = (F.col("upto") - F.col("size") / 2 < F.col("rest")).cast("long")
    copies = F.least(F.lit(max_epochs), F.col("epochs") + extra)
    taken = (F.col("size") * F.col("copies")).alias("taken")
    return upto.withColumn("copies", copies).select("doc_id", "size", "source_size", "target", "copies", taken, *(f"carried.{c}" for c in carry))


def sized(docs: DataFrame, *keys: Column) -> DataFrame:
    """What ``mix`` needs of documents; a key, if given, is named ``key``."""
    return docs.select("doc_id", "source", words(F.col("text")).alias("size"), quality(F.col("text")).alias("quality"), *(k.alias("key") for k in keys))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(sized(table(spark, sf_dir, "documents")))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document stands in the mix as many times as it was taken.

    Rows are told apart by id, source and text; rows repeated with all three stand
    as often as the most taken of them. Columns of any name pass through.
    """
    name = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))
    key = F.concat(row_key(F.col("doc_id"), text_digest(F.col("text"))), F.lit(":"), name)
    counts = mix(sized(docs, key), carry=["key"]).groupBy("key").agg(F.max("copies").alias("copies")).where("copies > 0")
    many = as_rows(docs, key).join(counts, "key")
    return many.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")


SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         -ln((('0x' || substr(sha256(coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT + 0.5::DOUBLE) / 281474976710656.0::DOUBLE)
         / least(1.0::DOUBLE, 0.25::DOUBLE + coalesce(length(regexp_replace(text, '\P{L}+', '', 'g'))::DOUBLE / nullif(length(text), 0), 0.0::DOUBLE) * 0.75::DOUBLE) AS key
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM d GROUP BY source
), w AS (
  SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][place % 3 + 1] AS weight, 3.0::DOUBLE * source_size / weight AS fill FROM s
), l AS (
  SELECT *, ((sum(source_size) OVER ()) - 3 * coalesce(sum(source_size) OVER (ORDER BY fill, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
            / (sum(weight) OVER (ORDER BY fill, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS level FROM w
), t AS (
  SELECT source, source_size, least(3.0::DOUBLE * source_size, weight * coalesce((SELECT arg_min(level, (fill, place)) FROM l WHERE fill >= level), 'infinity'::DOUBLE)) AS target FROM l
), k AS (
  SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs,
         sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, size * least(3, epochs + (upto - size / 2.0::DOUBLE < target - epochs * source_size)::BIGINT) AS taken FROM k
"""
