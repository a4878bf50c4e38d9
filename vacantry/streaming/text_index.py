"""The inverted index of a posting store: which postings have a term, and how often in which field.

Every run of the store has an index of its own, made once: rows of ``term``, a number
for the posting and a count for each field, where terms are stems, and beside them
the hash of each number. A batch's index is one sorted file, that of a merged run is
divided into buckets by term. A search reads the buckets of its terms alone (the
partitions and the term filter reach the scan), drops what a newer run has another
state of, and meets the postings only by the hashes that it found.

Words are counted within their posting and stemmed once each; entries are shuffled
once, into their buckets, with numbers of eight bytes in place of hashes.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantry.functions.stem import stem
from vacantry.operators import search as Q
from vacantry.operators.skills import small
from vacantry.schemas import names
from vacantry.shared import materialised
from vacantry.streaming.store import PostingStore, Run

ENTRY = "term string, dedupe_hash string, title int, company int, required_skills int, description int"
#: An entry as it is kept, and the hash of each number.
KEPT, NUMBERED = "term string, doc long, title int, company int, required_skills int, description int", "doc long, dedupe_hash string"


def number(seed: int) -> Column:
    return F.xxhash64("dedupe_hash", F.lit(seed))


def counted(postings: DataFrame, doc: Column) -> DataFrame:
    """``doc, field, word, n``: the words of each field, counted in their row by the runs of the sorted list."""
    fields = F.array(*[F.struct(F.lit(name).alias("field"), F.array_sort(Q.tokens(Q.field_text(name))).alias("words")) for name in Q.WEIGHTS])
    lists = postings.select(doc.alias("doc"), F.explode(fields).alias("f")).select("doc", "f.field", "f.words").where(F.size("words") > 0)
    starts = F.filter(F.sequence(F.lit(1), F.size("words")), lambda i: (i == 1) | (F.element_at("words", i) != F.get("words", i - 2)))
    lists = lists.withColumn("starts", starts)
    runs = F.transform("starts", lambda i, k: F.struct(F.element_at("words", i).alias("word"), (F.coalesce(F.get("starts", k + 1), F.size("words") + 1) - i).alias("n")))
    return lists.select("doc", "field", F.inline(runs))


def entries(postings: DataFrame, bucket, seed: int = 0) -> DataFrame:
    """``bucket`` and KEPT of postings, dealt out by bucket."""
    words = counted(postings, number(seed))
    stems = materialised(words.select("word").distinct().withColumn("term", stem(F.col("word"))), "stems")
    rows = words.join(small(stems), "word").select(bucket(F.col("term")).alias("bucket"), "term", "doc", "field", "n").repartition("bucket")
    return rows.groupBy("bucket", "term", "doc").agg(*[F.sum(F.when(F.col("field") == name, F.col("n")).otherwise(0)).cast("int").alias(name) for name in Q.WEIGHTS])


class TextIndex:
    """The index of a store, under ``<store>/terms`` and ``<store>/numbers``; it keeps the number of buckets it began with."""

    def __init__(self, store: PostingStore, buckets: int = 64):
        self.store, self.spark, self.buckets = store, store.spark, buckets

    def bucket(self, term: Column) -> Column:
        return F.pmod(F.xxhash64(term), F.lit(self.buckets)).cast("int")

    def path(self, run: Run, part: str = "terms") -> str:
        return run.path.replace(self.store.path, f"{self.store.path}/{part}", 1)

    def numbers(self, run: Run) -> DataFrame:
        return self.spark.read.schema(NUMBERED).parquet(self.path(run, "numbers"))

    def numbered(self, run: Run) -> int:
        """Write the number of each posting of a run; the seed with which no two share one."""
        hashes = self.store._read(run, None).select("dedupe_hash")
        for seed in count():
            hashes.select(number(seed).alias("doc"), "dedupe_hash").write.mode("overwrite").parquet(self.path(run, "numbers"))
            n, different = self.numbers(run).agg(F.count("*"), F.count_distinct("doc")).first()
            if n == different:
                return seed

    def refresh(self) -> int:
        """Index the runs that have no index yet; how many. One that died on the way is made anew."""
        made = 0
        for run in self.store.runs():
            if not self.store.exists(f"{self.path(run)}/_SUCCESS"):
                rows = entries(self.store._read(run, None), self.bucket, self.numbered(run))
                out = rows.sortWithinPartitions("bucket", "term").write.mode("overwrite")
                (out.partitionBy("bucket") if run.merged else out).parquet(self.path(run))
                made += 1
        return made

    def found(self, terms: list[str]) -> DataFrame:
        """ENTRY rows of the terms (stems), for the newest state of each posting."""
        buckets = self.spark.createDataFrame([(t,) for t in terms], "term string").select(self.bucket(F.col("term"))).distinct().collect() if terms else []
        wanted = sorted(r[0] for r in buckets)
        runs, out, newer = self.store.runs(), None, None
        for k, run in enumerate(runs):
            rows = self.spark.read.schema(KEPT + ", bucket int").parquet(self.path(run)).where(F.col("bucket").isin(wanted) & F.col("term").isin(terms))
            rows = rows.join(self.numbers(run), "doc").select(*names(ENTRY), F.lit(k).alias("run"))
            out = rows if out is None else out.unionByName(rows)
            if k:
                touched = self.store._read(run, None).select("dedupe_hash", F.lit(k).alias("newest"))
                newer = touched if newer is None else newer.unionByName(touched)
        if out is None:
            return self.spark.createDataFrame([], ENTRY)
        if newer is not None:
            newest = newer.groupBy("dedupe_hash").agg(F.max("newest").alias("newest"))
            out = out.join(newest, "dedupe_hash", "left").where("newest IS NULL OR run >= newest").drop("newest")
        return out.drop("run")

    def scores(self, keyword: str) -> DataFrame:
        """``dedupe_hash, score`` of the postings with any term of the keyword."""
        hits = self.found(Q.stemmed_terms(self.spark, keyword))
        return hits.groupBy("dedupe_hash").agg(F.sum(sum((F.col(name) * weight for name, weight in Q.WEIGHTS.items()), F.lit(0))).cast("int").alias("score"))

    def search(self, spec: Q.SearchSpec, now: Column) -> DataFrame:
        """As ``search`` over the store's postings: one page, in order, with ``score``."""
        postings = self.store.postings()
        if spec.keyword:
            postings = postings.join(self.scores(spec.keyword), "dedupe_hash")
        rows = Q.filtered(postings, spec, now, scored=bool(spec.keyword))
        return Q.paged(rows, spec)
