"""The posting store, its change log and the feed of changes.

The store is a list of runs. A batch writes one run, with the new state of the
postings it touched and nothing else, then one row of the change log; a posting's
newest run has its state. ``compact`` merges neighbouring runs of like sizes into one, so
there are few runs (a logarithm of the store's size) and a posting is rewritten as
few times; merged runs are divided into parts by hash, so that a batch reads the
parts it touches. What isn't in a log is never read: a batch or a merge that died on
the way leaves files that its next attempt overwrites, and a batch that is logged is
skipped. ``vacuum`` removes runs that no recent state of the store is made of.
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vacantry.operators.merge import counters, fold_batch, upsert, validate
from vacantry.schemas import CHANGE, STORED, names


#: How often a batch is tried before it is set aside, and the seconds before a second try; they double with each.
TRIES, PAUSE = 3, 0.5
#: A run is merged into the newer ones if it has at most so many times their postings.
LIKE = 2
#: Batches after which a stream compacts the store.
COMPACT_EVERY = 8
MERGE = "first long, last long, rows long"


@dataclass(frozen=True)
class Run:
    """The state after batch ``last`` of the postings that batches ``first`` to ``last`` touched."""

    first: int
    last: int
    rows: int
    path: str
    merged: bool


class PostingStore:
    """A store under ``path``: ``batches/batch=N``, ``merged/first=M-last=N/part=P``, and the logs ``changes`` and ``merges``.

    It keeps the number of parts it began with.
    """

    def __init__(self, spark: SparkSession, path: str, parts: int = 64, pause: float = PAUSE):
        self.spark, self.path, self.parts, self.pause = spark, path.rstrip("/"), parts, pause

    def _at(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def exists(self, path: str) -> bool:
        p, files = self._at(path)
        return files.exists(p)

    def _log(self, name: str, schema: str) -> DataFrame:
        if not self.exists(f"{self.path}/{name}"):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{self.path}/{name}")

    def changes(self) -> DataFrame:
        """One row for each batch, in no order."""
        return self._log("changes", CHANGE)

    def last_batch(self) -> int | None:
        return self.changes().agg(F.max("batch_id")).first()[0]

    def part(self) -> Column:
        return F.pmod(F.xxhash64("dedupe_hash"), F.lit(self.parts)).cast("int")

    def versions(self) -> dict[int, int]:
        """The batch that last changed each part; one row for each part at most."""
        newest = self.changes().select("batch_id", F.explode("parts").alias("part")).groupBy("part").agg(F.max("batch_id").alias("batch"))
        return {r["part"]: r["batch"] for r in newest.collect()}

    def runs(self, before: int = 0) -> list[Run]:
        """The runs that the store is made of, the oldest first; with ``before``, as if the last so many merges weren't done."""
        merges = sorted((r["last"], -r["first"], r["rows"]) for r in self._log("merges", MERGE).collect())
        merges = merges[: len(merges) - before]
        live: list[Run] = []
        for last, first, rows in merges:  # a merge takes the newest runs, so ranges are nested or apart
            live = [r for r in live if r.first < -first] + [Run(-first, last, rows, f"{self.path}/merged/first={-first}-last={last}", True)]
        after = live[-1].last if live else -1
        rows = F.col("inserted") + F.col("updated")
        single = self.changes().where((F.col("batch_id") > after) & (rows > 0)).select("batch_id", rows.alias("n")).orderBy("batch_id").collect()
        return live + [Run(r["batch_id"], r["batch_id"], r["n"], f"{self.path}/batches/batch={r['batch_id']}", False) for r in single]

    def _read(self, run: Run, parts: list[int] | None) -> DataFrame:
        rows = self.spark.read.schema(STORED + ", part int").parquet(run.path)
        return (rows if parts is None else rows.where(F.col("part").isin(parts))).drop("part")

    def _newest(self, runs: list[Run], parts: list[int] | None) -> DataFrame:
        """The newest state of each posting in the runs: the oldest run passes through, but for what newer ones have."""
        if not runs:
            return self.spark.createDataFrame([], STORED)
        oldest = self._read(runs[0], parts)
        if len(runs) == 1:
            return oldest
        newer = None
        for run in runs[1:]:
            rows = self._read(run, parts).select(F.lit(run.last).alias("run"), F.struct(*names(STORED)).alias("row"))
            newer = rows if newer is None else newer.unionByName(rows)
        newer = newer.groupBy("row.dedupe_hash").agg(F.max_by("row", "run").alias("row"))
        return oldest.join(newer.select("dedupe_hash"), "dedupe_hash", "left_anti").select(*names(STORED)).unionByName(newer.select("row.*"))

    def postings(self, parts: list[int] | None = None) -> DataFrame:
        """The rows of the store, or of some of its parts."""
        return self._newest(self.runs(), parts)

    def ingest(self, raw: DataFrame, batch_id: int, now: Column) -> None:
        """Validate, fold and upsert one batch; a batch that is logged is skipped. Only touched postings are written."""
        last = self.last_batch()
        if last is not None and batch_id <= last:
            return
        checked = validate(raw, now).persist()
        folded = fold_batch(checked.where("reason IS NULL")).persist()
        try:
            touched = sorted(r[0] for r in folded.select(self.part()).distinct().collect())  # the number of parts at most
            old = self.postings(touched).join(folded.select("dedupe_hash"), "dedupe_hash", "left_semi").select(*names(STORED))
            tagged = upsert(old, folded, now).withColumn("part", self.part())
            target = f"{self.path}/batches/batch={batch_id}"
            tagged.repartition("part").sortWithinPartitions("part", "dedupe_hash").write.mode("overwrite").parquet(target)
            written = self.spark.read.schema(tagged.schema).parquet(target)
            row = counters(checked, written).withColumns({"batch_id": F.lit(batch_id).cast("long"), "at": now, "parts": F.array(*map(F.lit, touched)).cast("array<int>")})
            row.select(*names(CHANGE)).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/changes/batch={batch_id}")
        finally:
            folded.unpersist()
            checked.unpersist()

    def compact(self) -> bool:
        """Merge the newest runs that are alike in size (LIKE); whether there were any."""
        runs = self.runs()
        start, total = len(runs) - 1, runs[-1].rows if runs else 0
        while start > 0 and runs[start - 1].rows <= LIKE * total:
            start -= 1
            total += runs[start].rows
        chosen = runs[start:]
        if len(chosen) < 2:
            return False
        first, last = chosen[0].first, chosen[-1].last
        target = f"{self.path}/merged/first={first}-last={last}"
        self._newest(chosen, None).withColumn("part", self.part()).repartition("part").sortWithinPartitions("part", "dedupe_hash").write.partitionBy("part").mode("overwrite").parquet(target)
        rows = self.spark.read.schema(STORED + ", part int").parquet(target).count()
        self.spark.createDataFrame([(first, last, rows)], MERGE).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/merges/first={first}-last={last}")
        return True

    def vacuum(self, keep: int = 1) -> list[str]:
        """Delete the runs that neither the store nor its states before the last ``keep`` merges are made of.

        Readers that began before those merges may still read them.
        """
        used = {run.path for k in range(keep + 1) for run in self.runs(k)}
        newest = self.last_batch()
        gone = []
        for kind in ("batches", "merged"):
            folder, files = self._at(f"{self.path}/{kind}")
            for found in files.listStatus(folder) if files.exists(folder) else []:
                name = found.getPath().getName()
                own = f"{self.path}/{kind}/{name}"
                pending = kind == "batches" and (newest is None or int(name.split("=")[1]) > newest)  # a batch that isn't logged yet
                if own not in used and not pending and files.delete(found.getPath(), True):
                    gone.append(own)
        return sorted(gone)

    def skip(self, raw: DataFrame, batch_id: int, now: Column, reason: str) -> None:
        """Set a batch's rows aside and log it as skipped; the store stays as it is.

        Rows that can't be computed are lost with their batch, as there is nothing to
        keep. If they can, but can't be written, the fault isn't theirs: that error goes
        up and the batch stays to be done.
        """
        try:
            raw.write.mode("overwrite").parquet(f"{self.path}/aside/batch={batch_id}")
        except Exception:
            try:
                raw.write.format("noop").mode("overwrite").save()
            except Exception:
                reason = f"{reason}, rows not readable"
            else:
                raise
        try:
            n = raw.count()
        except Exception:  # not even readable
            n = 0
        row = self.spark.createDataFrame([(batch_id, None, n, 0, 0, 0, n, None, [reason], [])], CHANGE).withColumn("at", now)
        row.select(*names(CHANGE)).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/changes/batch={batch_id}")

    def aside(self) -> DataFrame | None:
        """The rows of skipped batches, to be mended and ingested as a batch of their own; None if there are none."""
        skipped = [r["batch_id"] for r in self.changes().where("received = skipped AND size(parts) = 0").select("batch_id").orderBy("batch_id").collect()]
        paths = [p for p in (f"{self.path}/aside/batch={b}" for b in skipped) if self.exists(p)]
        return self.spark.read.parquet(*paths) if paths else None

    def ingest_or_skip(self, raw: DataFrame, batch_id: int, now: Column) -> None:
        """Try a batch several times, with pauses; one that keeps failing is set aside, so that it doesn't hold up the stream."""
        for k in range(TRIES):
            try:
                return self.ingest(raw, batch_id, now)
            except Exception as e:  # the rows' fault, or that of a disk or an executor; a pause may help with the latter
                if k == TRIES - 1:
                    self.skip(raw, batch_id, now, f"batch failed: {type(e).__name__}")
                else:
                    time.sleep(self.pause * 2**k)

    def stream(self, raw: DataFrame, checkpoint: str, now: Column, compact_every: int = COMPACT_EVERY):
        """Feed the store from a streaming frame of raw postings until it has no more."""

        def one(df: DataFrame, batch: int) -> None:
            self.ingest_or_skip(df, batch, now)
            if (batch + 1) % compact_every == 0:
                self.compact()

        query = raw.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
        return query


def events(changes: DataFrame) -> DataFrame:
    """Changes worth telling: counts that aren't numbers are 0, batches that changed nothing are left out."""
    count = lambda c: F.coalesce(F.col(c).cast("string").try_cast("long"), F.lit(0)).alias(c)
    return changes.select("at", *[count(c) for c in ("inserted", "updated", "merged")]).where("inserted + updated + merged > 0")


def last_change(changes: DataFrame) -> DataFrame:
    return events(changes).agg(F.max("at").alias("at"))


def pending_new(changes: DataFrame, since: Column) -> DataFrame:
    """How many postings came since a moment."""
    return events(changes).where(F.col("at") > since).agg(F.coalesce(F.sum("inserted"), F.lit(0)).alias("pending"))


def totals(changes: DataFrame) -> DataFrame:
    """The counts of all batches together."""
    return changes.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("received", "inserted", "updated", "merged", "skipped")])


def tail(spark: SparkSession, path: str) -> DataFrame:
    """The change log as a stream."""
    return spark.readStream.schema(CHANGE).option("recursiveFileLookup", "true").parquet(f"{path}/changes")


#: What a subscriber is told of a batch, with the counts since its subscription.
TOLD = "subscriber string, batch_id long, at timestamp, inserted long, updated long, merged long, all_inserted long, all_updated long, all_merged long"
_COUNTS = ("inserted", "updated", "merged")


def _tell(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    """Batches behind the position, in their order; the position and the counts are the state."""
    position, *sums = state.get if state.exists else (-1, 0, 0, 0)
    rows = pd.concat(list(frames)).drop_duplicates("batch_id").sort_values("batch_id")
    rows = rows[rows["batch_id"] > position]
    if len(rows):
        out = rows[["batch_id", "at", *_COUNTS]].copy()
        for k, c in enumerate(_COUNTS):
            out[f"all_{c}"] = rows[c].cumsum() + sums[k]
        out.insert(0, "subscriber", key[0])
        state.update((int(rows["batch_id"].iloc[-1]), *(int(out[f"all_{c}"].iloc[-1]) for c in _COUNTS)))
        yield out


def follow(spark: SparkSession, path: str, subscriber: str, to: str, checkpoint: str, batches_per_step: int = 1000):
    """Append to ``to`` (Parquet, TOLD) every batch that changed the store and the subscriber wasn't told of.

    The stream's state keeps the subscriber's position, and its checkpoint what was
    read and written, so a stream that is started again goes on where it ended and
    tells nothing twice. Batches are logged in their order; one that comes behind the
    position was told. A step holds so many rows of the log.
    """
    log = spark.readStream.schema(CHANGE).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", batches_per_step).parquet(f"{path}/changes")
    news = log.select(F.lit(subscriber).alias("subscriber"), "batch_id", "at", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in _COUNTS]).where("inserted + updated + merged > 0")
    told = news.groupBy("subscriber").applyInPandasWithState(_tell, TOLD, "position long, inserted long, updated long, merged long", "append", "NoTimeout")
    query = told.writeStream.format("parquet").option("path", to).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def read_batches(spark: SparkSession, path: str, schema: str, files_per_batch: int = 50) -> DataFrame:
    """Landed raw postings as a stream of batches of so many files."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(path)
