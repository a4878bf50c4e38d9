"""Approximate nearest neighbours by multiprobe p-stable hashing.

Largest inner product becomes smallest distance by one more component. Every
vector is hashed by rounded projections on normal directions into a bucket of
each table. A query visits its own bucket and perturbed ones, in order of how
likely neighbours are there; the buckets' candidates merge and are ranked by the
exact measure. Vectors are hashed in layers of like lengths, so that a long one
doesn't push the others together. The number of hashes follows the number of
vectors; how many buckets a query visits is measured on a few queries, whose
neighbours are sought among all vectors. A query that found too few is compared
with all of them.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written

#: Tables, hashes of a table at most, and the width of a cell, where unit vectors are about 1.4 apart and their projections 1.
TABLES, HASHES, WIDTH = 4, 20, 2.0
#: A table's hashes are such that a bucket of evenly spread vectors would hold about this many.
EVEN_BUCKET = 200
#: Queries on which recall is measured, the recall among them that is enough, and buckets of a table visited at most.
MEASURED, RECALL, PROBES = 64, 0.97, 128
#: Vectors that tell how near a query's neighbours are at least; nothing below that is carried on.
FLOOR_VECTORS = 4096
NEAREST, QUERY_STEP = 20, 20
#: A draw of few vectors looks at about so many, so that it hardly ever finds too few.
LEAST_DRAWN = 1024
#: Vectors of one bucket that a task compares with queries at once; larger buckets are dealt into parts.
PART = 4096
#: Queries that found too few and are compared with all vectors: so many to a block, and so many blocks of vectors.
SHORT_BLOCK, ALL_BLOCKS = 1024, 64
#: Candidates this close to the last place are ranked exactly with it.
SLACK = 1e-9


def usable(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``vec_id, v`` of the rows that take part: no nulls, all finite, not zero, and of the most frequent length."""
    v = F.col(vec_col)
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf"))) & F.exists("v", lambda x: x != 0)
    found = rows.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where("vec_id IS NOT NULL AND v IS NOT NULL").where(finite)
    sizes = found.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    return found.where(F.size("v") == (sizes[0]["d"] if sizes else 0))


def dealt_join(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """A join of which neither side is copied to the driver and all tasks.

    Spark copies what it takes for small by the size of a file, but a query of a
    small file visits hundreds of buckets, and files of like vectors are compressed.
    """
    return left.join(right.hint("merge"), on, how)


def directions(d: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(5)
    return rng.standard_normal((d + 1, TABLES * HASHES)), rng.uniform(0, WIDTH, TABLES * HASHES)


def bucket_key(cells: np.ndarray) -> np.ndarray:
    """One number for the cells along the last axis."""
    out = np.zeros(cells.shape[:-1], np.uint64)
    for k in range(cells.shape[-1]):
        out = (out ^ cells[..., k].astype(np.int64).view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


def perturbations(inside: np.ndarray, count: int = PROBES) -> list[np.ndarray]:
    """The ``count`` likeliest changes of a query's cells, the first being none.

    ``inside`` is the query's place within its cell by hash (0 to 1). A change's
    score is the sum of squared distances to the borders it crosses.
    """
    k = len(inside)
    steps = sorted([(float(x) ** 2, i, -1) for i, x in enumerate(inside)] + [((1 - float(x)) ** 2, i, 1) for i, x in enumerate(inside)])
    out, heap = [np.zeros(k, np.int64)], [(steps[0][0], (0,))]
    while heap and len(out) < count:
        score, chosen = heapq.heappop(heap)
        if len({steps[j][1] for j in chosen}) == len(chosen):
            change = np.zeros(k, np.int64)
            for j in chosen:
                change[steps[j][1]] = steps[j][2]
            out.append(change)
        last = chosen[-1]
        if last + 1 < len(steps):
            heapq.heappush(heap, (score - steps[last][0] + steps[last + 1][0], (*chosen[:-1], last + 1)))
            heapq.heappush(heap, (score + steps[last + 1][0], (*chosen, last + 1)))
    return out


def stack(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """The vectors of a column (of one length, without nulls) as rows."""
    flat = pa.chunked_array([c.flatten() for c in column.chunks]) if isinstance(column, pa.ChunkedArray) else column.flatten()
    return flat.to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def frame(tables: np.ndarray, keys: np.ndarray, ids: np.ndarray, vectors: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(tables, pa.int32()), pa.array(keys, pa.int64()), pa.array(ids, pa.int64()), vectors], names=["t", "key", "id", "v"])


def entry(vectors: DataFrame) -> str:
    return f"t int, key long, id long, v {vectors.schema['v'].dataType.simpleString()}"


def length(v: str = "v"):
    """Euclidean length, without overflow of the squares."""
    v = F.transform(v, lambda x: x.cast("double"))
    most = F.array_max(F.transform(v, F.abs))
    return most * F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + (x / most) * (x / most)))


def layered(vectors: DataFrame) -> DataFrame:
    """``vec_id, v, length, layer``: lengths of a layer differ by a factor of two at most; unit vectors lie amid one."""
    return vectors.select("vec_id", "v", length().alias("length")).withColumn("layer", F.floor(F.log2("length") + 0.5))


def layer_keys(keys: np.ndarray, layers: np.ndarray) -> np.ndarray:
    return bucket_key(np.stack([keys, np.broadcast_to(layers, keys.shape)], axis=-1))


def hashes_for(count: int, fewer: int = 0) -> int:
    """Hashes of a table for a layer of so many vectors; a hash tells about two halves apart."""
    return int(np.clip(round(np.log2(max(count, 1) / EVEN_BUCKET)) - fewer, 1, HASHES))


def keys_of(cells: np.ndarray, layer: int, table_: int, hashes: int) -> np.ndarray:
    """Bucket keys of one table from cells of all directions (along the last axis)."""
    return layer_keys(bucket_key(cells[..., table_ * HASHES : table_ * HASHES + hashes]), np.array(layer))


def entry_cells(x: np.ndarray, longest: float) -> np.ndarray:
    a, b = directions(x.shape[1])
    unit = x / longest
    rest = np.sqrt(np.maximum(0, 1 - (unit * unit).sum(axis=1, keepdims=True)))
    return np.floor((np.concatenate([unit, rest], axis=1) @ a + b) / WIDTH).astype(np.int64)


def index(vectors: DataFrame, layers: dict[int, tuple[float, int]]) -> DataFrame:
    """``t, key, id, v``: every vector's bucket in each table, scaled by the longest of its layer.

    ``layers`` has the longest length and the number of hashes by layer.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(2).to_numpy()
            for layer in np.unique(own).tolist():
                part = batch.filter(pa.array(own == layer))
                longest, hashes = layers[layer]
                cells = entry_cells(stack(part.column(1)), longest)
                for t in range(TABLES):
                    yield frame(np.full(len(cells), t), keys_of(cells, layer, t, hashes), part.column(0), part.column(1))

    return vectors.select("vec_id", "v", "layer").mapInArrow(run, entry(vectors))


def lengths(x: np.ndarray) -> np.ndarray:
    """Euclidean lengths, without overflow of the squares."""
    most = np.abs(x).max(axis=1, keepdims=True)
    return most[:, 0] * np.sqrt(((x / most) ** 2).sum(axis=1))


def query_places(x: np.ndarray) -> np.ndarray:
    a, b = directions(x.shape[1])
    return (x / lengths(x)[:, None] @ a[:-1] + b) / WIDTH


def visited(place: np.ndarray, t: int, hashes: int, count: int) -> np.ndarray:
    """The cells of a table that a query visits, in order; at most all within one step."""
    own = place[t * HASHES : t * HASHES + hashes]
    cells = np.floor(own)
    return cells.astype(np.int64) + np.array(perturbations(own - cells, min(count, 3**hashes)))


def drawn(vectors: DataFrame, count: int, total: int) -> DataFrame:
    """The ``count`` vectors of ``total`` whose ids have the least hashes.

    Only hashes below a bound that about twice as many meet are ordered, as ordering
    them all takes ``count`` rows of every partition to one place.
    """
    mark, twice = F.xxhash64("vec_id"), 2 * max(count, LEAST_DRAWN)
    near = vectors if total <= twice else vectors.where(mark < (twice << 64) // total - (1 << 63))
    return near.orderBy(mark, "vec_id").limit(count)


def floors(x: np.ndarray, some: np.ndarray, nearest: int) -> np.ndarray:
    """Scores below which nothing can be among each query's ``nearest``, as so many of ``some`` vectors reach them."""
    if len(some) < nearest:
        return np.full(len(x), -np.inf)
    best = np.partition(x @ some.T, -nearest, axis=1)[:, -nearest]
    return best - SLACK * np.maximum(1, np.abs(best))


def probes(queries: DataFrame, layers: dict[int, tuple[float, int]], count: int) -> DataFrame:
    """``t, key, id, nth``: the ``count`` buckets of each table that each query visits, in every layer; the query's own is the first (0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            places, ids = query_places(stack(batch.column(1))), batch.column(0).to_numpy()
            for layer, (_, hashes) in layers.items():
                for t in range(TABLES):
                    keys = [layer_keys(bucket_key(visited(p, t, hashes, count)), np.array(layer)) for p in places]
                    sizes = [len(k) for k in keys]
                    columns = [pa.array(np.full(sum(sizes), t), pa.int32()), pa.array(np.concatenate(keys)), pa.array(np.repeat(ids, sizes)), pa.array(np.concatenate([np.arange(n) for n in sizes]), pa.int32())]
                    yield pa.RecordBatch.from_arrays(columns, names=["t", "key", "id", "nth"])

    return queries.select("vec_id", "v").mapInArrow(run, "t int, key long, id long, nth int")


def floored(queries: DataFrame, some: np.ndarray, nearest: int) -> DataFrame:
    """``id, v, floor`` of the queries; see ``floors``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(floors(stack(batch.column(1)), some, nearest))], names=["id", "v", "floor"])

    return queries.select("vec_id", "v").mapInArrow(run, f"id long, v {queries.schema['v'].dataType.simpleString()}, floor double")


def settings(asked: DataFrame, kept: DataFrame, nearest: int) -> tuple[dict[int, tuple[float, int]], int]:
    """``layers`` (see ``index``) and the number of buckets to visit, from the recall of MEASURED queries.

    Their true neighbours are sought among all vectors; both are brought to the
    driver (MEASURED * nearest rows at most). If PROBES buckets of a table aren't
    enough, tables have fewer hashes, down to one.
    """
    found = {r["layer"]: (r["m"], r["n"]) for r in kept.groupBy("layer").agg(F.max("length").alias("m"), F.count("*").alias("n")).collect()}
    some = written(drawn(asked, MEASURED, asked.count()).select("vec_id", "v"), "ann-measured")
    ranked = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    every = compared_with_all(some, kept.select("vec_id", "v"), nearest + 1).where("query <> vec_id")
    true = kept.join(F.broadcast(every.withColumn("n", ranked).where(F.col("n") <= nearest)), "vec_id")
    true = true.select("query", "layer", F.transform("v", lambda x: x.cast("double")).alias("v")).collect()
    places = {r["vec_id"]: query_places(np.array([r["v"]], float))[0] for r in some.collect()}
    orders = lru_cache(maxsize=None)(lambda query, t, hashes: visited(places[query], t, hashes, PROBES))
    for fewer in range(HASHES):
        layers = {layer: (m, hashes_for(n, fewer)) for layer, (m, n) in sorted(found.items())}
        firsts = []  # by neighbour, how many buckets come before the first that holds it
        for r in true:
            m, hashes = layers[r["layer"]]
            cells, before = entry_cells(np.array([r["v"]], float), m)[0], PROBES
            for t in range(TABLES):
                same = np.flatnonzero((orders(r["query"], t, hashes) == cells[t * HASHES : t * HASHES + hashes]).all(axis=1))
                before = min([before, *same.tolist()])
            firsts.append(before)
        need = int(np.quantile(firsts, RECALL, method="higher")) + 1 if firsts else 1
        if need <= PROBES or max((h for _, h in layers.values()), default=1) == 1:
            break
    return layers, min(need, PROBES)


def best_of(q: np.ndarray, x: np.ndarray, ids: np.ndarray, nearest: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each query the places of its ``nearest`` vectors that reach its floor, by exact score, ties to the smaller id."""
    rows, places, scores = [], [], []
    for k in range(0, len(q), 256):
        s = q[k : k + 256] @ x.T
        near = s >= floor[k : k + 256, None]
        if s.shape[1] > nearest:
            near &= s >= (np.partition(s, -nearest, axis=1)[:, -nearest] - SLACK)[:, None]
        for i in range(len(s)):
            at = np.flatnonzero(near[i])
            exact = (x[at] * q[k + i]).sum(axis=1)
            order = np.lexsort((ids[at], -exact))[:nearest]
            rows += [k + i] * len(order)
            places += at[order].tolist()
            scores += exact[order].tolist()
    return np.array(rows, np.int64), np.array(places, np.int64), np.array(scores)


def compare(entries: pa.Table, asked: pa.Table, nearest: int) -> pa.Table:
    """The best candidates of one part of a bucket for each query that visits it."""
    if entries.num_rows == 0 or asked.num_rows == 0:
        return pa.table({"query": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
    ids, queries = entries["id"].to_numpy(), asked["id"].to_numpy()
    floor = asked["floor"].to_numpy() if "floor" in asked.column_names else np.full(len(queries), -np.inf)
    rows, places, scores = best_of(stack(asked["v"]), stack(entries["v"]), ids, nearest, floor)
    return pa.table({"query": queries[rows], "vec_id": ids[places], "score": scores})


def compared_with_all(queries: DataFrame, vectors: DataFrame, nearest: int) -> DataFrame:
    """``query, vec_id, score``: the best of all vectors for each query, by blocks of both."""
    count = queries.count()
    if count == 0:
        return queries.sparkSession.createDataFrame([], "query long, vec_id long, score double")
    blocks = -(-count // SHORT_BLOCK)
    dealt = F.pmod(F.xxhash64("vec_id"), F.lit(ALL_BLOCKS)).cast("int").alias("part")
    every = vectors.select(dealt, F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.col("vec_id").alias("id"), "v")
    block = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block")
    asked = queries.select(F.explode(F.sequence(F.lit(0), F.lit(ALL_BLOCKS - 1))).alias("part"), block, F.col("vec_id").alias("id"), "v")
    names = ["part", "block"]
    return every.groupBy(names).cogroup(asked.groupBy(names)).applyInArrow(lambda e, q: compare(e, q, nearest), "query long, vec_id long, score double")


def search(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", step: int = QUERY_STEP, nearest: int = NEAREST) -> DataFrame:
    """Nearest vectors by inner product: ``query_id, rank, vec_id, score``.

    Queries are the rows whose id is divisible by ``step``; candidates are all rows
    but the query's own. Null, zero and non-finite vectors and rows without an id
    take no part, nor do vectors of another number of components than most have, as
    they have no inner product with those. Equal scores go to the smaller id. Of
    identical vectors the ``nearest + 1`` smallest ids can be results, so only those
    are indexed; identical queries are searched once. Rows repeated with one id count
    once: the least vector does. Other columns are ignored.
    """
    vectors = written(usable(rows, id_col, vec_col).groupBy("vec_id").agg(F.min("v").alias("v")), "ann-vectors")
    same = Window.partitionBy("v").orderBy("vec_id")
    kept = written(layered(vectors.withColumn("n", F.row_number().over(same)).where(F.col("n") <= nearest + 1)), "ann-kept")
    asked = vectors.where(F.col("vec_id") % step == 0)
    first = written(asked.withColumn("n", F.row_number().over(same)).where("n = 1").drop("n"), "ann-queries")
    layers, count = settings(first, kept, nearest)
    total = kept.count()
    some = drawn(kept, FLOOR_VECTORS, total).select(F.transform("v", lambda x: x.cast("double")).alias("v")).collect()
    low = np.array([r["v"] for r in some], float) if some else np.zeros((0, 1))
    entries = written(index(kept, layers), "ann-index")
    # large buckets are dealt into parts, and their visitors go to each part
    parts = entries.groupBy("t", "key").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
    dealt = dealt_join(entries, parts, ["t", "key"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).drop("parts")
    visits = dealt_join(probes(first, layers, count), parts, ["t", "key"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    visits = written(visits, "ann-visits")
    names = ["t", "key", "part"]

    def met(some_visits: DataFrame, asked_with: DataFrame) -> DataFrame:
        visitors = dealt_join(some_visits.select("t", "key", "part", "id"), asked_with, "id").select("t", "key", "part", "id", "v", "floor")
        return dealt.groupBy(names).cogroup(visitors.groupBy(names)).applyInArrow(lambda e, q: compare(e, q, nearest + 1), "query long, vec_id long, score double")

    # what its own buckets hold tells each query how near the rest must be to count
    start = written(floored(first, low, nearest + 1), "ann-floors")
    own_found = written(met(visits.where("nth = 0"), start).distinct(), "ann-own")
    by_score = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    last = own_found.withColumn("n", by_score).where(F.col("n") == nearest + 1).select(F.col("query").alias("id"), (F.col("score") - SLACK * F.greatest(F.lit(1.0), F.abs("score"))).alias("reached"))
    nearer = dealt_join(start, last, "id", "left").select("id", "v", F.greatest("floor", "reached").alias("floor"))
    found = own_found.unionByName(met(visits.where("nth > 0"), nearer))
    ranked = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    probed = written(found.distinct().withColumn("n", ranked).where(F.col("n") <= nearest + 1), "ann-found")
    # a query that found fewer than there are meets all vectors
    enough = probed.where(F.col("n") == min(nearest + 1, total)).select(F.col("query").alias("vec_id"))
    short = dealt_join(first, enough, "vec_id", "left_anti").select("vec_id", "v")
    rest = compared_with_all(short, kept, nearest + 1).withColumn("n", ranked).where(F.col("n") <= nearest + 1)
    merged = dealt_join(probed, short.select(F.col("vec_id").alias("query")), "query", "left_anti").unionByName(rest)
    # every query of identical ones gets the list without itself
    lists = merged.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("n", "vec_id", "score"))).alias("best"))
    heads = dealt_join(first.select("v", F.col("vec_id").alias("query")), lists, "query")
    own = dealt_join(asked, heads, "v").select(F.col("vec_id").alias("query_id"), F.slice(F.filter("best", lambda b: b["vec_id"] != F.col("vec_id")), 1, nearest).alias("best"))
    out = own.select("query_id", F.posexplode("best").alias("place", "b"))
    return out.select("query_id", (F.col("place") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"), F.col("b.score").alias("score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"))
