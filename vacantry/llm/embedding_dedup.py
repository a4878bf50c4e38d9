"""Embedding near-duplicates by products of int8 tiles with bounds on the quantisation error.

A vector's direction is quantised to int8 with its own scale. The length of what
quantisation lost is kept beside it, so the product of two quantised directions
tells the cosine up to a bound that holds for these two vectors. Tiles of
quantised vectors meet; a pair is dropped where the bound puts it below the
threshold. Only vectors that are left in a tile pair travel there in full, and
only pairs that are left are computed in double precision.

Identical vectors of one label are one vector with a weight. Vectors are tiled by
the nearest of a few pivots, and a vector visits only the cells that may hold a
neighbour by the triangle inequality; that is exact too and saves most of the
work where vectors lie in clusters. A tile pair gives the sums of weights and a
forest of its links, never all its pairs.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import connected_components, table, written

COSINE = 0.93
#: Vectors of one tile on average, and pivots at most.
TILE, PIVOTS = 4096, 64
#: Components of which int8 products sum exactly in float32.
CHUNK = 1024
#: Slack of the bounds for rounding in float64.
SLACK = 1e-9
#: Rows of a tile whose products are held at once, and pairs computed one by one at once.
ROWS, PAIRS = 512, 1 << 16
#: What names a pair of tiles: the visitors' tile and the residents'.
PLACE = ["label", "d", "cell", "block", "to_cell", "to_block"]
BODY = ["digest", "codes", "scale", "norm", "lost"]


def lengths_of(column: pa.Array) -> np.ndarray:
    return np.diff(column.offsets.to_numpy()).astype(np.int64)


def direction(x: np.ndarray) -> np.ndarray:
    """The rows as float64, scaled by powers of two so that squares neither overflow nor vanish."""
    x = x.astype(float) + 0.0  # no negative zero
    _, exponent = np.frexp(np.abs(x).max(axis=1, initial=0, keepdims=True))
    return np.ldexp(x, -exponent)


def norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x * x).sum(axis=1))


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``codes, scale, norm, lost`` of the unit vectors of ``x``: ``codes * scale`` is ``lost`` away at most and ``norm`` long."""
    unit = x / norms(x)[:, None]
    scale = np.abs(unit).max(axis=1) / 127
    codes = np.rint(unit / scale[:, None]).astype(np.int8)
    rough = codes * scale[:, None]
    return codes, scale, norms(rough) * (1 + SLACK), norms(unit - rough) * (1 + SLACK) + SLACK


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of int8 rows, as whole numbers."""
    out = np.zeros((len(a), len(b)))
    for k in range(0, a.shape[1], CHUNK):  # sums below 2**24, which float32 holds
        out += a[:, k : k + CHUNK].astype(np.float32) @ b[:, k : k + CHUNK].astype(np.float32).T
    return out


def possible(a: tuple, b: tuple, cosine: float) -> Iterator[tuple[int, np.ndarray]]:
    """For blocks of rows of ``a``: where they begin, and which pairs with ``b`` may reach ``cosine``."""
    for k in range(0, len(a[0]), ROWS):
        codes, scale, norm, lost = (part[k : k + ROWS] for part in a)
        near = products(codes, b[0]) * scale[:, None] * b[1]
        error = norm[:, None] * b[3] + lost[:, None] * (b[2] + b[3])
        yield k, near + error >= cosine - SLACK


def cosines(x: np.ndarray, y: np.ndarray, may: np.ndarray, cosine: float) -> np.ndarray:
    """Which of the pairs in ``may`` reach ``cosine``, in double precision."""
    nx, ny = norms(x), norms(y)
    if may.sum() * 16 > may.size:
        return may & ((x @ y.T) / (nx[:, None] * ny) >= cosine)
    out = np.zeros(may.shape, bool)
    i, j = np.nonzero(may)
    for k in range(0, len(i), PAIRS):
        p, q = i[k : k + PAIRS], j[k : k + PAIRS]
        out[p, q] = (x[p] * y[q]).sum(axis=1) / (nx[p] * ny[q]) >= cosine
    return out


def keyed(rows: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """``id, label, v, digest`` of the rows; ``digest`` (128 bits of BLAKE2) names label and vector and is null for vectors that can't link."""
    own = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vec_col).alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, labels, vectors = batch.columns
            found = []
            for label, v in zip(labels.to_pylist(), vectors):
                x = v.values.to_numpy(zero_copy_only=False).astype(float) if v.is_valid and v.values.null_count == 0 else np.zeros(0)
                ok = label is not None and len(x) and np.isfinite(x).all() and x.any()
                found.append(hashlib.blake2b((x + 0.0).tobytes() + label.encode("utf-8", "surrogatepass"), digest_size=16).digest() if ok else None)
            yield pa.RecordBatch.from_arrays([ids, labels, vectors, pa.array(found, pa.binary())], names=["id", "label", "v", "digest"])

    return own.mapInArrow(run, f"id long, label string, v {own.schema['v'].dataType.simpleString()}, digest binary")


def rows_of(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, d)


CODES = "label string, d int, digest binary, codes binary, scale double, norm double, lost double, cell int, far double, visits array<struct<cell:int,gap:double>>"


def coded(distinct: DataFrame, pivots: np.ndarray, cosine: float) -> DataFrame:
    """The quantised vectors (CODES) with their nearest pivot's cell and the cells behind it that they may visit.

    A vector with its pivot at distance ``own`` has no neighbour within ``reach`` in the
    cell of a pivot at distance ``other`` if (other - own) / 2 > reach; ``gap`` is how
    far a cell must extend from its pivot to come within reach. Vectors of another
    length than the pivots' have cell 0.
    """
    reach = math.sqrt(2 - 2 * cosine) + SLACK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = lengths_of(batch.column("v"))
            for d in np.unique(sizes).tolist():
                part = batch.filter(pa.array(sizes == d))
                x = direction(rows_of(part.column("v"), d))
                codes, scale, norm, lost = quantised(x)
                visits: list[list[dict]] = [[] for _ in range(len(x))]
                cell, far = np.zeros(len(x), np.int64), np.zeros(len(x))
                if pivots.shape[1] == d and len(pivots):
                    away = np.sqrt(np.maximum(0, 2 - 2 * (x / norms(x)[:, None]) @ pivots.T))
                    cell = away.argmin(axis=1)
                    far = away[np.arange(len(x)), cell]
                    behind = np.arange(len(pivots)) > cell[:, None]
                    for i, j in zip(*np.nonzero(behind & ((away - far[:, None]) / 2 <= reach + SLACK))):
                        visits[i].append({"cell": int(j), "gap": float(away[i, j] - reach - SLACK)})
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("label"), pa.array(np.full(len(x), d), pa.int32()), part.column("digest"), pa.array([c.tobytes() for c in codes], pa.binary()),
                        pa.array(scale), pa.array(norm), pa.array(lost), pa.array(cell, pa.int32()), pa.array(far),
                        pa.array(visits, pa.list_(pa.struct([("cell", pa.int32()), ("gap", pa.float64())]))),
                    ],
                    names=["label", "d", "digest", "codes", "scale", "norm", "lost", "cell", "far", "visits"],
                )

    return distinct.select("label", "v", "digest").mapInArrow(run, CODES)


def codes_of(t: pa.Table) -> tuple[np.ndarray, ...]:
    t = t.combine_chunks()
    codes = np.frombuffer(b"".join(t["codes"].to_pylist()), np.int8).reshape(t.num_rows, -1)
    return codes, t["scale"].to_numpy(), t["norm"].to_numpy(), t["lost"].to_numpy()


def full(t: pa.Table) -> np.ndarray:
    v = t["v"].combine_chunks()
    return direction(rows_of(v, int(lengths_of(v)[0])))


def sides(t: pa.Table) -> tuple[pa.Table, pa.Table, bool]:
    """The visitors and the residents of a tile pair, and whether they are the same."""
    visitor = t["visitor"].to_numpy(zero_copy_only=False).astype(bool)
    home = t.filter(pa.array(~visitor))
    return (t.filter(pa.array(visitor)), home, False) if visitor.any() else (home, home, True)


def maybe(t: pa.Table, cosine: float) -> pa.Table:
    """Of the vectors of a tile pair those that may have a link there: PLACE, ``visitor, digest``."""
    visitors, home, same = sides(t)
    rows, columns = np.zeros(visitors.num_rows, bool), np.zeros(home.num_rows, bool)
    if visitors.num_rows and home.num_rows:
        for k, may in possible(codes_of(visitors), codes_of(home), cosine):
            if same:
                may[np.arange(len(may)), np.arange(k, k + len(may))] = False
            rows[k : k + len(may)] = may.any(axis=1)
            columns |= may.any(axis=0)
    parts = [home.filter(pa.array(columns))] if same else [visitors.filter(pa.array(rows)), home.filter(pa.array(columns))]
    return pa.concat_tables(parts).select([*PLACE, "visitor", "digest"])


def forest(near: Iterator[tuple[int, np.ndarray]], n: int, m: int, same: bool) -> list[tuple[int, int]]:
    """Links (row, column) that connect what all links do; rows and columns of the same tile are the same."""
    part = np.arange(n if same else n + m)
    out = []
    for k, hit in near:
        for i in np.flatnonzero(hit.any(axis=1)).tolist():
            j = np.flatnonzero(hit[i])
            others, first = np.unique(part[j if same else n + j], return_index=True)
            own = part[k + i]
            for other, at in zip(others.tolist(), first.tolist()):
                if other != own:
                    part[part == other] = own
                    out.append((k + i, int(j[at])))
    return out


def met(t: pa.Table, cosine: float) -> pa.Table:
    """``digest, other, weight``: links of a forest (``other`` set), and the weight of all that a vector links with (``other`` null)."""
    visitors, home, same = sides(t)
    links, counts = [], []
    if visitors.num_rows and home.num_rows:
        x, y = full(visitors), full(home)
        wx, wy = visitors["n"].to_numpy(), home["n"].to_numpy()
        names, others = visitors["digest"].to_pylist(), home["digest"].to_pylist()
        rows, columns = np.zeros(len(x), np.int64), np.zeros(len(y), np.int64)

        def blocks() -> Iterator[tuple[int, np.ndarray]]:
            for k, may in possible(quantised(x), quantised(y), cosine):
                if same:
                    may[np.arange(len(may)), np.arange(k, k + len(may))] = False
                hit = cosines(x[k : k + len(may)], y, may, cosine)
                rows[k : k + len(may)] = hit @ wy
                if not same:
                    columns[:] += wx[k : k + len(may)] @ hit
                yield k, hit

        links = [(names[i], others[j]) for i, j in forest(blocks(), len(x), len(y), same)]
        counts = [(names[i], int(rows[i])) for i in np.flatnonzero(rows)] + [(others[j], int(columns[j])) for j in np.flatnonzero(columns)]
    digest, other = [a for a, _ in links] + [a for a, _ in counts], [b for _, b in links] + [None] * len(counts)
    return pa.table({"digest": pa.array(digest, pa.binary()), "other": pa.array(other, pa.binary()), "weight": pa.array([0] * len(links) + [w for _, w in counts], pa.int64())})


def tile_pairs(codes: DataFrame, tile: int) -> DataFrame:
    """PLACE, ``visitor`` and BODY of both sides of every tile pair; a tile's pair with itself has residents only.

    A cell's vectors are dealt into blocks of about ``tile``; a block visits the later
    blocks of its cell, and its vectors the blocks of the cells behind that they may
    have a neighbour in.
    """
    counts = codes.groupBy("label", "d", "cell").agg(F.ceil(F.count("*") / tile).cast("int").alias("blocks"), F.max("far").alias("extent"))
    block = F.pmod(F.xxhash64("digest"), F.col("blocks")).cast("int").alias("block")
    homes = codes.join(counts, ["label", "d", "cell"]).withColumn("block", block)
    later = F.explode(F.sequence(F.col("block") + 1, F.col("blocks") - 1)).alias("to_block")
    within = homes.where("block + 1 < blocks").withColumn("to_cell", F.col("cell")).select("label", "d", "cell", "block", "to_cell", later, *BODY)
    to = counts.select("label", "d", F.col("cell").alias("to_cell"), F.col("blocks").alias("to_blocks"), F.col("extent").alias("to_extent"))
    visits = homes.select("label", "d", "cell", "block", *BODY, F.explode("visits").alias("visit")).withColumn("to_cell", F.col("visit.cell"))
    visits = visits.join(to, ["label", "d", "to_cell"]).where("visit.gap <= to_extent")
    every = F.explode(F.sequence(F.lit(0), F.col("to_blocks") - 1)).alias("to_block")
    visitors = within.unionByName(visits.select("label", "d", "cell", "block", "to_cell", every, *BODY)).select(*PLACE, F.lit(True).alias("visitor"), *BODY)
    residents = homes.select("label", "d", F.col("cell").alias("to_cell"), F.col("block").alias("to_block"), *BODY)
    hosts = visitors.select(*PLACE).distinct().join(residents, ["label", "d", "to_cell", "to_block"])
    alone = residents.withColumn("cell", F.col("to_cell")).withColumn("block", F.col("to_block"))
    return visitors.unionByName(hosts.unionByName(alone).select(*PLACE, F.lit(False).alias("visitor"), *BODY))


def pivots_of(classes: DataFrame, tile: int) -> np.ndarray:
    """Unit vectors, as many as the largest label has tiles, PIVOTS at most; they only save work."""
    most = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    size = classes.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    few = min(PIVOTS, math.ceil(most / tile))
    if few < 2:
        return np.zeros((0, 0))
    some = classes.where(F.size("v") == size["d"]).orderBy(F.xxhash64("digest"), "digest").limit(few).select("v").collect()
    x = direction(np.array([r["v"] for r in some], float))
    return x / norms(x)[:, None]


def near_duplicates(
    rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", cosine: float = COSINE, tile: int = TILE
) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for each row.

    Vectors of one label link at a cosine of ``cosine`` or more; ``n_links`` counts the
    other rows linked directly, ``component_id`` is the least id that links reach.
    Vectors without a label, null, empty or zero vectors, those that hold a null or
    non-finite component, and vectors of different lengths link with nothing. Rows
    repeated with one id are vectors of their own. A row without an id takes part but
    is never a ``component_id`` unless its whole component has none. Other columns
    are ignored.
    """
    every = keyed(rows, id_col, vec_col, label_col)
    named = written(every.select("id", "digest"), "vectors-named")
    classes = every.where("digest IS NOT NULL").groupBy("digest").agg(F.min("id").alias("least"), F.count("*").alias("n"), F.first("label").alias("label"), F.first("v").alias("v"))
    classes = written(classes, "vectors-distinct")
    codes = written(coded(classes, pivots_of(classes, tile), cosine), "vectors-coded")
    places = ", ".join(f"{c} {'string' if c == 'label' else 'int'}" for c in PLACE)
    left = tile_pairs(codes, tile).groupBy(*PLACE).applyInArrow(lambda t: maybe(t, cosine), f"{places}, visitor boolean, digest binary")
    left = written(left, "vectors-possible")
    pairs = left.join(classes.select("digest", "n", "v"), "digest").groupBy(*PLACE)
    found = written(pairs.applyInArrow(lambda t: met(t, cosine), "digest binary, other binary, weight long"), "vectors-linked")
    node = F.struct(F.col("least").isNull().alias("none"), "least", "digest")
    nodes = classes.select("digest", node.alias("node"))
    edges = found.where("other IS NOT NULL").join(nodes.withColumnRenamed("node", "a"), "digest").select("other", "a")
    edges = edges.join(nodes.select(F.col("digest").alias("other"), F.col("node").alias("b")), "other").select("a", "b")
    roots = connected_components(edges).select("node.digest", F.col("root.least").alias("root"))
    weights = found.where("other IS NULL").groupBy("digest").agg(F.sum("weight").alias("weight"))
    judged = classes.select("digest", "least", "n").join(weights, "digest", "left").join(roots, "digest", "left")
    judged = judged.select("digest", (F.col("n") - 1 + F.coalesce("weight", F.lit(0))).alias("links"), F.coalesce("root", "least").alias("reached"))
    out = named.join(judged, "digest", "left").select(F.col("id").alias("vec_id"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("reached", "id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


SQL = f"""
WITH RECURSIVE u AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: isfinite(x))) = len(embedding)
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), n AS MATERIALIZED (
  SELECT *, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS norm FROM u
), link AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2])) / (a.norm * b.norm) >= {COSINE}
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a
), found AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a
), counts AS (SELECT a AS vec_id, count(*) AS n FROM link GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN found USING (vec_id) LEFT JOIN counts USING (vec_id)
"""
