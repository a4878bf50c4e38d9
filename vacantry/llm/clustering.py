"""Centroid clustering of integer vectors with a vantage-point tree.

Vectors become integers, so distances, sums and centroids are exact and every
run gives the same clusters. In each round the driver builds a vantage-point tree
over the centroids (a number that is a parameter, so its size is bounded) and
broadcasts it; every vector searches it best first, leaves out what the radii
rule out (a bound that equals the best distance does not, as a tie may go to a
smaller number), and compares whole leaves. Vectors are searched in batches: at
each step every vector that isn't done opens its own best node. Tasks add up
their vectors by centroid before anything is shuffled.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

CLUSTERS, ROUNDS, COMPONENTS, SCALE, SEED = 40, 5, 64, 256, 2
#: Centroids of one leaf, and vectors that search at once.
LEAF, BATCH = 6, 4096
#: Up to this size of a component all that a distance of 64 components needs is a whole number below 2**53, so float64 is exact.
NARROW = 1 << 22
#: Slack of a distance in floating point, as a share.
SLACK = 1e-9
#: Sums of components too large for a long are kept in digits of so many bits.
DIGIT = 20
LONG = (1 << 63) - 1


@dataclass
class Tree:
    """Node k has a vantage centroid and two children, or is a leaf with several; numbers are those of the centroids.

    A child's shell ``lo, hi`` holds the distances of its centroids from its
    parent's vantage point.
    """

    vantage: list[int]
    children: list[tuple[int, int]]
    leaf: list[np.ndarray]
    lo: list[float]
    hi: list[float]


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of both, exact for components up to NARROW."""
    return (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1) - 2 * (x @ y.T)


def build(points: np.ndarray, numbers: np.ndarray) -> Tree:
    """A tree over ``points[numbers]``; the vantage point of a node is the one farthest from their mean."""
    tree = Tree([], [], [], [], [])

    def grow(own: np.ndarray, lo: float, hi: float) -> int:
        k = len(tree.vantage)
        tree.vantage.append(-1)
        tree.children.append((-1, -1))
        tree.leaf.append(own)
        tree.lo.append(lo)
        tree.hi.append(hi)
        if len(own) > LEAF:
            far = points[own] - points[own].mean(axis=0)
            v = int(np.argmax((far * far).sum(axis=1)))
            rest = np.delete(own, v)
            d = np.sqrt(distances(points[own[v : v + 1]], points[rest])[0])
            order = np.argsort(d, kind="stable")
            half = len(order) // 2
            tree.vantage[k], tree.leaf[k] = int(own[v]), own[:0]
            tree.children[k] = tuple(grow(np.sort(rest[part]), d[part].min(), d[part].max()) for part in (order[:half], order[half:]))
        return k

    grow(numbers, 0.0, math.inf)
    return tree


def better(best: np.ndarray, number: np.ndarray, rows: np.ndarray, d: np.ndarray, of: np.ndarray) -> None:
    """Take distances ``d`` (rows by centroids ``of``, ascending) where they are smaller, or as small with a smaller number."""
    at = d.argmin(axis=1)
    least, who = d[np.arange(len(rows)), at], of[at]
    take = (least < best[rows]) | ((least == best[rows]) & (who < number[rows]))
    best[rows[take]], number[rows[take]] = least[take], who[take]


def search(tree: Tree, points: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """``number, squared distance`` of each row's nearest centroid, and how many distances that took."""
    n, nodes, took = len(x), len(tree.vantage), 0
    best, number = np.full(n, np.inf), np.full(n, np.iinfo(np.int64).max)
    bound = np.full((n, nodes), np.inf)  # least distance that an opened node's centroids can have
    bound[:, 0] = 0
    active = np.arange(n)
    while len(active):
        node = bound[active].argmin(axis=1)
        low = bound[active, node]
        # inclusive: a node that may hold a tie is opened
        going = low <= np.sqrt(best[active]) * (1 + SLACK)
        going &= low < np.inf
        active, node, low = active[going], node[going], low[going]
        for k in np.unique(node).tolist():
            rows, least = active[node == k], low[node == k]
            bound[rows, k] = np.inf
            if tree.vantage[k] < 0:
                d = distances(x[rows], points[tree.leaf[k]])
                better(best, number, rows, d, tree.leaf[k])
                took += d.size
                continue
            v = tree.vantage[k]
            d = distances(x[rows], points[v : v + 1])
            better(best, number, rows, d, np.array([v]))
            took += d.size
            far = np.sqrt(d[:, 0])
            for child in tree.children[k]:
                gap = np.maximum(far - tree.hi[child], tree.lo[child] - far) - SLACK * (far + tree.hi[child])
                bound[rows, child] = np.maximum(least, gap)
    return number, best, took


def scaled(v: np.ndarray) -> np.ndarray:
    """``floor(SCALE * component)`` as float64 where that is exact, else as Python integers."""
    x = np.floor(SCALE * v)
    if (np.abs(x) <= NARROW).all():
        return x
    # beyond 2**53 a double is a whole number, and its product with SCALE is exact
    return np.array([[SCALE * int(a) if abs(a) >= 1 << 53 else math.floor(SCALE * a) for a in row] for row in v.tolist()], object).reshape(v.shape)


def is_narrow(x: np.ndarray) -> np.ndarray:
    """Rows whose components are at most NARROW."""
    return (np.abs(x) <= NARROW).all(axis=1).astype(bool)


class Nearest:
    """The nearest centroid of vectors; the tree holds the narrow centroids, for narrow vectors.

    Wide vectors and wide centroids (see NARROW) meet each other and the rest in
    Python integers.
    """

    def __init__(self, centroids: list[list[int]]):
        self.exact = np.array(centroids, object).reshape(len(centroids), -1)
        slim = is_narrow(self.exact)
        self.narrow, self.wide = np.flatnonzero(slim), np.flatnonzero(~slim)
        self.points = np.where(slim[:, None], self.exact, 0).astype(float)
        self.tree = build(self.points, self.narrow) if len(self.narrow) else None

    def find(self, v: np.ndarray) -> tuple[np.ndarray, list[int], list[list[int]] | np.ndarray]:
        """``number, squared distance, integer vector`` for each row of ``v``."""
        with np.errstate(over="ignore"):
            slim = np.flatnonzero(is_narrow(np.floor(SCALE * v)))
        x = np.floor(SCALE * v[slim])
        number, best = np.full(len(v), -1), [0] * len(v)
        if self.tree is not None and len(slim):
            for k in range(0, len(slim), BATCH):
                found, d, _ = search(self.tree, self.points, x[k : k + BATCH])
                number[slim[k : k + BATCH]] = found
                for i, y in zip(slim[k : k + BATCH].tolist(), d.tolist()):
                    best[i] = int(y)
        if len(slim) == len(v) and not len(self.wide):
            return number, best, x
        whole = np.zeros(v.shape, object)
        whole[slim] = x.astype(np.int64).astype(object)
        rest = np.setdiff1d(np.arange(len(v)), slim)
        if len(rest):
            whole[rest] = scaled(v[rest]).astype(object)
        alone = set(rest.tolist())
        for i in range(len(v)):
            seen = [] if i in alone or self.tree is None else [(best[i], int(number[i]))]
            others = range(len(self.exact)) if i in alone else self.wide.tolist()
            best[i], number[i] = min(seen + [(sum((a - b) ** 2 for a, b in zip(whole[i], self.exact[c])), c) for c in others])
        return number, best, whole


def stacked(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def sums_of(numbers: np.ndarray, x: np.ndarray) -> Iterator[tuple[int, int, int, list[int]]]:
    """``cluster, digit, n, sums``: the vectors added up by cluster, wide sums digit by digit."""
    for c in np.unique(numbers).tolist():
        own = x[numbers == c]
        if x.dtype != object:
            yield c, 0, len(own), own.sum(axis=0).astype(np.int64).tolist()
            continue
        left = own.sum(axis=0)
        digit = 0
        while digit == 0 or any(left):
            yield c, digit, len(own) if digit == 0 else 0, [int(s) & ((1 << DIGIT) - 1) if s >= 0 else -(-int(s) & ((1 << DIGIT) - 1)) for s in left]
            left = np.array([int(s) >> DIGIT if s >= 0 else -(-int(s) >> DIGIT) for s in left], object)
            digit += 1


def summed(vectors: DataFrame, centroids: list[list[int]]) -> dict[int, tuple[int, list[int]]]:
    """``n, sums`` of the vectors nearest to each centroid; the rows that reach the driver are bounded by the centroids."""
    tree = vectors.sparkSession.sparkContext.broadcast(Nearest(centroids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                number, _, x = tree.value.find(stacked(batch.column(0)))
                rows = list(sums_of(number, x))
                columns = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64())))]
                yield pa.RecordBatch.from_arrays(columns, names=["cluster", "digit", "n", "sums"])

    parts = vectors.select("v").mapInArrow(run, "cluster int, digit int, n long, sums array<long>")
    flat = parts.select("cluster", "digit", "n", F.posexplode("sums").alias("k", "s")).groupBy("cluster", "digit", "k").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    out: dict[int, tuple[int, list[int]]] = {}
    for r in flat.collect():
        n, sums = out.get(r["cluster"], (0, [0] * len(centroids[0])))
        sums[r["k"]] += r["s"] << (DIGIT * r["digit"])
        out[r["cluster"]] = (r["n"] if r["digit"] == 0 else n, sums)
    tree.unpersist()
    return out


def assigned(vectors: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """``vec_id, cluster, distance``; a distance past a long is null."""
    tree = vectors.sparkSession.sparkContext.broadcast(Nearest(centroids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                number, best, _ = tree.value.find(stacked(batch.column(1)))
                far = pa.array([d if d <= LONG else None for d in best], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(number, pa.int32()), far], names=["vec_id", "cluster", "distance"])

    return vectors.select("vec_id", "v").mapInArrow(run, "vec_id long, cluster int, distance long")


def usable(v: Column, components: int) -> Column:
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return v.isNotNull() & (F.size(v) == components) & F.coalesce(finite, F.lit(False))


def cluster(
    rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", clusters: int = CLUSTERS, rounds: int = ROUNDS, components: int = COMPONENTS
) -> tuple[DataFrame, list[list[int]]]:
    """``vec_id, cluster, distance`` of every vector that takes part, and the final centroids.

    Vectors of another number of components and those that are null or hold a null or
    non-finite component take no part. Rows repeated with one id are vectors of
    their own. The first centroids are the vectors with the least hashes of their
    ids, rows of one id by their integers; fewer vectors make fewer centroids, none
    makes none. A vector without an id is assigned, but never a first centroid.
    Distances past a long are null. Other columns are ignored.
    """
    spark = rows.sparkSession
    vectors = written(rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("v")).where(usable(F.col("v"), components)), "cluster-vectors")
    key = F.sha2(F.concat(F.lit(f"{SEED}:"), F.col("vec_id").cast("string")), 256)
    whole = F.transform("v", lambda x: F.floor(F.lit(SCALE) * x.cast("double")))
    first = vectors.where("vec_id IS NOT NULL").select("v", key.alias("key"), whole.alias("whole")).orderBy("key", "whole", "v").limit(clusters).select("v").collect()
    centroids = [[int(x) for x in scaled(np.array([r["v"]], float))[0].tolist()] for r in first]
    if not centroids:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long"), []
    for _ in range(rounds):
        for c, (n, sums) in summed(vectors, centroids).items():
            centroids[c] = [s // n for s in sums]
    return assigned(vectors, centroids), centroids


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters with their inertia and the digests of their centroids.

    An inertia past a long, or over a distance past one, is null.
    """
    found, centroids = cluster(table(spark, sf_dir, "embeddings"))
    found = written(found, "clusters")
    total = F.sum(F.col("distance").cast("decimal(38,0)"))
    sums = found.groupBy("cluster").agg(F.when(F.count("distance") == F.count("*"), total).alias("inertia")).collect()  # one row a centroid
    all_ = sum(r["inertia"] for r in sums) if all(r["inertia"] is not None for r in sums) else None
    fits = lambda x: int(x) if x is not None and x <= LONG else None
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    ends = [(r["cluster"], fits(r["inertia"]), fits(all_), digests[r["cluster"]]) for r in sums]
    ends = spark.createDataFrame(ends, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(ends), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def rounds_sql(rounds: int = ROUNDS, clusters: int = CLUSTERS, components: int = COMPONENTS) -> str:
    """The rounds one after the other, all in whole numbers."""
    out = [f"""
WITH v AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE len(embedding) = {components} AND len(list_filter(embedding, lambda x: isfinite(x))) = {components}
), c0 AS MATERIALIZED (
  SELECT (row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id), x) - 1)::INTEGER AS cluster, x AS c FROM v
  WHERE vec_id IS NOT NULL ORDER BY sha256('{SEED}:' || vec_id), x LIMIT {clusters}
)"""]
    far = "list_sum(list_transform(list_zip(x, c), lambda p: (p[1] - p[2])::BIGINT * (p[1] - p[2])))::BIGINT"
    for k in range(rounds + 1):
        out.append(f"""a{k} AS MATERIALIZED (
  SELECT vec_id, any_value(x) AS x, arg_min(cluster, (d, cluster)) AS cluster, min(d) AS d
  FROM (SELECT r, vec_id, x, cluster, {far} AS d FROM (SELECT row_number() OVER () AS r, * FROM v), c{k}) GROUP BY r, vec_id
)""")
        if k < rounds:
            out.append(f"""m{k} AS (
  SELECT cluster, i, sum(x)::HUGEINT AS s, count(*) AS n FROM (SELECT cluster, unnest(x) AS x, generate_subscripts(x, 1) AS i FROM a{k}) GROUP BY cluster, i
), c{k + 1} AS MATERIALIZED (
  SELECT c{k}.cluster, coalesce(any_value(g.c), any_value(c{k}.c)) AS c FROM c{k} LEFT JOIN (
    SELECT cluster, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS c FROM m{k} GROUP BY cluster
  ) g USING (cluster) GROUP BY c{k}.cluster
)""")
    last = f"""
SELECT vec_id, a.cluster, d AS distance, (sum(d) OVER (PARTITION BY a.cluster))::BIGINT AS cluster_inertia,
  (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c USING (cluster)"""
    return ", ".join(out) + last


SQL = rounds_sql()
