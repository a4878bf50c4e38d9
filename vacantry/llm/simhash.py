"""SimHash near-duplicates by the generalised pigeonhole principle.

The 64 bits of a fingerprint are divided into groups of correlated bits. If the
groups' thresholds sum to (allowed distance - groups + 1), two fingerprints
within the distance meet in at least one group within its threshold; -1 leaves
a group out. The thresholds are chosen by dynamic programming on the probes they
need and the candidates they are estimated to bring. Fingerprints are then
probed by group and verified on all bits. Where many meet in one bucket, they are
parted again by groups of the bits that they have not met by, in which the same
principle holds. A bucket gives links enough to connect what is near in it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import connected_components, row_key, signed, table, text_digest, without, written

BITS, SHINGLE, DISTANCE, SEED = 64, 3, 2, 42
#: Fingerprints in one bucket up to which it is linked at once; larger buckets are parted, so many times at most.
BUCKET, PARTINGS = 1 << 16, 2
#: The cost of verifying a candidate, where writing a probe costs 1.
VERIFY_COST = 0.05
#: Shingles whose bits are counted at once.
BLOCK = 1 << 15
#: The pipeline's stage: words of a shingle, differing bits of candidates, and the least share of common shingles of copies.
STAGE_SHINGLE, STAGE_DISTANCE, SIMILAR = 5, 6, 0.8
#: Documents of one class that a task compares with the one that stays.
SALT_ROWS = 512
KEYS = ["path", "k0", "k1", "k2"]


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """SimHash of the lower-cased (A-Z) words' shingles, repeats included; 0 without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # splits at ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = np.array([xxhash.xxh64_intdigest(joined, SEED)], dtype=np.uint64)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = [0, *ends[: -shingle].tolist()]
        digest = xxhash.xxh64_intdigest
        hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist())), np.uint64, len(starts))
    counts = np.zeros(BITS, np.int64)
    for k in range(0, len(hashes), BLOCK):
        bits = np.unpackbits(hashes[k : k + BLOCK].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``id_col, fp`` for each row; ``fp`` is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [signed(fingerprint(x.as_py(), shingle)) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], names=[id_col, "fp"])

    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("fp", T.LongType())])
    return docs.select(id_col, text_col).mapInArrow(run, schema)


def bit_sums(prints: DataFrame) -> tuple[np.ndarray, int]:
    """How many fingerprints have bits i and j both set, for all i and j, and how many there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((BITS, BITS)), 0
        for batch in batches:
            raw = batch.column(0).to_numpy(zero_copy_only=False).astype("<i8")
            for k in range(0, len(raw), BLOCK):
                bits = np.unpackbits(raw[k : k + BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
                total += bits.T @ bits
            n += len(raw)
        if n:
            i, j = np.divmod(np.arange(BITS * BITS), BITS)
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total.ravel()), pa.array(np.where(i + j == 0, n, 0))], names=["i", "j", "both", "n"])

    counted = prints.select("fp").mapInArrow(run, "i long, j long, both double, n long").groupBy("i", "j").agg(F.sum("both").alias("both"), F.sum("n").alias("n"))
    sums, n = np.zeros((BITS, BITS)), 0
    for row in counted.collect():  # 64 * 64 rows at most
        sums[row["i"], row["j"]], n = row["both"], n + row["n"]
    return sums, n


def correlated_groups(sums: np.ndarray, n: int, parts: int) -> list[list[int]]:
    """Divide the bits into ``parts`` groups, each grown by the bit most correlated with it."""
    p = np.diag(sums) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs(sums / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread)
    np.fill_diagonal(corr, 0)
    left, groups = set(range(BITS)), []
    for k in range(parts):
        rest = sorted(left)
        group = [max(rest, key=lambda b: corr[b, rest].max())]
        left.discard(group[0])
        while len(group) < (BITS * (k + 1)) // parts - (BITS * k) // parts:
            best = max(sorted(left), key=lambda b: corr[b, group].sum())
            group.append(best)
            left.discard(best)
        groups.append(sorted(group))
    return groups


def mask(group: list[int]) -> int:
    return signed(sum(1 << b for b in group))


def estimated_cost(group: list[int], threshold: int, n: int, meetings: float, p: np.ndarray) -> float:
    """Probes plus verified candidates if ``group`` allows ``threshold`` differing bits.

    ``meetings`` counts the pairs that agree in the whole group. A pair that differs
    in bit b is taken to be (differ / agree) of that bit times as frequent.
    """
    if threshold < 0:
        return 0.0
    differ = 2 * p[group] * (1 - p[group])
    odds = differ / np.maximum(1 - differ, 1e-9)
    poly, probes = np.zeros(threshold + 1), np.zeros(threshold + 1)
    poly[0] = probes[0] = 1
    for x in odds:
        poly[1:] += poly[:-1] * x
        probes[1:] += probes[:-1]
    return max(n, 1) * probes.sum() + VERIFY_COST * meetings * poly.sum()


def allocate(costs: list[list[float]], distance: int) -> tuple[float, list[int]]:
    """Thresholds of least total cost that sum to distance - groups + 1.

    ``costs[k][t + 1]`` is group k's cost at threshold t, from -1 to ``distance``.
    """
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for total, (cost, chosen) in best.items():
            for t in range(-1, distance + 1):
                new = (cost + row[t + 1], [*chosen, t])
                if total + t not in step or new < step[total + t]:
                    step[total + t] = new
        best = step
    return best[distance - len(costs) + 1]


def plan(prints: DataFrame, distance: int = DISTANCE) -> list[tuple[list[int], int]]:
    """``(bits, threshold)`` of each probed group, from statistics of all fingerprints.

    More groups than one above the distance can't be better, as then some are left out.
    """
    sums, n = bit_sums(prints)
    parts = range(2, distance + 2)
    layouts = [correlated_groups(sums, n, k) for k in parts]
    groups = [g for layout in layouts for g in layout]
    # distinct fingerprints never agree in all bits
    keys = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(mask(g))).alias("key")) for k, g in enumerate(groups) if len(g) < BITS]))
    sizes = prints.select(keys.alias("x")).select("x.*").groupBy("k", "key").agg(F.count("*").alias("c"))
    met = {r["k"]: float(r["m"]) for r in sizes.groupBy("k").agg(F.sum(F.col("c").cast("double") * (F.col("c") - 1) / 2).alias("m")).collect()}
    p, at, choices = np.diag(sums) / max(n, 1), 0, []
    for layout in layouts:
        costs = [[estimated_cost(g, t, n, met.get(at + i, 0.0), p) for t in range(-1, distance + 1)] for i, g in enumerate(layout)]
        cost, thresholds = allocate(costs, distance)
        choices.append((cost, [(g, t) for g, t in zip(layout, thresholds) if t >= 0]))
        at += len(layout)
    return min(choices, key=lambda c: c[0])[1]


def flips(bits: list[int], threshold: int) -> list[int]:
    """Masks that change at most ``threshold`` of ``bits``."""
    found = {0}
    for _ in range(threshold):
        found |= {f ^ (1 << b) for f in found for b in bits if not f >> b & 1}
    return [signed(f) for f in sorted(found)]


def parted(bits: list[int], parts: int) -> list[list[int]]:
    return [bits[len(bits) * k // parts : len(bits) * (k + 1) // parts] for k in range(parts)]


def forest(prints: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links within the distance that connect what all such links would: one less than each connected part has.

    Every fingerprint reached looks for its neighbours among those not yet reached.
    """
    links, left = [], prints
    while len(left) > 1:
        reached, left = [left[0]], left[1:]
        while reached and len(left):
            own = reached.pop()
            near = np.bitwise_count(left ^ own) <= distance
            found = left[near]
            links += [(own, x) for x in found]
            reached.extend(found)
            left = left[~near]
    return links


def linked(probed: DataFrame, distance: int) -> DataFrame:
    """``a, b``: links of each bucket (of which one fingerprint at least is at home), verified on all bits."""
    lists = probed.groupBy(*KEYS).agg(F.sort_array(F.collect_list("fp")).alias("fps"), F.max("own").alias("home")).where("home AND size(fps) > 1").select("fps")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(0)
            values, starts = column.flatten().to_numpy().view(np.uint64), column.offsets.to_numpy()
            starts = starts - starts[0]
            two = starts[:-1][np.diff(starts) == 2]
            two = two[np.bitwise_count(values[two] ^ values[two + 1]) <= distance]
            more = [x for k in np.flatnonzero(np.diff(starts) > 2) for x in forest(values[starts[k] : starts[k + 1]], distance)]
            pairs = np.concatenate([np.stack([values[two], values[two + 1]], axis=1), np.array(more, np.uint64).reshape(-1, 2)]).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    return lists.mapInArrow(run, "a long, b long")


def near_pairs(prints: DataFrame, distance: int = DISTANCE, bucket: int = BUCKET) -> DataFrame:
    """``a, b``: links between distinct fingerprints within ``distance`` that connect all pairs within it.

    Every such pair meets in a bucket, and each bucket gives a forest of its links, so
    a crowd of near copies doesn't bring all its pairs.
    """
    probes, rest = [], {}
    for k, (group, threshold) in enumerate(plan(prints, distance)):
        own = F.col("fp").bitwiseAND(F.lit(mask(group)))
        changes = F.expr(f"explode(array({', '.join(f'{f}L' if f > -(1 << 63) else '(-9223372036854775807L - 1L)' for f in flips(group, threshold))}))").alias("f")
        none = F.lit(0).cast("long")
        key = own.bitwiseXOR(F.col("f")).alias("k0")
        probes.append(prints.select("fp", changes).select(F.lit(k).alias("path"), key, none.alias("k1"), none.alias("k2"), (F.col("f") == 0).alias("own"), "fp"))
        rest[k] = [b for b in range(BITS) if b not in group]
    probed = probes[0]
    for more in probes[1:]:
        probed = probed.unionByName(more)
    found = None
    for parting in range(PARTINGS + 1):
        large = None
        if parting < PARTINGS:  # the buckets above the bound, which most inputs don't have
            large = written(probed.groupBy(*KEYS).agg(F.count("*").alias("n")).where(F.col("n") > bucket).drop("n"), "simhash-large")
            large = None if large.isEmpty() else large
        links = linked(probed if large is None else probed.join(large, KEYS, "left_anti"), distance)
        found = links if found is None else found.unionByName(links)
        if large is None:
            return found
        crowded = probed.join(large, KEYS, "left_semi")
        # of distance + 1 groups of the other bits, one at least is alike in both of a pair
        masks, inner = [], {}
        for path, bits in rest.items():
            groups = parted(bits, distance + 1)
            masks.append(F.when(F.col("path") == path, F.array(*(F.lit(mask(g)) for g in groups))))
            inner |= {path * (distance + 1) + j: [b for b in bits if b not in g] for j, g in enumerate(groups)}
        split = crowded.select(*KEYS, "own", "fp", F.posexplode(F.coalesce(*masks)).alias("j", "m"))
        part, column = F.col("fp").bitwiseAND(F.col("m")), f"k{parting + 1}"
        split = split.withColumn(column, part).withColumn("path", F.col("path") * (distance + 1) + F.col("j"))
        probed, rest = written(split.select(*KEYS, "own", "fp"), "simhash-parted"), inner


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE, shingle: int = SHINGLE) -> DataFrame:
    """Near-duplicate classes: ``id_col, fingerprint, component_id`` for each row.

    Documents are linked if their fingerprints differ in ``distance`` bits at most;
    ``component_id`` is the least id that links reach. A null text has no words and
    fingerprint 0, like an empty one; such documents link as any other. Repeated
    rows are all returned. A null id takes part but is never a ``component_id``
    unless its whole component has none. Other columns are ignored.
    """
    named = written(fingerprints(docs, id_col, text_col, shingle), "simhash")
    distinct = written(named.groupBy("fp").agg(F.min(id_col).alias("least")), "simhash-distinct")
    roots = connected_components(near_pairs(distinct, distance))
    labelled = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = labelled.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = labelled.join(least, "root").select("fp", "component_id")
    return named.join(classes, "fp").select(id_col, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup(table(spark, sf_dir, "documents"))


def shingles(text: str | None) -> set[bytes]:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return {b" ".join(words[k : k + STAGE_SHINGLE]) for k in range(max(1, len(words) - STAGE_SHINGLE + 1))}


def alike(pairs: DataFrame) -> DataFrame:
    """``key`` of the rows of ``key, own, other`` (two texts) that share SIMILAR of all their shingles at least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, last, known = [], None, shingles(None)
            for own, other in zip(batch.column(1), batch.column(2).to_pylist()):
                if other != last:
                    last, known = other, shingles(other)
                mine = shingles(own.as_py())
                both = len(mine & known)
                found.append(both >= SIMILAR * (len(mine) + len(known) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(found, pa.bool_()))], names=["key"])

    return pairs.select("key", "own", "other").mapInArrow(run, "key string")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies one row stays, that with the least id, and what is no near copy of it.

    Candidates have fingerprints (of STAGE_SHINGLE words) that link within
    STAGE_DISTANCE bits; a row goes if it shares SIMILAR of its and the staying
    row's shingles. Rows are told apart by id and text; of rows repeated with both,
    one stays. Columns of any name pass through.
    """
    key = row_key(F.col("doc_id"), text_digest(F.col("text")))
    named = docs.select(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"), key.alias("key")).alias("id"), "text")
    found = simhash_dedup(named, "id", distance=STAGE_DISTANCE, shingle=STAGE_SHINGLE)
    found = found.groupBy("id.key", F.col("component_id.key").alias("stays")).agg(F.least(F.count("*"), F.lit(2)).cast("int").alias("times"))
    found = written(found, "simhash-classes")
    others = found.where("key <> stays")
    sizes = others.groupBy("stays").agg(F.ceil(F.count("*") / SALT_ROWS).alias("salts"))
    needed = others.select("key").union(others.select("stays")).distinct()
    texts = written(docs.select(key.alias("key"), "text").join(needed, "key", "left_semi").groupBy("key").agg(F.max("text").alias("text")), "simhash-texts")
    salt = F.pmod(F.xxhash64("key"), F.col("salts")).alias("salt")
    own = others.join(sizes, "stays").join(texts.withColumnRenamed("text", "own"), "key").select("stays", salt, "key", "own")
    firsts = sizes.select("stays", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt")).join(texts.select(F.col("key").alias("stays"), F.col("text").alias("other")), "stays")
    gone = alike(own.join(firsts, ["stays", "salt"])).withColumn("gone", F.lit(True))
    judged = found.join(gone, "key", "left").select("key", F.col("gone").isNull().alias("kept"), F.explode(F.sequence(F.lit(1), F.col("times"))))
    return without(docs, key, judged.select("key", "kept"))
