"""Substring deduplication by recompression.

Rounds name runs and pairs of word symbols. A name follows from what it stands
for, so it is the same in every document and every task, and whether a symbol
forms depends on few words around it. Each symbol keeps the span of words that
its forming depends on: where those words stand again, the same symbol stands
again. So a window of words that repeats has only shared symbols whose spans lie
within it. Spark counts names over all documents, windows with a symbol that is
seen once are out, and what is left is verified by 95 bits of hash of its words:
among n different windows about n * n / 2**96 pairs would be taken for equal, a
thousandth of a pair among 10**13.

Documents are dealt into buckets by hash, and every bucket sends each name and
each window once, so frequent passages do not pile up in one task.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table

SPAN = 35
#: The rounds of recompression: runs, then pairs, and so on.
ROUNDS = "rpppprpp"
#: Symbols of fewer words are not counted; windows without counted symbols are all verified.
LEAST_WORDS = 3
BUCKET_BYTES = 8 << 20
FAR = np.int64(1) << 40


def mix(a: np.ndarray, b: np.ndarray | int, key: int) -> np.ndarray:
    """A 64-bit hash of two numbers."""
    with np.errstate(over="ignore"):
        x = a * np.uint64(0x9E3779B97F4A7C15) + (np.asarray(b, np.uint64) ^ np.uint64(key)) * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    return x


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of all texts in order, and where each text's words begin (and the last end)."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    lists = pc.ascii_split_whitespace(texts)
    flat, offsets = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
    full = pc.greater(pc.binary_length(flat), 0)
    before = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])
    return flat.filter(full), before[offsets - offsets[0]]


def word_hashes(flat: pa.Array, *seeds: int) -> list[np.ndarray]:
    """For each seed the 64-bit hashes of all words."""
    coded = flat.dictionary_encode()
    place, unique = coded.indices.to_numpy(), [w.encode("utf-8", "surrogatepass") for w in coded.dictionary.to_pylist()]
    return [np.fromiter((xxhash.xxh64_intdigest(w, s) for w in unique), np.uint64, len(unique))[place] for s in seeds]


def symbols(ids: np.ndarray, doc: np.ndarray, rounds: str = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``name, words, lo, hi`` after the rounds; ``lo:hi`` is the span that forming depends on.

    ``ids`` are the words' hashes, ``doc`` the texts they belong to. A symbol whose
    forming depends on where its text begins or ends gets a span that fits nowhere.
    """
    name, size = ids.copy(), np.ones(len(ids), np.int64)
    lo = np.arange(len(ids), dtype=np.int64)
    hi = lo + 1
    for k, kind in enumerate(rounds):
        if len(name) == 0:
            break
        near = doc[1:] == doc[:-1]
        left = np.concatenate([[-FAR], np.where(near, lo[:-1], -FAR)])  # as far as the left neighbour depends
        right = np.concatenate([np.where(near, hi[1:], FAR), [FAR]])
        if kind == "r":
            begins = np.concatenate([[True], ~(near & (name[1:] == name[:-1]))])
            first = np.flatnonzero(begins)
            last = np.concatenate([first[1:], [len(name)]]) - 1
            n = last - first + 1
            name = np.where(n > 1, mix(name[first], n, k + 1), name[first])
            size = np.add.reduceat(size, first)
            lo, hi, doc = np.minimum(lo[first], left[first]), np.maximum(hi[last], right[last]), doc[first]
        else:
            opens = mix(name, k, 0x5BD1) >> np.uint64(63) == 1
            pair = np.concatenate([near & opens[:-1] & ~opens[1:], [False]])
            second = np.concatenate([[False], pair[:-1]])
            alone = ~pair & ~second
            # a symbol alone depends on the neighbour that it might have paired with
            lo = np.where(alone & ~opens, np.minimum(lo, left), lo)
            hi = np.where(alone & opens, np.maximum(hi, right), hi)
            at = np.flatnonzero(pair)
            name[at] = mix(name[at], name[at + 1], k + 1)
            size[at] += size[at + 1]
            lo[at] = np.minimum(lo[at], lo[at + 1])
            hi[at] = np.maximum(hi[at], hi[at + 1])
            keep = ~second
            name, size, lo, hi, doc = name[keep], size[keep], lo[keep], hi[keep], doc[keep]
    return name, size, lo, hi


def counted(ids: np.ndarray, starts: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``name, lo, hi`` of the symbols that take part: long enough, and their span fits a window."""
    doc = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    name, size, lo, hi = symbols(ids, doc)
    use = (hi - lo <= span) & (size >= LEAST_WORDS)
    return name[use], lo[use], hi[use]


def window_hash(ids: np.ndarray, span: int) -> np.ndarray:
    """A hash of every ``span`` consecutive words (across texts too; callers leave those out)."""
    n = len(ids) - span + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total, offset, level, width = None, 0, ids, 1
    left = span
    while left:  # span's binary digits: blocks of 1, 2, 4 .. words
        if left & 1:
            block = level[offset : offset + n]
            total = block if total is None else mix(total, block, width)
            offset += width
        left >>= 1
        if left:
            level = mix(level[:-width], level[width:], 0)
            width *= 2
    return total


def window_starts(starts: np.ndarray, span: int) -> np.ndarray:
    """Which of all word positions begin a window within one text."""
    n = int(starts[-1])
    ends = np.repeat(starts[1:], np.diff(starts))
    return np.arange(n, dtype=np.int64) + span <= ends


def twice(values: np.ndarray) -> np.ndarray:
    """Values that occur more than once, sorted."""
    v = np.sort(values)
    same = v[1:] == v[:-1]
    return np.unique(v[1:][same])


def member(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Which values are in the sorted ``among``."""
    if len(among) == 0:
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(among, values), len(among) - 1)
    return among[at] == values


def names_in(batch: pa.Table, span: int) -> pa.Table:
    flat, starts = split_words(batch["text"].combine_chunks())
    name, _, _ = counted(word_hashes(flat, 1)[0], starts, span)
    name = np.unique(name).view(np.int64)
    return pa.table({"bucket": pa.array(np.full(len(name), batch["bucket"][0].as_py()), pa.int32()), "name": pa.array(name)})


def windows_in(batch: pa.Table, shared: pa.Table, span: int) -> pa.Table:
    """Each bucket's distinct windows all of whose symbols are shared."""
    schema = {"bucket": pa.int32(), "h": pa.int64(), "check": pa.int32()}
    if batch.num_rows == 0:
        return pa.table({k: pa.array([], t) for k, t in schema.items()})
    flat, starts = split_words(batch["text"].combine_chunks())
    ids, more = word_hashes(flat, 1, 2)
    name, lo, hi = counted(ids, starts, span)
    across = np.sort(shared["name"].to_numpy().view(np.uint64)) if shared.num_rows else np.zeros(0, np.uint64)
    single = ~(member(name, across) | member(name, twice(name)))
    change = np.zeros(len(ids) + 1, np.int64)
    np.add.at(change, np.maximum(hi[single] - span, 0), 1)
    np.add.at(change, lo[single] + 1, -1)
    at = np.flatnonzero(window_starts(starts, span) & (np.cumsum(change[:-1]) == 0))
    h, check = window_hash(ids, span)[at], window_hash(more, span)[at] >> np.uint64(33)
    order = np.lexsort((check, h))
    h, check = h[order], check[order]
    first = np.concatenate([[True], (h[1:] != h[:-1]) | (check[1:] != check[:-1])])[: len(h)]
    return pa.table({
        "bucket": pa.array(np.full(int(first.sum()), batch["bucket"][0].as_py()), pa.int32()),
        "h": pa.array(h[first].view(np.int64)), "check": pa.array(check[first].astype(np.int32)),
    })


def removed_in(batch: pa.Table, repeated: pa.Table, span: int, id_col: str) -> pa.Table:
    """Each text of the bucket without the words that repeated windows cover."""
    flat, starts = split_words(batch["text"].combine_chunks())
    ids, more = word_hashes(flat, 1, 2)
    at = np.flatnonzero(window_starts(starts, span))
    h, check = window_hash(ids, span)[at], (window_hash(more, span)[at] >> np.uint64(33)).astype(np.int64)
    known = np.zeros(len(at), bool)
    if repeated.num_rows:
        rh, rc = repeated["h"].to_numpy().view(np.uint64), repeated["check"].to_numpy().astype(np.int64)
        order = np.lexsort((rc, rh))
        rh, rc = rh[order], rc[order]
        place = np.searchsorted(rh, h)
        while True:  # once, and again only where one h has several checks
            inside = place < len(rh)
            hit = inside.copy()
            hit[inside] = rh[place[inside]] == h[inside]
            known[hit] |= rc[place[hit]] == check[hit]
            more_left = hit & ~known
            if not more_left.any():
                break
            place = np.where(more_left, place + 1, len(rh))
    order = np.argsort(h, kind="stable")
    if len(h):
        sh, sc = h[order], check[order]
        same = sh[1:] == sh[:-1]
        if (sc[1:][same] != sc[:-1][same]).any():
            order = np.lexsort((check, h))
            sh, sc = h[order], check[order]
            same = (sh[1:] == sh[:-1]) & (sc[1:] == sc[:-1])
        known[order[1:][same]] = True
        known[order[:-1][same]] = True
    change = np.zeros(len(ids) + 1, np.int64)
    change[at[known]] += 1
    np.subtract.at(change, at[known] + span, 1)
    keep = np.cumsum(change[:-1]) == 0
    upto = np.concatenate([[0], np.cumsum(keep)])
    lists = pa.LargeListArray.from_arrays(pa.array(upto[starts]), flat.filter(pa.array(keep)))
    n_words = np.diff(starts)
    return pa.table({
        id_col: batch[id_col], "n_words": pa.array(n_words), "n_removed": pa.array(n_words - np.diff(upto[starts])),
        "kept_text": pc.binary_join(lists, pa.scalar(" ", pa.large_string())).cast(pa.string()),
    })


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN) -> DataFrame:
    """Remove every word that a repeated window of ``span`` words covers.

    A window repeats if the same words start anywhere else, in the same text or in
    another. Returns for each row ``id_col, n_words, n_removed, kept_text`` (kept
    words joined by one space). A null text has no words. Rows repeated in full
    repeat each other's windows. Other columns are ignored.
    """
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    buckets = max(1, math.ceil(size / BUCKET_BYTES))
    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64(id_col, "text"), F.lit(buckets)).cast("int"))
    names = rows.groupBy("bucket").applyInArrow(lambda t: names_in(t, span), "bucket int, name long")
    shared = names.withColumn("n", F.count("*").over(Window.partitionBy("name"))).where("n > 1").select("bucket", "name")
    windows = rows.groupBy("bucket").cogroup(shared.groupBy("bucket")).applyInArrow(lambda t, s: windows_in(t, s, span), "bucket int, h long, check int")
    repeated = windows.withColumn("n", F.count("*").over(Window.partitionBy("h", "check"))).where("n > 1").select("bucket", "h", "check")
    schema = T.StructType([
        T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("n_words", T.LongType()),
        T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType()),
    ])
    return rows.groupBy("bucket").cogroup(repeated.groupBy("bucket")).applyInArrow(lambda t, r: removed_in(t, r, span, id_col), schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), p AS (
  SELECT doc_id, unnest(generate_series(1, len(ws) - 34)) AS i, ws FROM w WHERE len(ws) >= 35
), h AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY list_slice(ws, i, i + 34)) AS n FROM p
), bad AS (
  SELECT DISTINCT doc_id, i + k AS i FROM h, generate_series(0, 34) AS g(k) WHERE n > 1
), flat AS (
  SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS t, count(*) AS n FROM flat ANTI JOIN bad USING (doc_id, i) GROUP BY doc_id
)
SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""
