"""Exact deduplication by content-defined chunk recipes.

Every text is cut where a rolling hash of its bytes says so. A document's
recipe is the ordered list of its chunks' 128-bit identifiers. The identifiers
are verified: distinct chunks travel once, with their bytes, and each
identifier must stand for one byte string. Then only recipes are compared;
long texts move no further.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import row_key, table, text_digest, without, written

#: A cut falls on one byte in 2 ** CUT_BITS on average; chunks have MIN_BYTES to MAX_BYTES.
CUT_BITS, MIN_BYTES, MAX_BYTES = 11, 256, 16384
#: Texts are hashed in slices of about so many bytes, which bounds a worker's memory.
SLICE_BYTES = 2 << 20
WINDOW = 32
GEAR = np.random.default_rng(1).integers(0, 1 << 32, 256, dtype=np.uint32)


def cut_places(data: np.ndarray) -> np.ndarray:
    """Indexes of bytes after which the rolling hash of the last 32 bytes allows a cut."""
    h = GEAR[data]
    step = 1
    while step < WINDOW:  # the hash over 2 * step bytes from two hashes over step bytes
        h[step:] += h[:-step] << np.uint32(step)
        step *= 2
    return np.flatnonzero(h >> np.uint32(32 - CUT_BITS) == 0)


def chunk_ends(places: list[int], start: int, end: int) -> list[int]:
    """Ends of the chunks of one text that lies at ``start:end``."""
    ends = []
    for place in places:
        while place + 1 - start > MAX_BYTES:
            start += MAX_BYTES
            ends.append(start)
        if place + 1 - start >= MIN_BYTES:
            start = place + 1
            ends.append(start)
    while end - start > MAX_BYTES:
        start += MAX_BYTES
        ends.append(start)
    return [*ends, end] if end > start else ends


def chunked(texts: pa.Array) -> Iterator[list[memoryview]]:
    """The chunks of each text, in order; none for an empty or null text."""
    texts = pa.concat_arrays([pc.fill_null(texts, "")]).cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    view = memoryview(data if data is not None else b"")
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + SLICE_BYTES, "right")) - 1)
        base = int(offsets[first])
        places = cut_places(np.frombuffer(view[base : int(offsets[last])], np.uint8)) + base
        bounds = np.searchsorted(places, offsets[first : last + 1])
        for k in range(first, last):
            start = int(offsets[k])
            ends = chunk_ends(places[bounds[k - first] : bounds[k - first + 1]].tolist(), start, int(offsets[k + 1]))
            yield [view[a:b] for a, b in zip([start, *ends], ends)]
        first = last


def recipes(docs: DataFrame, id_col: str, text_col: str, seed: int, id_bytes: int) -> DataFrame:
    """``id_col, recipe, text_sha256``: the recipe is the chunks' identifiers one after the other."""
    kind = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            recipe, digest = [], []
            for chunks in chunked(batch.column(1)):
                recipe.append(b"".join(xxhash.xxh3_128_digest(c, seed)[:id_bytes] for c in chunks))
                sha = hashlib.sha256()
                for c in chunks:
                    sha.update(c)
                digest.append(sha.hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(recipe, pa.binary()), pa.array(digest, pa.string())],
                names=[id_col, "recipe", "text_sha256"],
            )

    schema = T.StructType([T.StructField(id_col, kind), T.StructField("recipe", T.BinaryType()), T.StructField("text_sha256", T.StringType())])
    return docs.select(id_col, text_col).mapInArrow(run, schema)


def chunk_table(docs: DataFrame, text_col: str, seed: int, id_bytes: int) -> DataFrame:
    """``chunk_id, chunk``: one row for each distinct chunk and identifier."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[bytes, bytes] = {}
            size = 0
            for chunks in chunked(batch.column(0)):
                for c in chunks:
                    key = xxhash.xxh3_128_digest(c, seed)[:id_bytes]
                    if seen.get(key) != c:
                        if key in seen or size > SLICE_BYTES:
                            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.binary())], names=["chunk_id", "chunk"])
                            seen, size = {}, 0
                        seen[key] = bytes(c)
                        size += len(c)
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.binary())], names=["chunk_id", "chunk"])

    return docs.select(text_col).mapInArrow(run, "chunk_id binary, chunk binary").distinct()


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", id_bytes: int = 16, max_tries: int = 8) -> DataFrame:
    """Groups of identical texts.

    Returns one row for each input row: ``id_col``, ``keep_id`` (the largest id
    of the group), ``group_size`` (rows), ``kept`` and ``text_sha256``.

    A null text counts as empty; all empty texts form one group. Rows repeated
    with one id are all returned and share ``kept``; a null id is kept only if
    the group has no other id. Other columns are ignored. If two different
    chunks share an identifier, everything is named anew with another seed; if
    that never succeeds, an error is raised.
    """
    for seed in range(max_tries):
        twice = chunk_table(docs, text_col, seed, id_bytes).groupBy("chunk_id").agg(F.count("*").alias("n")).where("n > 1")
        if twice.isEmpty():
            break
    else:
        raise RuntimeError("two different chunks share an identifier under every seed")
    named = written(recipes(docs, id_col, text_col, seed, id_bytes), "recipes")
    groups = named.groupBy("recipe").agg(F.max(id_col).alias("keep_id"), F.count("*").alias("group_size"))
    return named.join(groups, "recipe").select(
        id_col, "keep_id", "group_size", F.col(id_col).eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group of identical texts: that with the largest id.

    Rows are told apart by id and text, so ids that stand with several texts lose
    none; of rows repeated with both, one stays. Columns of any name pass through.
    """
    found = exact_dedup(docs).select(row_key(F.col("doc_id"), F.col("text_sha256")).alias("key"), "kept")
    return without(docs, row_key(F.col("doc_id"), text_digest(F.col("text"))), found)


SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""
