"""Phrase collocations from a bidirectional FM-index of every shard.

A shard is a run of texts of bounded size; its words are numbers, pieces end with
a separator. Two Burrows-Wheeler transforms, of the words and of the words
backwards, are kept to the depth of the longest phrase. A phrase is an interval in
both; extending it to the right by the next words divides its interval in the
backward index, extending it to the left that in the forward index, and the other
interval follows from the counts of smaller words. All phrases of one length
extend at once, to odd lengths on the left and to even ones on the right.

Shards give two-word phrases as hashes first. Spark adds these up; a hash whose
sum is below the least count is of no frequent phrase, whatever it collides with,
so leaving it out loses nothing. Each shard then gets back which of its phrases may
be frequent and extends only these; a longer phrase must have both its shorter
parts among them. So it goes for each length but the last, and then texts and
counts are added up exactly.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written
from .packing import pack, unpack
from .substring_dedup import mix, word_hashes

LONGEST, LEAST, COVERED, BEST = 3, 10, 50, 2000
#: Bytes of text that one shard takes (one text at least).
SHARD_BYTES = 8 << 20
#: 1 for blanks, 2 for what ends a piece; the rest is words.
KINDS = np.zeros(256, np.uint8)
KINDS[[0x20, 0x09]] = 1
KINDS[list(b".,;:!?\n\x0b\x0c\r")] = 2
EXACT = "decimal(38,0)"


@dataclass
class Shard:
    """``seq``: numbers of words from 1, 0 where pieces end; ``words, langs`` by number, from 0."""

    seq: np.ndarray
    words: pa.Array
    langs: pa.Array


def shard_of(langs: pa.Array, texts: pa.Array) -> Shard:
    """The words of the texts; equal words of different languages have different numbers."""
    texts = pc.ascii_lower(pc.fill_null(texts.cast(pa.large_string()), "")).cast(pa.large_binary())
    body = pc.binary_join(pa.LargeListArray.from_arrays(pa.array([0, len(texts)], pa.int64()), texts), pa.scalar(b"\n", pa.large_binary()))[0].as_py() + b"\n"
    data = np.frombuffer(body, np.uint8)
    kind = KINDS[data]
    letter = kind == 0
    edge = np.flatnonzero(np.diff(np.concatenate([[False], letter, [False]])))
    begin, end = edge[0::2], edge[1::2]
    breaks = np.cumsum(kind == 2, dtype=np.int32)
    ends = np.concatenate([np.diff(breaks[begin]) > 0, [True]])[: len(begin)]  # a piece ends behind the word
    starts = np.concatenate([[0], np.cumsum(pc.binary_length(texts).to_numpy() + 1)])
    lang = pc.fill_null(langs.cast(pa.large_string()), "und").dictionary_encode()
    of = np.repeat(lang.indices.to_numpy(), np.diff(np.searchsorted(begin, starts)))
    offsets = np.concatenate([[0], np.cumsum(end - begin)]).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(offsets), pa.py_buffer(data[letter])]).dictionary_encode()
    vocabulary = max(1, len(words.dictionary))
    pairs = of.astype(np.int64) * vocabulary + words.indices.to_numpy()
    seen = np.zeros(max(1, len(lang.dictionary)) * vocabulary, bool)
    seen[pairs] = True
    number = np.cumsum(seen, dtype=np.int32)
    seq = np.zeros(len(begin) + int(ends.sum()), np.int32)
    seq[np.arange(len(begin)) + np.concatenate([[0], np.cumsum(ends)[:-1]])[: len(begin)]] = number[pairs]
    own, word = np.divmod(np.flatnonzero(seen), vocabulary)
    return Shard(seq, words.dictionary.take(pa.array(word)).cast(pa.large_string()), lang.dictionary.take(pa.array(own)))


def packed_shard(s: Shard) -> bytes:
    langs = s.langs.dictionary_encode()
    one = lambda a: pa.LargeListArray.from_arrays(pa.array([0, len(a)], pa.int64()), a)
    return pack(pa.table({"seq": one(pa.array(s.seq)), "words": one(s.words), "langs": one(langs.indices), "names": one(langs.dictionary)}))


def unpacked_shard(blob: pa.ChunkedArray) -> Shard:
    t = unpack(blob).combine_chunks()
    one = lambda name: t[name].combine_chunks().flatten()
    return Shard(one("seq").to_numpy(), one("words"), one("names").take(one("langs")))


def shards(docs: DataFrame, lang_col: str, text_col: str, limit: int) -> DataFrame:
    """``shard, blob``: the shards of every task; a shard's number follows from its task and place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, held, size, made = TaskContext.get().partitionId(), [], 0, 0

        def out() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held).combine_chunks()
            blob = packed_shard(shard_of(rows[0].combine_chunks(), rows[1].combine_chunks()))
            return pa.RecordBatch.from_arrays([pa.array([(task << 32) + made], pa.int64()), pa.array([blob], pa.binary())], names=["shard", "blob"])

        for batch in batches:
            sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            at = 0
            while at < batch.num_rows:
                base = sizes[at - 1] if at else 0
                upto = max(at + (0 if held else 1), int(np.searchsorted(sizes, base + limit - size, "right")))
                if upto > at:
                    held.append(batch.slice(at, upto - at))
                    size += int(sizes[upto - 1] - base)
                at = upto
                if at < batch.num_rows:
                    yield out()
                    made, held, size = made + 1, [], 0
        if held:
            yield out()

    return docs.select(F.col(lang_col).cast("string"), F.col(text_col).cast("string")).mapInArrow(run, "shard long, blob binary")


def radix(order: np.ndarray, key: np.ndarray, width: int) -> np.ndarray:
    """``order``, stably sorted by ``key[order]`` (below ``2**width``): the key and the place share one number."""
    bits = max(1, int(len(order)).bit_length())
    both = key[order].astype(np.int64)
    both <<= bits
    both |= np.arange(len(order), dtype=np.int64)
    if width + bits > 62:  # the key alone is too wide to share
        return order[np.argsort(key[order], kind="stable")]
    both.sort()
    both &= (1 << bits) - 1
    return order[both]


class Side:
    """One direction of the index: rows in the order of the ``depth`` words from a place on, and the word before each."""

    def __init__(self, seq: np.ndarray, depth: int):
        width = int(seq.max(initial=0)).bit_length()
        order = np.arange(len(seq), dtype=np.int32)
        for k in reversed(range(depth)):
            order = radix(order, np.roll(seq, -k), width)
        self.bwt = np.roll(seq, 1)[order]
        by = radix(np.arange(len(seq), dtype=np.int32), self.bwt, width)
        self.lf = np.empty(len(seq), np.int32)
        self.lf[by] = np.arange(len(seq), dtype=np.int32)  # where a row's predecessor lies


@dataclass
class Level:
    """All phrases of one length: their words, intervals in both indexes, and counts."""

    words: np.ndarray
    lo: np.ndarray
    lo_back: np.ndarray
    n: np.ndarray

    def take(self, which: np.ndarray) -> Level:
        return Level(self.words[which], self.lo[which], self.lo_back[which], self.n[which])


def covered(lo: np.ndarray, n: np.ndarray, total: int) -> np.ndarray:
    """Which of ``total`` rows lie in one of the intervals."""
    change = np.zeros(total + 1, np.int32)
    np.add.at(change, lo, 1)
    np.subtract.at(change, lo + n, 1)
    return np.cumsum(change[:-1]) > 0


class Index:
    """Both directions of the index, for phrases of up to ``longest`` words."""

    def __init__(self, seq: np.ndarray, longest: int):
        self.seq, self.longest, self.sides = seq, longest, {}

    def side(self, left: bool) -> Side:
        """The index that extends to the left reads forwards, the other backwards; it is sorted as deep as the phrases that it extends are long."""
        if left not in self.sides:
            depth = self.longest - 1 if (self.longest % 2 == 1) == left else self.longest - 2
            self.sides[left] = Side(self.seq if left else self.seq[::-1], max(1, depth))
        return self.sides[left]

    def words(self) -> Level:
        counts = np.bincount(self.seq, minlength=1)
        begin = np.cumsum(counts) - counts
        word = np.flatnonzero(counts)
        word = word[word > 0]
        return Level(word[:, None].astype(np.int32), begin[word], begin[word], counts[word])

    def extended(self, level: Level, known: Level | None) -> Level:
        """The phrases one word longer; with ``known`` only those whose other part (without the word at the far end) is in it."""
        left = level.words.shape[1] % 2 == 0
        side = self.side(left)
        lo, other = (level.lo, level.lo_back) if left else (level.lo_back, level.lo)
        before = np.concatenate([[0], np.cumsum(level.n)])
        owner = np.repeat(np.arange(len(level.n), dtype=np.int32), level.n)
        rows = np.repeat((lo - before[:-1]).astype(np.int32), level.n)
        rows += np.arange(len(rows), dtype=np.int32)
        wide = int(self.seq.max(initial=0)).bit_length()
        key = owner.astype(np.int64) << wide
        key |= side.bwt[rows]
        order = radix(np.arange(len(rows), dtype=np.int32), key, wide + len(level.n).bit_length())
        key, rows = key[order], rows[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])[: len(rows)])
        n = np.diff(np.concatenate([first, [len(rows)]]))
        own, new = key[first] >> wide, (key[first] & ((1 << wide) - 1)).astype(np.int32)
        lo, other = side.lf[rows[first]].astype(np.int64), other[own] + first - before[own]  # smaller words come before
        keep = new > 0
        if known is not None and len(keep):
            at = (known.lo if left else known.lo_back), known.n
            keep &= covered(*at, len(self.seq))[lo]
        own, new, lo, other, n = own[keep], new[keep, None], lo[keep], other[keep], n[keep]
        words = np.concatenate([new, level.words[own]] if left else [level.words[own], new], axis=1)
        return Level(words, lo if left else other, other if left else lo, n)


def levels(shard: Shard, marks: dict[int, np.ndarray], longest: int) -> Iterator[Level]:
    """The phrases of 1 to ``longest`` words; those of a marked length are left out but for the marked ones, and only these are extended."""
    index = Index(shard.seq, longest)
    level = index.words()
    yield level
    known = None
    for k in range(2, longest + 1):
        level = index.extended(level, known)
        if k in marks:
            level = known = level.take(marks[k])
        yield level


def word_keys(words: pa.Array) -> np.ndarray:
    """A 64-bit number of each (never empty) word: a polynomial of its bytes. Words may share one; sums only grow by that."""
    offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    if len(words) == 0:
        return np.zeros(0, np.uint64)
    data, starts, size = np.frombuffer(words.buffers()[2], np.uint8)[offsets[0] : offsets[-1]], offsets[:-1] - offsets[0], np.diff(offsets)
    power = np.cumprod(np.full(size.max(), 0x9E3779B97F4A7C15, np.uint64))
    return np.add.reduceat((data.astype(np.uint64) + np.uint64(1)) * power[np.arange(len(data)) - np.repeat(starts, size)], starts)


def hashes(shard: Shard, level: Level) -> np.ndarray:
    """A 64-bit hash of each phrase and its language."""
    word = word_keys(shard.words)
    out = word_hashes(shard.langs, 2)[0][level.words[:, 0] - 1]
    for k in range(level.words.shape[1]):
        out = mix(out, word[level.words[:, k] - 1], k + 1)
    return out.view(np.int64)


def phrases(shard: Shard, level: Level) -> tuple[pa.Array, pa.Array]:
    """``lang, phrase`` of each phrase."""
    part = [shard.words.take(pa.array(level.words[:, k] - 1)) for k in range(level.words.shape[1])]
    return shard.langs.take(pa.array(level.words[:, 0] - 1)).cast(pa.string()), pc.binary_join_element_wise(*part, pa.scalar(" ", pa.large_string())).cast(pa.string()) if len(part) > 1 else part[0].cast(pa.string())


HASHED = "h long, shard long, node int, n long"
COUNTED = "lang string, k int, phrase string, n long"


def hashed(shard: Shard, number: int, marks: dict[int, np.ndarray], k: int) -> pa.Table:
    """HASHED for the phrases of ``k`` words; ``node`` is a phrase's place among them."""
    *_, level = levels(shard, marks, k)
    n = len(level.n)
    return pa.table({"h": pa.array(hashes(shard, level)), "shard": pa.array(np.full(n, number)), "node": pa.array(np.arange(n), pa.int32()), "n": pa.array(level.n.astype(np.int64))})


def counted(shard: Shard, marks: dict[int, np.ndarray], longest: int) -> pa.Table:
    """COUNTED for all words and the phrases that ``levels`` gives."""
    parts = []
    for k, level in enumerate(levels(shard, marks, longest), 1):
        lang, phrase = phrases(shard, level)
        parts.append(pa.table({"lang": lang, "k": pa.array(np.full(len(phrase), k), pa.int32()), "phrase": phrase, "n": pa.array(level.n.astype(np.int64))}))
    return pa.concat_tables(parts)


def marks_of(marked: pa.Table, lengths: range) -> dict[int, np.ndarray]:
    k, node = marked["k"].to_numpy(), marked["node"].to_numpy()
    return {x: np.sort(node[k == x]) for x in lengths}


def reaching(rows: DataFrame, least: int) -> DataFrame:
    """``shard, node`` of the rows whose hash reaches ``least`` in all.

    Rows come sorted by hash. Of the last one in a batch only rows are held back
    whose sum is still too small, so less than ``least`` of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, passed = None, None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = pa.concat_tables([held, t]).combine_chunks() if held is not None else t
            if not t.num_rows:
                continue
            h, n = t["h"].to_numpy(), t["n"].to_numpy()
            first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            ok = np.add.reduceat(n, first) >= least
            ok[0] |= passed is not None and h[0] == passed
            size = np.diff(np.concatenate([first, [len(h)]]))
            passed = h[-1] if ok[-1] else None
            held = None if ok[-1] else t.slice(int(first[-1]))
            yield from t.filter(pa.array(np.repeat(ok, size))).select(["shard", "node"]).to_batches()

    return rows.repartition("h").sortWithinPartitions("h").mapInArrow(run, "shard long, node int")


def frequent(docs: DataFrame, lang_col: str, text_col: str, longest: int, least: int, limit: int) -> DataFrame:
    """``lang, k, phrase, n``: exact counts of all words, and of the phrases of 2 to ``longest`` words that occur ``least`` times."""
    made = written(shards(docs, lang_col, text_col, limit), "phrases-shards")

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                yield from hashed(unpacked_shard(pa.chunked_array([pa.array([blob.as_py()], pa.binary())])), number, {}, 2).to_batches(1 << 16)

    def with_marks(k: int, give: Callable) -> Callable:
        return lambda key, own, marks: give(unpacked_shard(own["blob"]), key[0].as_py(), marks_of(marks, range(2, k)))

    marked = made.select(F.lit(0).cast("long").alias("shard"), F.lit(0).alias("k"), F.lit(0).alias("node")).limit(0)
    for k in range(2, longest):
        if k == 2:
            rows = made.mapInArrow(pairs, HASHED)
        else:
            rows = made.groupBy("shard").cogroup(marked.groupBy("shard")).applyInArrow(with_marks(k, lambda s, number, marks, k=k: hashed(s, number, marks, k)), HASHED)
        marked = marked.unionByName(written(reaching(rows, least).select("shard", F.lit(k).alias("k"), "node"), "phrases-marked"))
    counts = made.groupBy("shard").cogroup(marked.groupBy("shard")).applyInArrow(with_marks(longest, lambda s, _, marks: counted(s, marks, longest)), COUNTED)
    sums = counts.groupBy("lang", "k", "phrase").agg(F.sum("n").alias("n"))
    return sums.where((F.col("k") == 1) | (F.col("n") >= least))


def collocations(
    docs: DataFrame, lang_col: str = "lang", text_col: str = "text", longest: int = LONGEST, least: int = LEAST, covered_share: int = COVERED, best: int = BEST,
    shard_bytes: int = SHARD_BYTES,
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the ``best`` phrases of each language.

    Texts are lower-cased (A-Z), split into pieces at ``.,;:!?`` and line ends, and
    those into words at blanks and tabs. Candidates have 2 to ``longest`` words and occur
    ``least`` times. A null text has no words, a null language is ``und``; a language
    without a candidate has no row. Repeated rows count each. Other columns are ignored.
    """
    counts = written(frequent(docs, lang_col, text_col, longest, least, shard_bytes), "phrases-counts")
    total = counts.where("k = 1").groupBy("lang").agg(F.sum("n").alias("n"))
    candidates = counts.where("k > 1").withColumnRenamed("n", "a")
    parts = F.split("phrase", " ")
    # what a longer candidate covers, each contained phrase by the largest count
    inner = [
        candidates.where(F.col("k") > size).select("lang", F.explode(F.transform(F.sequence(F.lit(1), F.col("k") - size + 1), lambda i: F.array_join(F.slice(parts, i, size), " "))).alias("phrase"), "a")
        for size in range(2, longest)
    ]
    kept = candidates
    if inner:
        most = reduce(DataFrame.unionByName, inner).groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
        kept = candidates.join(most, ["lang", "phrase"], "left").where((100 * F.coalesce("longer", F.lit(0)) < covered_share * F.col("a"))).drop("longer")
    cuts = kept.select("lang", "phrase", "a", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.select("*", F.array_join(F.slice(parts, F.lit(1), F.col("cut")), " ").alias("first"), F.array_join(F.slice(parts, F.col("cut") + 1, F.size(parts)), " ").alias("rest"))
    part = counts.select("lang", "phrase", "n")
    cuts = cuts.join(part.select("lang", F.col("phrase").alias("first"), F.col("n").alias("l")), ["lang", "first"])
    cuts = cuts.join(part.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r")), ["lang", "rest"])
    # counts below 10**15, so no product passes 38 digits
    exact = lambda c: F.col(c).cast("decimal(15,0)")
    cuts = cuts.withColumn("above", (F.lit(1000000).cast("decimal(7,0)") * exact("a") * exact("a")).cast(EXACT)).withColumn("below", (exact("l") * exact("r")).cast(EXACT))
    cuts = cuts.withColumn("score", F.expr("above div below"))
    lowest = F.min_by(F.struct("l", "r", "score"), F.struct("score", "cut")).alias("x")
    scored = cuts.groupBy("lang", "phrase", "a").agg(lowest).select("lang", "phrase", "a", "x.*")
    first = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = scored.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= best)
    return ranked.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = collocations(table(spark, sf_dir, "documents"))
    return found.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


SQL = f"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents
), w AS (
  SELECT lang, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS ws FROM p
), g AS (
  SELECT lang, k, unnest(list_transform(generate_series(1, len(ws) - k + 1), lambda i: list_slice(ws, i, i + k - 1))) AS ws
  FROM w, generate_series(1, {LONGEST}) AS s(k) WHERE len(ws) >= k
), f AS MATERIALIZED (
  SELECT lang, k, array_to_string(ws, ' ') AS phrase, any_value(ws) AS ws, count(*) AS a FROM g GROUP BY lang, k, array_to_string(ws, ' ')
), c AS MATERIALIZED (
  SELECT * FROM f WHERE k > 1 AND a >= {LEAST}
), longer AS (
  SELECT c.lang, array_to_string(list_slice(c.ws, i, i + s.k - 1), ' ') AS phrase, max(a) AS longer
  FROM c, generate_series(2, {LONGEST}) AS s(k), generate_series(1, {LONGEST}) AS o(i) WHERE s.k < c.k AND i + s.k - 1 <= c.k GROUP BY 1, 2
), cut AS (
  SELECT c.lang, c.phrase, c.a, i, f1.a AS l, f2.a AS r, 1000000 * c.a::HUGEINT * c.a::HUGEINT // (f1.a::HUGEINT * f2.a::HUGEINT) AS score
  FROM c LEFT JOIN longer USING (lang, phrase), generate_series(1, {LONGEST - 1}) AS o(i), f f1, f f2
  WHERE i < c.k AND 100 * coalesce(longer, 0) < {COVERED} * c.a
    AND f1.lang = c.lang AND f1.k = i AND f1.phrase = array_to_string(list_slice(c.ws, 1, i), ' ')
    AND f2.lang = c.lang AND f2.k = c.k - i AND f2.phrase = array_to_string(list_slice(c.ws, i + 1, c.k), ' ')
), best AS (
  SELECT lang, phrase, a, arg_min({{'l': l, 'r': r, 'score': score}}, (score, i)) AS x FROM cut GROUP BY lang, phrase, a
), total AS (SELECT lang, sum(a) AS n FROM f WHERE k = 1 GROUP BY lang
), ranked AS (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY x.score DESC, a DESC, phrase) AS rank, phrase, a, x.l AS l, x.r AS r, x.score::BIGINT AS score FROM best
)
SELECT lang, rank, phrase, a, l, r, n::BIGINT AS n, score FROM ranked JOIN total USING (lang) WHERE rank <= {BEST}
"""
