"""SentencePiece encoding and decoding as a relational lattice.

Texts fall into words (a word keeps the space before it); no piece crosses from
one word into the next, nor two characters that no piece has side by side, so
words are cut there into units. Every distinct unit is encoded once: its
substrings up to the longest piece are exploded and equi-joined to the piece
table, the joined edges are grouped by unit, and a fold over them gives the
pieces. For a unigram model the fold is Viterbi's. A byte-pair model (the public
one here) orders merges by score instead of summing scores, so there the fold
takes the edges by score and joins those whose two halves stand; Viterbi would
give other pieces.

Documents are dealt into buckets, and a bucket asks for each of its units once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table
from .packing import pack, packed, packed_by, split_by, unpack

SPACE = "▁"
#: Bytes of text in a bucket, whose texts one task reads at once, and in a part, whose distinct units are asked for at once.
BUCKET_BYTES, PART_BYTES = 8 << 20, 64 << 20
#: Words whose ids a task assembles at once.
SLICE_WORDS = 1 << 17
#: A unit's cuts are bits of one long up to SHORT characters, and of several longs of BLOCK bits beyond.
SHORT, BLOCK = 61, 31


@dataclass(frozen=True)
class Model:
    """A piece table: what encoding and decoding need of a tokenizer's file."""

    pieces: tuple[str, ...]
    scores: tuple[float, ...]
    plain: tuple[bool, ...]  # pieces that stand for their text
    first_byte: int  # id of the piece for byte 0; -1 without byte pieces
    unknown: int
    kind: str  # bpe or unigram


def default_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("piece_bpe_32k.model"))


@lru_cache(maxsize=4)
def load(path: str) -> Model:
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(sp.get_piece_size())
    plain = tuple(not (sp.is_control(i) or sp.is_byte(i) or sp.is_unknown(i) or sp.is_unused(i)) for i in ids)
    scores = tuple(sp.get_score(i) for i in ids)
    merges = [s for s, p in zip(scores, plain) if p]
    # a byte-pair model's scores are its merges' ranks, whole numbers that go down by one
    kind = "bpe" if all(s == int(s) for s in merges[:1000]) else "unigram"
    first = next((i for i in ids if sp.is_byte(i)), -1)
    return Model(tuple(map(sp.id_to_piece, ids)), scores, plain, first, sp.unk_id(), kind)


class Joints:
    """Which two characters some piece has side by side."""

    def __init__(self, model: Model):
        pairs = sorted({p[k : k + 2] for p, ok in zip(model.pieces, model.plain) if ok for k in range(len(p) - 1)})
        chars = sorted({c for p in pairs for c in p})
        self.code = np.zeros(ord(chars[-1]) + 2 if chars else 1, np.uint16 if len(chars) < 65535 else np.int32)  # 0 and the last: in no pair
        self.code[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.met = np.zeros((len(chars) + 1, len(chars) + 1), bool)
        for a, b in pairs:
            self.met[self.code[ord(a)], self.code[ord(b)]] = True


def strings(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a large string array, and where each string begins in them (and the last ends)."""
    offsets = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values) + 1]
    data = values.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def words_in(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """``place, words, starts``: the texts' words as indexes into the distinct words, and where each text begins.

    A word is its spaces (as ``SPACE``, one more before the text) and what follows
    them; an empty text has none.
    """
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if pc.any(pc.match_substring(texts, SPACE)).as_py():
        texts = pc.replace_substring(texts, SPACE, " ")
    lists = pc.split_pattern(texts, " ")
    starts, flat = lists.offsets.to_numpy().astype(np.int64), lists.flatten()
    starts -= starts[0]
    coded = flat.dictionary_encode()
    place = coded.indices.to_numpy().astype(np.int64)
    words = pc.binary_join_element_wise(pa.scalar(SPACE, pa.large_string()), coded.dictionary, pa.scalar("", pa.large_string()))
    empty = pc.equal(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    if not empty.any():
        return place, words, starts
    # an empty token is one more space for the token behind it; at the end of a text it is a word of spaces
    first, last = np.zeros(len(flat), bool), np.zeros(len(flat), bool)
    first[starts[:-1]] = last[starts[1:] - 1] = True
    ends = (~empty | last) & ~(empty & first & last)
    at = np.arange(len(flat))
    back = np.concatenate([[0], np.maximum.accumulate(np.where(~empty | first, at, 0))[:-1]])
    more = np.where(first, 0, at - back - ~empty[back])[ends]
    own = place[ends]
    many = np.flatnonzero(more)
    if len(many):
        kinds, which = np.unique(np.stack([own[many], more[many]]), axis=1, return_inverse=True)
        spaced = [SPACE * n + words[k].as_py() for k, n in kinds.T.tolist()]
        own[many] = len(words) + which.ravel()
        words = pa.concat_arrays([words, pa.array(spaced, pa.large_string())])
    return own, words, np.concatenate([[0], np.cumsum(ends)])[starts]


def cut(words: pa.Array, joints: Joints) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """``place, units, starts``: the words' units as indexes into the distinct units, and where each word begins.

    A word is cut between two characters that no piece has side by side.
    """
    raw, offsets = strings(words)
    lead = (raw & 0xC0) != 0x80
    chars = np.frombuffer(raw.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = joints.code[np.minimum(chars, len(joints.code) - 1)]
    begins = np.ones(len(chars), bool)
    begins[1:] = ~joints.met[codes[:-1], codes[1:]]
    word_begins = np.concatenate([[0], np.cumsum(lead)])[offsets]
    begins[word_begins[:-1]] = True
    ends = np.append(np.flatnonzero(lead)[begins], len(raw)).astype(np.int64)
    coded = pa.LargeStringArray.from_buffers(len(ends) - 1, pa.py_buffer(ends), pa.py_buffer(raw)).dictionary_encode()
    return coded.indices.to_numpy(), coded.dictionary, np.concatenate([[0], np.cumsum(begins)])[word_begins]


def unit_hash(units: pa.Array) -> np.ndarray:
    """A 64-bit hash of each string of a large string array."""
    raw, offsets = strings(units)
    if len(units) == 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        within = (np.arange(len(raw)) - np.repeat(offsets[:-1], np.diff(offsets))).astype(np.uint64)
        x = (raw.astype(np.uint64) + within * np.uint64(257) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
        h = np.add.reduceat(x ^ (x >> np.uint64(29)), offsets[:-1])
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def dealt(units: pa.Array, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """``order, part``: distinct units by part and hash, which a bucket finds again from its texts, and their parts."""
    h = unit_hash(units)
    part = (h >> np.uint64(33)).astype(np.int64) % parts
    order = np.lexsort((h, part))
    if (h[order][1:] == h[order][:-1]).any():  # units of one hash go by their text
        by_text = pc.sort_indices(units).to_numpy().astype(np.int64)
        order = by_text[np.lexsort((h[by_text], part[by_text]))]
    return order, part[order]


def units_in(batch: pa.Table, joints: Joints, parts: int) -> pa.Table:
    """The distinct units of a bucket, packed by part."""
    _, words, _ = words_in(unpack(batch["blob"])["text"].combine_chunks())
    _, units, _ = cut(words, joints)
    order, part = dealt(units, parts)
    found = list(split_by(pa.table({"unit": units.take(pa.array(order))}), part))
    return pa.table({
        "part": pa.array([k for k, _ in found], pa.int32()), "bucket": pa.array([batch["bucket"][0].as_py()] * len(found), pa.int32()),
        "blob": pa.array([pack(t) for _, t in found], pa.binary()),
    })


def distinct_units(batch: pa.Table) -> pa.Table:
    """The distinct units of a part."""
    return pa.table({"unit": pc.unique(unpack(batch["blob"])["unit"].combine_chunks()).cast(pa.string())})


def answers_to(asked: pa.Table, coded: pa.Table, kind: pa.DataType) -> pa.Table:
    """For each bucket that asked this part: the ids of its units in the order asked, packed."""
    empty = pa.table({"bucket": pa.array([], pa.int32()), "part": pa.array([], pa.int32()), "blob": pa.array([], pa.binary())})
    if asked.num_rows == 0:
        return empty
    known = unpack(coded["blob"])
    lists = known["ids"].combine_chunks().cast(pa.list_(kind))
    wanted = [pa.ipc.open_stream(b.as_buffer()).read_all()["unit"].combine_chunks() for b in asked["blob"]]
    place = pc.index_in(pa.concat_arrays(wanted), value_set=known["unit"].combine_chunks().cast(pa.large_string()))
    blobs, at = [], 0
    for own in wanted:
        blobs.append(pack(pa.table({"ids": lists.take(place.slice(at, len(own)))})))
        at += len(own)
    return pa.table({"bucket": asked["bucket"], "part": asked["part"], "blob": pa.array(blobs, pa.binary())})


@lru_cache(maxsize=4)
def late(model: Model) -> frozenset[str]:
    """Pieces that do not score below all merges from which they arise.

    While nothing merges across its borders, a piece arises in a text as it does
    alone. So if a unit has no late piece, a merge never brings up another one that
    should have come before it, and one pass over the edges by score makes all merges.
    """
    rank = {p: s for p, s, ok in zip(model.pieces, model.scores, model.plain) if ok}
    found = set()
    for piece in rank:
        parts, least = list(piece), math.inf
        while len(parts) > 1:
            joins = [(-rank[a + b], k) for k, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in rank]
            if not joins:
                break
            cost, k = min(joins)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
            if len(parts) == 1 and -cost >= least:
                found.add(piece)
            least = min(least, -cost)
    return frozenset(found)


def bound(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


class Cuts:
    """The cuts of a unit that still stand, as bits: of one long, or of an array of longs with BLOCK bits each."""

    def __init__(self, n: Column, short: bool):
        self.short = short
        full = F.lit((1 << BLOCK) - 1).cast("long")
        self.start = F.expr("shiftleft(1L, n + 1) - 1") if short else F.transform(F.sequence(F.lit(0), F.floor(n / BLOCK) + 1), lambda _: full)

    def near(self, m: Column, e: Column) -> Column:
        if self.short:
            return m
        low, high = F.element_at(m, e["block"] + 1), F.element_at(m, e["block"] + 2)
        return low.bitwiseOR(F.shiftleft(high, BLOCK))

    def ends(self, m: Column, e: Column) -> Column:
        return self.near(m, e).bitwiseAND(e["ends"]) == e["ends"]

    def joins(self, m: Column, e: Column) -> Column:
        """Its ends stand and one cut between them."""
        return (F.bit_count(self.near(m, e).bitwiseAND(e["inner"])) == 1) & self.ends(m, e)

    def stands(self, m: Column, e: Column) -> Column:
        """Its ends stand and nothing between them."""
        return (self.near(m, e).bitwiseAND(e["inner"]) == 0) & self.ends(m, e)

    def merged(self, m: Column, e: Column) -> Column:
        if self.short:
            return m.bitwiseAND(F.bitwise_not(e["inner"]))
        low, high = F.bitwise_not(e["inner"]), F.bitwise_not(F.shiftright(e["inner"], BLOCK))
        return F.transform(m, lambda x, k: F.when(k == e["block"], x.bitwiseAND(low)).when(k == e["block"] + 1, x.bitwiseAND(high)).otherwise(x))


def merge_fold(n: Column, edges: Column, ordered: bool, short: bool) -> Column:
    """The edges that are left when no two neighbours make a piece.

    ``edges`` come by score, then from the left. Without late pieces (``ordered``) one
    pass makes all merges; otherwise each step makes the first that can be made.
    """
    cuts = Cuts(n, short)
    if ordered:
        last = F.aggregate(edges, cuts.start, lambda m, e: F.when(cuts.joins(m, e), cuts.merged(m, e)).otherwise(m))
    else:

        def step(m: Column, _: Column) -> Column:
            first = F.try_element_at(F.filter(edges, lambda e: cuts.joins(m, e)), F.lit(1))
            return bound(first, lambda e: F.when(e.isNull(), m).otherwise(cuts.merged(m, e)))

        last = F.aggregate(F.sequence(F.lit(1), n), cuts.start, step)
    return bound(last, lambda m: F.filter(edges, lambda e: cuts.stands(m, e)))


def viterbi_fold(n: Column, edges: Column, floor: float) -> Column:
    """The edges of the path of best score sum; a character without a piece costs ``floor``."""
    start = F.array(F.struct(F.lit(0.0).alias("score"), F.lit(0).alias("s")))

    def step(best: Column, e: Column) -> Column:
        into = F.filter(edges, lambda x: x["e"] == e)
        ways = F.transform(into, lambda x: F.struct((F.element_at(best, x["s"] + 1)["score"] - x["cost"]).alias("score"), (-x["s"]).alias("s")))
        alone = F.array(F.struct((F.element_at(best, e)["score"] + F.lit(floor)).alias("score"), (1 - e).alias("s")))
        return F.concat(best, F.array(F.array_max(F.when(F.exists(into, lambda x: x["s"] == e - 1), ways).otherwise(F.concat(ways, alone)))))

    def back(cuts: Column, e: Column, best: Column) -> Column:
        return F.when(F.element_at(cuts, -1) == e, F.concat(cuts, F.array(-F.element_at(best, e + 1)["s"]))).otherwise(cuts)

    best = F.aggregate(F.sequence(F.lit(1), n), start, step)
    cuts = bound(best, lambda b: F.aggregate(F.reverse(F.sequence(F.lit(1), n)), F.array(n), lambda c, e: back(c, e, b)))
    steps = bound(cuts, lambda c: F.zip_with(F.slice(c, 2, n), F.slice(c, 1, F.size(c) - 1), lambda s, e: F.struct(s.alias("s"), e.alias("e"))))
    return bound(steps, lambda p: F.filter(edges, lambda x: F.array_contains(p, F.struct(x["s"].alias("s"), x["e"].alias("e")))))


def lattice(units: DataFrame, model: Model) -> DataFrame:
    """``unit, n, late, edges``: each unit's substrings that are pieces, by score, then from the left; ``late`` if one is late."""
    behind = late(model) if model.kind == "bpe" else frozenset()
    rows = [(p, i, -float(s), p in behind) for i, (p, s, ok) in enumerate(zip(model.pieces, model.scores, model.plain)) if ok]
    longest = max(len(r[0]) for r in rows)
    if longest > BLOCK:
        raise ValueError(f"pieces of more than {BLOCK} characters")
    table_ = units.sparkSession.createDataFrame(pa.table({k: list(v) for k, v in zip(("piece", "id", "cost", "late"), zip(*rows))}))
    # a long unit is read in blocks, so that its substrings are not sought from its beginning
    whole = "array(named_struct('block', 0, 'text', unit))"
    blocks = f"transform(sequence(0, (n - 1) div {BLOCK}), k -> named_struct('block', int(k), 'text', substring(unit, int(k) * {BLOCK} + 1, {BLOCK + longest - 1})))"
    read = units.selectExpr("unit", "length(unit) AS n").selectExpr("unit", "n", f"explode(IF(n <= {SHORT}, {whole}, {blocks})) AS x")
    read = read.selectExpr("unit", "n", "x.block", "x.text", f"explode(sequence(0, least(length(x.text), IF(n <= {SHORT}, {SHORT}, {BLOCK})) - 1)) AS a")
    read = read.selectExpr("unit", "n", "block", "text", "a", f"explode(sequence(a + 1, least(length(text), a + {longest}))) AS z")
    read = read.selectExpr("unit", "n", "block", "a", "z", "substring(text, a + 1, z - a) AS piece")
    # the piece table has as many rows as the model's vocabulary; the join is outer and each unit's first character
    # stays, so that units of unknown characters stay
    met = read.join(F.broadcast(table_), "piece", "left").where("id IS NOT NULL OR block = 0 AND a = 0 AND z = 1")
    edge = f"""IF(id IS NULL, NULL, named_struct('cost', cost, 's', block * {BLOCK} + a, 'e', block * {BLOCK} + z, 'id', int(id), 'block', block,
               'ends', shiftleft(1L, a) | shiftleft(1L, z), 'inner', shiftleft(shiftleft(1L, z - a - 1) - 1, a + 1)))"""
    return met.groupBy("unit", "n").agg(F.coalesce(F.bool_or("late"), F.lit(False)).alias("late"), F.sort_array(F.collect_list(F.expr(edge))).alias("edges"))


def encode_units(units: DataFrame, model: Model) -> DataFrame:
    """``unit, ids`` for each distinct unit by the lattice."""
    n, edges = F.col("n"), F.col("edges")
    if model.kind == "bpe":
        by_length = lambda ordered: F.when(n <= SHORT, merge_fold(n, edges, ordered, True)).otherwise(merge_fold(n, edges, ordered, False))
        chosen = F.when(~F.col("late"), by_length(True)).otherwise(by_length(False))
    else:
        chosen = viterbi_fold(n, edges, min(s for s, ok in zip(model.scores, model.plain) if ok) - 10)

    def spelled(k: Column) -> Column:
        """The ids of a character that no piece stands for."""
        if model.first_byte < 0:
            return F.array(F.lit(model.unknown))
        raw = F.hex(F.encode(F.substring(F.col("unit"), k + 1, F.lit(1)), "utf-8"))
        return F.transform(F.sequence(F.lit(1), F.length(raw), F.lit(2)), lambda j: F.conv(F.substring(raw, j, F.lit(2)), 16, 10).cast("int") + model.first_byte)

    def ids_of(kept: Column) -> Column:
        covered = F.aggregate(kept, F.lit(0), lambda a, x: a + x["e"] - x["s"]) == n
        plain = F.transform(F.sort_array(F.transform(kept, lambda x: F.struct(x["s"], x["id"]))), lambda x: x["id"])
        other = F.filter(F.sequence(F.lit(0), n - 1), lambda k: ~F.exists(kept, lambda x: (x["s"] <= k) & (k < x["e"])))
        each = F.concat(
            F.transform(kept, lambda x: F.struct(x["s"].alias("s"), F.array(x["id"]).alias("ids"))), F.transform(other, lambda k: F.struct(k.alias("s"), spelled(k).alias("ids")))
        )
        return F.when(covered, plain).otherwise(F.flatten(F.transform(F.sort_array(each), lambda x: x["ids"])))

    return lattice(units, model).select("unit", bound(chosen, ids_of).alias("ids"))


def gather(values: np.ndarray, starts: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lists ``chosen`` of a ragged array (``values`` cut at ``starts``) one after the other, and their lengths."""
    n = (starts[1:] - starts[:-1])[chosen]
    before = np.cumsum(n) - n
    return values[np.repeat(starts[chosen] - before, n) + np.arange(n.sum())], n


def piece_bytes(model: Model) -> list[bytes]:
    """The bytes that each id stands for; control and unknown ids have none."""
    first = model.first_byte
    return [
        p.replace(SPACE, " ").encode() if ok else bytes([i - first]) if first >= 0 and 0 <= i - first < 256 else b"" for i, (p, ok) in enumerate(zip(model.pieces, model.plain))
    ]


def decoded_texts(ids: np.ndarray, offsets: np.ndarray, parts: pa.Array) -> pa.Array:
    """The texts of id lists one after the other, cut at ``offsets``."""
    lists = pa.LargeListArray.from_arrays(pa.array(offsets, pa.int64()), parts.take(pa.array(ids)))
    texts = (t.as_py().decode("utf-8", "replace") for t in pc.binary_join(lists, pa.scalar(b"", pa.large_binary())))
    return pa.array([t[1:] if t.startswith(" ") else t for t in texts], pa.string())


def assemble(batch: pa.Table, answers: pa.Table, model: Model, joints: Joints, parts: int, id_col: str, decoding: bool) -> pa.Table:
    """The ids of every text of a bucket, from its units' ids; and, if asked for, their decoded text."""
    rows = unpack(batch["blob"])
    place, words, starts = words_in(rows["text"].combine_chunks())
    word_units, units, word_starts = cut(words, joints)
    order, _ = dealt(units, parts)
    known = unpack(answers.sort_by("part")["blob"]) if answers.num_rows else None
    lists = known["ids"].combine_chunks() if known is not None else pa.array([], pa.list_(pa.int32()))
    row = np.empty(len(order), np.int64)
    row[order] = np.arange(len(order))  # the answers came in this order
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    flat, n = gather(lists.flatten().to_numpy().astype(np.int32), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64), row[word_units])
    word_starts = np.concatenate([[0], np.cumsum(n)])[word_starts]
    spelled = pa.array(piece_bytes(model), pa.large_binary()) if decoding else None
    out, at = [], 0
    while at < rows.num_rows or not out:  # slices of the texts, so that little is held at once
        end = max(at + 1, int(np.searchsorted(starts, starts[at] + SLICE_WORDS, "right")) - 1) if rows.num_rows else 0
        ids, lengths = gather(flat, word_starts, place[starts[at] : starts[end]])
        offsets = np.concatenate([[0], np.cumsum(lengths)])[starts[at : end + 1] - starts[at]]
        part = {id_col: rows[id_col].slice(at, end - at), "ids": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))}
        if decoding:
            part["decoded"] = decoded_texts(ids, offsets, spelled)
        out.append(pa.table(part))
        at = end
    return pa.concat_tables(out)


def encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", model: Model | None = None, decoding: bool = False) -> DataFrame:
    """``id_col, ids`` for each row (with ``decoding`` also ``decoded``): the ids that the tokenizer gives for the whole text, without control ids.

    A null text counts as empty and has no ids. Rows repeated are all returned;
    other columns are ignored. A space mark in the text itself is read as a space,
    as the tokenizer does.
    """
    model = model or load(path or default_path())
    joints = Joints(model)
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    buckets = max(1, math.ceil(size / BUCKET_BYTES))
    parts = 7 + math.ceil(size / PART_BYTES)
    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64(id_col, "text"), F.lit(buckets)).cast("int"))
    texts = packed(rows, "bucket")
    asked = texts.groupBy("bucket").applyInArrow(lambda t: units_in(t, joints, parts), "part int, bucket int, blob binary")
    units = asked.groupBy("part").applyInArrow(distinct_units, "unit string")

    def part_of(t: pa.Table) -> np.ndarray:
        order, part = dealt(t["unit"].combine_chunks().cast(pa.large_string()), parts)
        return part[np.argsort(order)]

    # a fixed number of partitions: the units are few bytes but much work, which coalescing would not see
    coded = packed_by(encode_units(units.repartition(2 * buckets, "unit"), model), "part", part_of)
    kind = pa.uint16() if len(model.pieces) <= 1 << 16 else pa.int32()
    answers = asked.groupBy("part").cogroup(coded.groupBy("part")).applyInArrow(lambda a, c: answers_to(a, c, kind), "bucket int, part int, blob binary")
    fields = [T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))]
    schema = T.StructType([*fields, T.StructField("decoded", T.StringType())] if decoding else fields)
    found = texts.groupBy("bucket").cogroup(answers.groupBy("bucket"))
    return found.applyInArrow(lambda t, c: assemble(t, c, model, joints, parts, id_col, decoding), schema)


def decode(coded: DataFrame, path: str | None = None, ids_col: str = "ids", model: Model | None = None) -> DataFrame:
    """``coded`` with a column ``decoded``: the text of the ids; control and unknown ids have none."""
    model = model or load(path or default_path())
    parts = piece_bytes(model)

    @F.pandas_udf("string")
    def text_of(lists: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in lists:
            out = [b"".join([parts[i] for i in own if 0 <= i < len(parts)]).decode("utf-8", "replace") if own is not None else "" for own in series]
            yield pd.Series([t[1:] if t.startswith(" ") else t for t in out], dtype=object)

    return coded.withColumn("decoded", text_of(F.col(ids_col)))


def digests() -> list[Column]:
    """Of ``ids`` (as written with commas) and ``decoded``."""
    return [F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: pieces, a digest of the ids and of the decoded text."""
    found = encode(table(spark, sf_dir, "documents"), decoding=True)
    return found.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), *digests())


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The corpus as ids, with digests of them and of the text that they decode to: one row for each row of the mix."""
    found = encode(docs, decoding=True)
    return found.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "ids", *digests())
