"""Toxicity by a linear-chain conditional random field over words.

Tokens are labelled from the document labels: in a toxic document, a word is
toxic if it (or its beginning) is typical of toxic documents and not of clean
ones. The field (states clean and toxic, hashed features of words) is trained in
numpy on those labels; forward-backward marginals over whole texts give the
offending words and, aggregated, the document's score.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table
from .language_id import held_out
from .text_words import plain_words, slices

#: The training sample: so many labelled documents of each class at most, of so many bytes each at most.
SAMPLE_TOXIC, SAMPLE_CLEAN, SAMPLE_BYTES = 2000, 4000, 1 << 17
#: A feature marks toxic words if its documents are toxic so much more often (log odds),
#: and if at least this share of the toxic documents (and five) have it.
LEAST_ODDS, LEAST_SHARE, LEAST_DOCS = 2.5, 0.01, 5
HASHED, FEATURES = 1 << 17, 6
LENGTH, BATCH, STEPS = 33, 256, 400
CLEAN_WEIGHT = 0.8
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def names(word: str) -> list[str]:
    """The features of a word: itself, its beginnings of 3 to 6 letters, its end."""
    return ["w" + word, *(f"p{word[:k]}" if len(word) >= k else "" for k in (3, 4, 5, 6)), "s" + word[-3:]]


def hashed(words: list[str]) -> np.ndarray:
    """Feature numbers by word; a missing feature is 0, whose weight stays 0."""
    out = np.zeros((len(words), FEATURES), np.int64)
    for i, w in enumerate(words):
        if w:
            out[i] = [1 + zlib.crc32(x.encode("utf-8", "surrogatepass")) % (HASHED - 1) if x else 0 for x in names(w)]
    return out


class Field:
    """A chain of two states: ``theta`` by feature, ``move[a, b]`` from state a to b (logs)."""

    def __init__(self):
        self.theta = np.zeros(HASHED)
        self.bias = -2.0
        self.move = np.array([[1.0, 0.0], [0.0, 0.0]])
        self.doc = np.array([-3.0, 6.0, 0.5, 0.0])

    def emission(self, features: np.ndarray) -> np.ndarray:
        """How much a word speaks for toxic (log odds)."""
        return self.theta[features].sum(axis=-1) + self.bias

    def marginals(self, u: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """P(toxic) of every word; ``u`` holds the texts' emissions one after the other.

        All texts step together, the longest first, so a step works on the texts
        that still go on.
        """
        size = np.diff(starts)
        order = np.argsort(-size, kind="stable")
        begin, size = starts[:-1][order], size[order]
        longest = int(size[0]) if len(size) else 0
        going = np.searchsorted(-size, -np.arange(longest), "left")  # texts longer than t
        e, m = np.exp(np.clip(u, -30, 30)), np.exp(self.move)
        forward, out = np.zeros(len(u)), np.zeros(len(u))
        f = np.zeros(0)
        for t in range(longest):
            n = going[t]
            at = begin[:n] + t
            if t == 0:
                p1, p0 = e[at], np.ones(n)
            else:
                g = f[:n]
                p1, p0 = ((1 - g) * m[0, 1] + g * m[1, 1]) * e[at], (1 - g) * m[0, 0] + g * m[1, 0]
            f = p1 / (p1 + p0)
            forward[at] = f
        back = np.full(len(size), 0.5)
        for t in range(longest - 1, -1, -1):
            n = going[t]
            at = begin[:n] + t
            b, f = back[:n], forward[at]
            toxic = f * b
            out[at] = toxic / (toxic + (1 - f) * (1 - b))
            x1, x0 = e[at] * b, 1 - b
            b1, b0 = m[1, 1] * x1 + m[1, 0] * x0, m[0, 1] * x1 + m[0, 0] * x0
            back[:n] = b1 / (b1 + b0)
        return out

    def fit(self, features: np.ndarray, labels: np.ndarray, steps: int = STEPS, rate: float = 0.5) -> None:
        """AdaGrad on the likelihood of label sequences; ``features`` is sequences by words by features."""
        rng = np.random.default_rng(3)
        scale, bias_scale, move_scale = np.full(HASHED, 1e-2), 1e-2, np.full((2, 2), 1e-2)
        for _ in range(steps):
            pick = rng.integers(0, len(features), BATCH)
            x, y = features[pick], labels[pick]
            u = self.emission(x)
            n, length = u.shape
            psi = np.stack([np.zeros_like(u), u], axis=2)
            alpha, beta = np.zeros((n, length, 2)), np.zeros((n, length, 2))
            alpha[:, 0] = psi[:, 0]
            for t in range(1, length):
                alpha[:, t] = psi[:, t] + np.logaddexp(alpha[:, t - 1, 0, None] + self.move[0], alpha[:, t - 1, 1, None] + self.move[1])
            for t in range(length - 2, -1, -1):
                z = psi[:, t + 1] + beta[:, t + 1]
                beta[:, t] = np.logaddexp(z[:, 0, None] + self.move[:, 0], z[:, 1, None] + self.move[:, 1])
            norm = np.logaddexp(alpha[:, -1, 0], alpha[:, -1, 1])[:, None]
            grad = np.exp(alpha[:, :, 1] + beta[:, :, 1] - norm) - y
            moves = np.zeros((2, 2))
            for a in (0, 1):
                for b in (0, 1):
                    expected = np.exp(alpha[:, :-1, a] + self.move[a, b] + psi[:, 1:, b] + beta[:, 1:, b] - norm)
                    moves[a, b] = (expected - ((y[:, :-1] == a) & (y[:, 1:] == b))).sum()
            g = np.bincount(x.ravel(), np.repeat(grad.ravel(), FEATURES), HASHED) / n + 1e-4 * self.theta
            g[0] = 0
            scale += g * g
            self.theta -= rate * g / np.sqrt(scale)
            gb = grad.sum() / n
            bias_scale += gb * gb
            self.bias -= 0.2 * gb / math.sqrt(bias_scale)
            moves /= n
            move_scale += moves * moves
            self.move -= 0.2 * moves / np.sqrt(move_scale)

    def doc_inputs(self, marginal: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """By text: 1, the largest marginal, log(1 + expected toxic words), the same by 1000 words."""
        n = len(starts) - 1
        doc = np.repeat(np.arange(n), np.diff(starts))
        most = np.zeros(n)
        np.maximum.at(most, doc, marginal)
        total = np.bincount(doc, marginal, n)
        return np.stack([np.ones(n), most, np.log1p(total), np.log1p(1000 * total / (20 + np.diff(starts)))], axis=1)

    def fit_docs(self, x: np.ndarray, y: np.ndarray) -> None:
        """Logistic regression by Newton's method; CLEAN_WEIGHT is the clean class's share of the weight."""
        weight = np.where(y == 1, (1 - CLEAN_WEIGHT) / max(y.sum(), 1), CLEAN_WEIGHT / max((1 - y).sum(), 1))
        w = np.zeros(x.shape[1])
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            h = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(len(w))
            w -= np.linalg.solve(h, x.T @ (weight * (p - y)) + 1e-3 * w)
        self.doc = w

    def scores(self, inputs: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(inputs @ self.doc, -30, 30)))


def different(texts: list[str], labels: list[int]) -> list[int]:
    """Indexes of texts without near copies: one for each least hash of three words."""
    seen, out = set(), []
    for i, text in enumerate(texts):
        w = text.lower().split()
        key = min((xxhash.xxh64_intdigest(" ".join(w[k : k + 3])) for k in range(max(1, len(w) - 2))), default=0)
        if (key, labels[i]) not in seen:
            seen.add((key, labels[i]))
            out.append(i)
    return out


def toxic_features(words: list[list[str]], labels: np.ndarray) -> set[str]:
    """Features that are typical of toxic documents."""
    counts = (Counter(), Counter())
    for own, y in zip(words, labels):
        counts[y].update({n for w in own if w for n in names(w)[:-1] if n})
    n_clean, n_toxic = max(1, int((labels == 0).sum())), max(1, int((labels == 1).sum()))
    least = max(LEAST_DOCS, LEAST_SHARE * n_toxic)
    return {k for k, c in counts[1].items() if c >= least and math.log((c + 0.5) / n_toxic) - math.log((counts[0][k] + 0.5) / n_clean) >= LEAST_ODDS}


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Field | None:
    """Fit on a bounded sample, chosen by a hash of the id; None if a class is missing.

    Several labels of one document count as toxic if one is. Documents of more than
    SAMPLE_BYTES are not learned from.
    """
    docs = docs.where(F.coalesce(F.octet_length(text_col), F.lit(0)) <= SAMPLE_BYTES)
    marks = labels.where(F.col(label_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).alias(label_col))
    ids = [marks.where(F.col(label_col) == y).orderBy(F.xxhash64(id_col), id_col).limit(n) for y, n in ((1, SAMPLE_TOXIC), (0, SAMPLE_CLEAN))]
    chosen = ids[0].unionByName(ids[1])  # SAMPLE_TOXIC + SAMPLE_CLEAN rows at most
    sample = docs.select(id_col, text_col).join(F.broadcast(chosen), id_col).dropDuplicates([id_col]).toPandas().sort_values(id_col)
    texts, labels = [t or "" for t in sample[text_col]], sample[label_col].astype(int).tolist()
    keep = different(texts, labels)
    texts, y = [texts[i] for i in keep], np.array([labels[i] for i in keep], int)
    if not 0 < y.sum() < len(y):
        return None
    place, unique, starts = plain_words(pa.array(texts, pa.string()))
    per_doc = [[unique[i] for i in np.unique(place[a:b])] for a, b in zip(starts, starts[1:])]
    marks = toxic_features(per_doc, y)
    toxic_word = np.array([any(n in marks for n in names(w)[:-1]) if w else False for w in unique], bool)
    features, rng = hashed(unique), np.random.default_rng(4)
    xs, ys = [], []
    for k in range(len(texts)):
        own = place[starts[k] : starts[k + 1]]
        hits = np.flatnonzero(toxic_word[own])  # in a clean document, these teach what such a word isn't alone
        for at in [*rng.permutation(hits)[:6], *rng.integers(0, max(1, len(own)), 2)]:
            a = max(0, min(int(at) - int(rng.integers(0, LENGTH)), len(own) - LENGTH))
            part = own[a : a + LENGTH]
            x = np.zeros((LENGTH, FEATURES), np.int64)
            x[: len(part)] = features[part]
            z = np.zeros(LENGTH, np.int64)
            z[: len(part)] = toxic_word[part] if y[k] else 0
            xs.append(x)
            ys.append(z)
    field = Field()
    field.fit(np.array(xs), np.array(ys))
    marginal = field.marginals(field.emission(features)[place], starts)
    field.fit_docs(field.doc_inputs(marginal, starts), y)
    return field


def score(docs: DataFrame, field: Field | None, id_col: str = "doc_id", text_col: str = "text", spans: bool = True) -> DataFrame:
    """``id_col, score, spans`` for each row, from the whole text.

    ``spans`` lists the offending words as ``start, length`` in characters. A null
    text scores as an empty one. Without a trained field (no labels of one class)
    every score is 0. Repeated rows are all returned, alike; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores, found = [], []
            for texts in slices(batch.column(1)):
                if field is None:
                    scores += [0.0] * len(texts)
                    found += [[]] * len(texts)
                    continue
                place, unique, starts = plain_words(texts)
                marginal = field.marginals(field.emission(hashed(unique))[place], starts)
                scores.extend(field.scores(field.doc_inputs(marginal, starts)))
                hit = np.bincount(np.repeat(np.arange(len(texts)), np.diff(starts)), marginal >= 0.5, len(texts)) > 0
                for k, text in enumerate(texts):
                    own = []
                    if spans and hit[k]:
                        for m, p in zip(WORD.finditer(text.as_py()), marginal[starts[k] : starts[k + 1]]):
                            if p >= 0.5:
                                own.append({"start": m.start(), "length": m.end() - m.start()})
                    found.append(own)
            kind = pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(found, kind)], names=[id_col, "score", "spans"])

    span = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("length", T.IntegerType())])
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("score", T.DoubleType()), T.StructField("spans", T.ArrayType(span))])
    return docs.select(id_col, text_col).mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = held_out("doc_id", 5, 0)
    field = train(docs, table(spark, sf_dir, "labels").where(~out))
    return score(docs, field).select("doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "spans")
