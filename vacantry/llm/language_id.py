"""Language identification by a bidirectional gated recurrent network over bytes.

The network is trained here by backpropagation through time in numpy, on a
bounded sample of labelled rows. It reads the bytes of a word both ways and
gives each position a probability of every language; a document's probabilities
pool those of all positions of all its words. A word that occurs again is not
computed again within a slice of texts, which changes no result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table
from .text_words import plain_words, slices

#: The training sample: so many documents of a language, so many words (or parts of LONGEST bytes of longer ones)
#: of a document, and so many languages, the most frequent first.
DOCS_PER_LANGUAGE, WORDS_PER_DOC, MOST_LANGUAGES = 500, 80, 200
HIDDEN, LONGEST, STEPS, BATCH = 12, 32, 900, 512
#: Words whose evidence a score counts at most, so that scores of long texts stay apart.
EVIDENCE = 20
UNKNOWN = "und"
#: Documents under this score are rejected by the pipeline; chance is 1 in the number of languages.
LEAST_SCORE = 0.3


def in_parts(word: bytes) -> list[bytes]:
    return [word[k : k + LONGEST] for k in range(0, len(word), LONGEST)]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class Network:
    """Two gated recurrent units, one for each direction, and a softmax at every position."""

    def __init__(self, classes: int, hidden: int = HIDDEN, seed: int = 0):
        rng = np.random.default_rng(seed)
        make = lambda *shape: (rng.standard_normal(shape) * 0.2).astype(np.float32)
        self.hidden = hidden
        self.w = {}
        for d in "fb":  # forward, backward: input table, recurrent weights of both gates and of the candidate
            self.w |= {d + "x": make(256, 3 * hidden), d + "g": make(hidden, 2 * hidden), d + "c": make(hidden, hidden)}
        self.w |= {"out": make(2 * hidden, classes), "bias": np.zeros(classes, np.float32)}

    def states(self, x: np.ndarray, d: str, keep: bool) -> tuple[list, list]:
        """The state after each byte of ``x`` (words by bytes), and what training needs."""
        n, length = x.shape
        h, k = np.zeros((n, self.hidden), np.float32), self.hidden
        states, kept = [None] * length, [None] * length
        for t in range(length) if d == "f" else range(length - 1, -1, -1):
            a = self.w[d + "x"][x[:, t]]
            gates = sigmoid(a[:, : 2 * k] + h @ self.w[d + "g"])
            z, r = gates[:, :k], gates[:, k:]
            c = np.tanh(a[:, 2 * k :] + (r * h) @ self.w[d + "c"])
            new = h + z * (c - h)
            if keep:
                kept[t] = (h, z, r, c)
            h = states[t] = new
        return states, kept

    def logits(self, x: np.ndarray, keep: bool = False):
        f, kept_f = self.states(x, "f", keep)
        b, kept_b = self.states(x, "b", keep)
        both = [np.concatenate([p, q], axis=1) for p, q in zip(f, b)]
        return [s @ self.w["out"] + self.w["bias"] for s in both], both, {"f": kept_f, "b": kept_b}

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Loss (cross entropy at every position) and its gradients through time."""
        n, length = x.shape
        k = self.hidden
        outs, both, kept = self.logits(x, keep=True)
        grad = {name: np.zeros_like(v) for name, v in self.w.items()}
        into, loss = [], 0.0
        for o, s in zip(outs, both):
            p = np.exp(o - o.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            loss -= float(np.log(p[np.arange(n), y] + 1e-9).mean()) / length
            p[np.arange(n), y] -= 1
            p /= n * length
            grad["out"] += s.T @ p
            grad["bias"] += p.sum(axis=0)
            into.append(p @ self.w["out"].T)
        for d in "fb":
            back = np.zeros((n, k), np.float32)
            for t in range(length - 1, -1, -1) if d == "f" else range(length):
                h, z, r, c = kept[d][t]
                g = back + (into[t][:, :k] if d == "f" else into[t][:, k:])
                gc = g * z * (1 - c * c)
                grh = gc @ self.w[d + "c"].T
                gates = np.concatenate([g * (c - h) * z * (1 - z), grh * h * r * (1 - r)], axis=1)
                grad[d + "c"] += (r * h).T @ gc
                grad[d + "g"] += h.T @ gates
                np.add.at(grad[d + "x"], x[:, t], np.concatenate([gates, gc], axis=1))
                back = g * (1 - z) + grh * r + gates @ self.w[d + "g"].T
        return loss, grad

    def fit(self, words: list[bytes], labels: np.ndarray, steps: int = STEPS, rate: float = 0.02) -> None:
        """Adam over batches of words of one length."""
        rng = np.random.default_rng(1)
        lengths = np.array([len(w) for w in words])
        by = {int(n): np.flatnonzero(lengths == n) for n in np.unique(lengths)}
        chance = np.array([len(v) * n for n, v in by.items()], float)
        m = {k: np.zeros_like(v) for k, v in self.w.items()}
        v = {k: np.zeros_like(x) for k, x in self.w.items()}
        for step in range(1, steps + 1):
            length = int(rng.choice(list(by), p=chance / chance.sum()))
            pick = rng.choice(by[length], BATCH)
            x = np.frombuffer(b"".join(words[i] for i in pick), np.uint8).reshape(len(pick), length)
            _, grad = self.gradients(x, labels[pick])
            pace = rate * (1 - step / (steps + 1))
            for k, g in grad.items():
                m[k] += 0.1 * (g - m[k])
                v[k] += 0.01 * (g * g - v[k])
                self.w[k] -= pace * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)

    def evidence(self, words: list[bytes]) -> np.ndarray:
        """For each word the mean log probabilities of the classes over its positions; longer words are read in parts."""
        parts, owner = [], []
        for i, w in enumerate(words):
            parts += in_parts(w)
            owner += [i] * (len(parts) - len(owner))
        sums = np.zeros((len(words), len(self.w["bias"])), np.float64)
        lengths, owner = np.fromiter(map(len, parts), np.int64, len(parts)), np.array(owner, np.int64)
        for n in np.unique(lengths):
            at = np.flatnonzero(lengths == n)
            for k in range(0, len(at), 16384):
                some = at[k : k + 16384]
                x = np.frombuffer(b"".join(parts[i] for i in some), np.uint8).reshape(len(some), int(n))
                total = 0
                for o in self.logits(x)[0]:
                    o = o - o.max(axis=1, keepdims=True)
                    total = total + o - np.log(np.exp(o).sum(axis=1, keepdims=True))
                np.add.at(sums, owner[some], total)
        return sums / np.maximum([[len(w)] for w in words], 1) if words else sums


def held_out(id_col: str, parts: int, left: int) -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), F.lit(parts)) == left


def some_words(rows: DataFrame, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """``id_col, label_col, words``: WORDS_PER_DOC words of each document, drawn by a seed from its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for texts in slices(batch.column(1)):
                place, unique, starts = plain_words(texts)
                coded = [in_parts(w.encode("utf-8", "surrogatepass")) for w in unique]
                for k in range(len(texts)):
                    own = [p for i in place[starts[k] : starts[k + 1]] for p in coded[i]]
                    rng = np.random.default_rng(len(own))
                    found.append(own if len(own) <= WORDS_PER_DOC else [own[i] for i in rng.choice(len(own), WORDS_PER_DOC, replace=False)])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(found, pa.list_(pa.binary()))], names=[id_col, label_col, "words"])

    schema = T.StructType([rows.schema[id_col], rows.schema[label_col], T.StructField("words", T.ArrayType(T.BinaryType()))])
    return rows.select(id_col, text_col, label_col).mapInArrow(run, schema)


def train(labelled: DataFrame, text_col: str = "text", label_col: str = "lang", id_col: str = "doc_id") -> tuple[Network | None, list[str]]:
    """Fit on at most DOCS_PER_LANGUAGE documents of each language, chosen by a hash of the id.

    Of more than MOST_LANGUAGES labels the most frequent are learned. Of rows that
    share an id one is read; columns other than these three are ignored.
    """
    rows = labelled.where(F.col(label_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
    languages = sorted(r[0] for r in rows.groupBy(label_col).count().orderBy(F.desc("count"), label_col).limit(MOST_LANGUAGES).collect())
    if not languages:
        return None, []
    by = Window.partitionBy(label_col).orderBy(F.xxhash64(id_col), id_col)
    known = rows.where(F.col(label_col).isin(languages))
    chosen = known.select(id_col, label_col).withColumn("n", F.row_number().over(by)).where(F.col("n") <= DOCS_PER_LANGUAGE)
    ids = chosen.select(id_col).distinct()  # at most MOST_LANGUAGES * DOCS_PER_LANGUAGE rows
    sample = some_words(known.select(id_col, text_col, label_col).join(F.broadcast(ids), id_col), id_col, text_col, label_col)
    drawn = sample.groupBy(id_col).agg(F.min(F.struct(label_col, "words")).alias("s")).select("s.*").orderBy(id_col).toPandas()
    words = [w for own in drawn["words"] for w in own]
    labels = [languages.index(language) for language, own in zip(drawn[label_col], drawn["words"]) for _ in own]
    network = Network(len(languages))
    if words:
        network.fit(words, np.array(labels))
    return network, languages


def predict(texts: pa.Array, network: Network | None, languages: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Languages and scores of whole texts."""
    names, preds, scores = np.array([*languages, UNKNOWN], object), [], []
    for some in slices(texts):
        place, unique, starts = plain_words(some)
        n, doc = len(some), np.repeat(np.arange(len(some)), np.diff(starts))
        letters = pc.fill_null(pc.match_substring_regex(some, r"\p{L}"), False).to_numpy(zero_copy_only=False)
        if network is None:
            letters, total = np.zeros(n, bool), np.zeros((n, 1))
        else:
            each = network.evidence([w.encode("utf-8", "surrogatepass") for w in unique])
            total = np.stack([np.bincount(doc, each[place, c], n) for c in range(each.shape[1])], axis=1)
        total *= np.minimum(1, EVIDENCE / np.maximum(np.diff(starts), 1))[:, None]
        p = np.exp(total - total.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        preds.append(names[np.where(letters, p.argmax(axis=1), len(languages))])
        scores.append(np.where(letters, p.max(axis=1), 0.0))
    return np.concatenate([np.zeros(0, object), *preds]), np.concatenate([np.zeros(0), *scores])


def identify(docs: DataFrame, network: Network | None, languages: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, lang_pred, score`` for each row, from the whole text.

    ``und`` with score 0 if the text is null or has no letter, or if nothing was
    learned. Ties go to the language first by code point. Repeated rows are all
    returned, alike; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            preds, scores = predict(batch.column(1), network, languages)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(preds, pa.string()), pa.array(scores, pa.float64())], names=[id_col, "lang_pred", "score"])

    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return docs.select(id_col, text_col).mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = held_out("doc_id", 4, 2)
    network, languages = train(docs.where(~out))
    return identify(docs, network, languages).select("doc_id", out.alias("held_out"), "lang_pred", "score")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text has no recognised language go; each is judged by its own text. Columns of any name pass through."""
    network, languages = train(docs.where(~held_out("doc_id", 4, 2)))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            preds, scores = predict(batch.column(at), network, languages)
            yield batch.filter(pa.array((preds != UNKNOWN) & (scores >= LEAST_SCORE), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
