"""Quality classifier: supervised subword embeddings.

Hashed words, their character n-grams and word pairs each have a learned vector; a document is the mean of the vectors
of all its units, and a softmax layer gives its class. Vectors and layer are trained together by stochastic gradient
descent in numpy, in one task, on at most `most_rows` labelled ids (those least by a hash of the id). Scoring covers
all rows and whole texts, every word by the n-grams of all its characters (code points); the vectors, of a fixed size, are sent to all executors.

Words are separated by white space and keep their case and punctuation. A pair of equal words is one unit, whatever
the word. Defined results: null and empty texts have the score of the layer's bias; labels that conflict count by
their least value, null labels don't count; without labelled rows all scores are one half; rows that repeat an id are scored
each, and learnt from once; very long texts are taken whole; an empty table gives no rows; other columns are never read.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C
from .toxicity import sample


#: What the characters of an n-gram are folded by: an odd number beyond the code points.
FOLD = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Subwords:
    bits: int = 15
    dim: int = 10
    grams: tuple[int, ...] = (3, 4)
    rate: float = 0.5
    epochs: int = 5
    most_rows: int = 6_000


class Units:
    """Unit numbers of words and texts; what a word of up to `longest` characters consists of is kept while there is room,
    longer words are taken apart whole each time. With `weights` (a number for each unit) texts have the mean of their
    units' weights instead. New words are taken apart together, in numpy, `block` characters at a time."""

    def __init__(self, cfg: Subwords, weights: np.ndarray | None = None, most: int = 250_000, longest: int = 64, block: int = 1 << 20):
        self.cfg, self.mask, self.most, self.weights, self.longest, self.block = cfg, np.uint64((1 << cfg.bits) - 1), most, weights, longest, block
        self.forget()

    def forget(self):
        self.place: dict[str, int] = {}
        self.n = 0
        self.long: list[str] = []
        self.own: list[np.ndarray] = []
        self.counts: dict[int, np.ndarray] = {}
        self.hash = np.zeros(1024, np.uint64)
        self.size = np.zeros(1024, np.int64)
        self.sums = np.zeros(1024)

    def drop_long(self):
        """Long words are known only until the next words are asked for."""
        for w in self.long:
            del self.place[w]
        self.long, self.counts = [], {}

    def grams(self, raw: list[np.ndarray]):
        """(units, words): of all runs of characters within the words, the unit and its word's number, a block and a width at a time."""
        line, ends = np.concatenate([*raw, np.zeros(max(self.cfg.grams), np.uint32)]), np.cumsum([len(b) for b in raw])
        for lo in range(0, int(ends[-1]), self.block):
            hi = min(lo + self.block, int(ends[-1]))
            word = np.repeat(np.arange(len(raw)), np.diff(np.clip(ends, lo, hi), prepend=lo))
            left = ends[word] - np.arange(lo, hi)
            for width in self.cfg.grams:
                here, code = line[lo : hi + width].astype(np.uint64), np.full(hi - lo, width, np.uint64)
                for k in range(width):
                    code = code * FOLD + here[k : hi - lo + k]
                held = left >= width
                yield (C.mix(code[held]) & self.mask).astype(np.int64), word[held]

    def add(self, words: list[str]) -> None:
        k, crc = self.n, zlib.crc32
        self.n += len(words)
        self.place.update(zip(words, range(k, self.n)))
        self.long = [w for w in words if len(w) > self.longest]
        while self.n > len(self.hash):
            self.hash, self.size, self.sums = (np.concatenate([x, np.zeros_like(x)]) for x in (self.hash, self.size, self.sums))
        raw = [np.frombuffer(f"<{w}>".encode("utf-32-le", "surrogatepass"), np.uint32) for w in words]
        sizes, here = np.array([len(b) for b in raw]), slice(k, self.n)
        self.hash[here] = np.fromiter((crc(w.encode("utf-8", "surrogatepass")) for w in words), np.uint64, len(words)) + np.uint64(1 << 32)
        whole = (C.mix(self.hash[here] + np.uint64(7)) & self.mask).astype(np.int64)
        self.size[here] = 1 + sum(np.maximum(sizes - g + 1, 0) for g in self.cfg.grams)
        if self.weights is not None:
            self.sums[here] = self.weights[whole] + sum(np.bincount(word, self.weights[units], len(words)) for units, word in self.grams(raw))
            return
        parts = [[whole[j : j + 1]] for j in range(len(words))]
        for units, word in self.grams(raw):
            if not len(word):
                continue
            first, last = int(word[0]), int(word[-1])
            for j, part in zip(range(first, last + 1), np.split(units, np.searchsorted(word, np.arange(first + 1, last + 1)))):
                if len(words[j]) > self.longest:
                    self.counts[k + j] = self.counts.get(k + j, 0) + np.bincount(part, minlength=1 << self.cfg.bits)
                else:
                    parts[j].append(part)
        self.own += [np.concatenate(p) for p in parts]

    def at(self, words: list[str]) -> np.ndarray:
        """The place of each word."""
        self.drop_long()
        if self.n > self.most:
            self.forget()
        if new := set(words).difference(self.place):
            self.add(sorted(new))
        return np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))

    def pairs(self, at: np.ndarray) -> np.ndarray:
        """Units of neighbours; equal neighbours share one."""
        h = self.hash[at]
        pair = C.mix(h[:-1] * np.uint64(3) + h[1:]) & self.mask
        return np.where(at[1:] == at[:-1], 1, pair.astype(np.int64))

    def of(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Distinct units and their shares."""
        words = (text or "").split()
        if not words:
            return np.zeros(0, np.int64), np.zeros(0, np.float32)
        at = self.at(words)
        n = np.bincount(np.concatenate([*(self.own[k] for k in at.tolist()), self.pairs(at)]), minlength=1 << self.cfg.bits)
        for k in at.tolist() if self.counts else ():
            if k in self.counts:
                n = n + self.counts[k]
        units = np.flatnonzero(n)
        return units, (n[units] / n.sum()).astype(np.float32)

    def mean(self, text: str | None) -> float:
        words = (text or "").split()
        total, n = 0.0, 0
        for lo in range(0, len(words), 20_000):
            at = self.at(words[max(0, lo - 1) : lo + 20_000])
            pairs = self.pairs(at)
            own = at[1:] if lo else at
            total += float(self.sums[own].sum()) + float(self.weights[pairs].sum())
            n += int(self.size[own].sum()) + len(pairs)
        return total / max(1, n)


def train(rows: list[tuple[int, np.ndarray, np.ndarray]], classes: int, cfg: Subwords) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors, layer and bias; rows are (class, units, shares)."""
    rng = np.random.default_rng(3)
    vectors = rng.uniform(-1 / cfg.dim, 1 / cfg.dim, (1 << cfg.bits, cfg.dim)).astype(np.float32)
    layer, bias = rng.normal(0, 0.3, (cfg.dim, classes)).astype(np.float32), np.zeros(classes, np.float32)
    steps, step = cfg.epochs * len(rows), 0
    for _ in range(cfg.epochs):
        for k in rng.permutation(len(rows)):
            rate = cfg.rate * (1 - step / steps)
            step += 1
            y, units, share = rows[k]
            v = share @ vectors[units] if len(units) else np.zeros(cfg.dim, np.float32)
            s = v @ layer + bias
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y] -= 1
            if len(units):
                # A step of one rate in the document's own vector, whatever its number of units.
                vectors[units] -= np.outer(share / (share @ share), rate * (layer @ p))
            layer -= rate * 0.2 * np.outer(v, p)
            bias -= rate * 0.05 * p
    return vectors, layer, bias


def _extract(cfg: Subwords):
    def run(batches):
        units = Units(cfg)
        for batch in C.pieces(batches, 100):
            found = [units.of(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([u.astype(np.int32).tobytes() for u, _ in found], pa.binary()), pa.array([s.tobytes() for _, s in found], pa.binary())], ["h", "y", "units", "shares"]
            )

    return run


def _fit(classes: int, cfg: Subwords):
    def run(batches):
        rows = [(y, np.frombuffer(u, np.int32), np.frombuffer(s, np.float32)) for b in batches for y, u, s in zip(*(b.column(k).to_pylist() for k in (1, 2, 3)))]
        parts = train(rows, classes, cfg) if rows else (np.zeros((1 << cfg.bits, cfg.dim)), np.zeros((cfg.dim, classes)), np.zeros(classes))
        yield pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(p, np.float32).tobytes() for p in parts], pa.binary())], ["part"])

    return run


def _score(model, cfg: Subwords, names: list[str], at: int):
    """Rows -> the same with a score; the text is column `at`. The softmax of two classes depends on the difference of their
    outputs alone, and that difference of a document's mean vector is the mean of the differences of its units: each unit
    needs one number."""

    def run(batches):
        vectors, layer, bias = model.value
        units = Units(cfg, vectors.astype(np.float64) @ (layer[:, 1] - layer[:, 0]).astype(np.float64))
        offset = float(bias[1]) - float(bias[0])
        for batch in C.pieces(batches, 200):
            z = np.array([units.mean(t) for t in batch.column(at).to_pylist()], np.float64) + offset
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(1 / (1 + np.exp(-np.clip(z, -500, 500))))], names)

    return run


def scored(docs: DataFrame, labels: DataFrame, cfg: Subwords = Subwords(), doc_id: str = "doc_id", text: str = "text", label: str = "quality", name: str = "score") -> DataFrame:
    """All columns of `docs` and `name`: the probability of label 1. Held-out rows' labels are never learnt from."""
    slim = C.intake(docs, doc_id=doc_id, text=text)
    marks = labels.select(labels[doc_id].alias("m_id"), labels[label].alias("m")).groupBy("m_id").agg(F.min("m").alias("y"))
    rows = sample(slim, marks, ~C.held_out(F.col("m_id")), cfg.most_rows).mapInArrow(_extract(cfg), "h long, y long, units binary, shares binary")
    parts = rows.repartition(1).sortWithinPartitions("h", "units").mapInArrow(_fit(2, cfg), "part binary").toArrow().column(0).to_pylist()
    vectors, layer, bias = (np.frombuffer(p, np.float32) for p in parts) if parts else (np.zeros(n, np.float32) for n in (cfg.dim << cfg.bits, 2 * cfg.dim, 2))
    sent = docs.sparkSession.sparkContext.broadcast((vectors.reshape(-1, cfg.dim), layer.reshape(cfg.dim, 2), bias))
    schema = T.StructType([*docs.schema, T.StructField(name, T.DoubleType())])
    return docs.mapInArrow(_score(sent, cfg, schema.names, docs.columns.index(text)), schema)


def quality_scores(docs: DataFrame, labels: DataFrame, cfg: Subwords = Subwords(), threshold: float = 0.3, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """One row for each document: doc_id, held_out, score, predicted."""
    found = scored(C.intake(docs, doc_id=doc_id, text=text), labels.select(labels[doc_id].alias("doc_id"), labels[label].alias("quality")), cfg)
    return found.select("doc_id", C.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, cfg: Subwords = Subwords(), threshold: float = 0.3) -> DataFrame:
    """The rows that score `threshold` or more, with all their columns; each row is judged by its own text."""
    return scored(docs, labels, cfg, name="__score").filter(F.col("__score") >= threshold).select(*docs.columns)
