r"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features, each present or not: words, their first six letters, word pairs and pairs that skip a word, hashed into
2**bits places. Words are runs of letters and digits or runs of punctuation of the lower-cased text. Each coordinate has
a learning rate of its own, and L1 keeps few weights, which alone are sent to the executors. A model is fitted in one
task on at most `most_rows` labelled ids (those least by a hash of the id); scoring covers all rows and whole texts.
The rate, L1 and stem length were chosen by three folds within rows that may be learnt from, not on held-out ones.

Defined results: null and empty texts have the score of no feature; labels that conflict count by their highest value,
null labels don't count; without labelled rows all scores are one half; rows that repeat an id are scored each, and learnt
from once; an empty table gives no rows; columns other than the named ones are never read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

TOKEN = re.compile(C.FOLDED_WORD + r"|[!-/:-@\[-`{-~]+")


@dataclass(frozen=True)
class Ftrl:
    """least_rows: labelled rows that a feature must occur in. calibrate: one in so many
    rows isn't trained on, but fits the scale and offset that turn sums of weights into probabilities."""

    bits: int = 18
    stem: int = 6
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 10.0
    l2: float = 0.1
    epochs: int = 5
    least_rows: int = 3
    calibrate: int = 5
    most_rows: int = 8_000


class Tokens(dict):
    """token -> row of `table` (its hash, and the places of the word and of its stem of `stem` characters)."""

    def __init__(self, mask: np.uint64, stem: int, most: int = 400_000):
        super().__init__()
        self.mask, self.stem, self.most, self.new, self.table = mask, stem, most, [], np.zeros((3, 0), np.uint64)

    def __missing__(self, token: str) -> int:
        row = self[token] = len(self)
        self.new.append((xxhash.xxh64_intdigest(token.encode("utf-8", "surrogatepass")), xxhash.xxh64_intdigest(token[: self.stem].encode("utf-8", "surrogatepass"))))
        return row

    def of(self, tokens: list[str]) -> np.ndarray:
        if len(self) >= self.most:
            self.clear()
            self.table = self.table[:, :0]
        rows = np.fromiter(map(self.__getitem__, tokens), np.int64, len(tokens))
        if self.new:
            h, stem = np.array(self.new, np.uint64).T
            self.table = np.concatenate([self.table, [h, C.mix(h) & self.mask, C.mix(stem + np.uint64(11)) & self.mask]], axis=1)
            self.new = []
        return self.table.take(rows, axis=1)


class Features:
    """Distinct hashed features of texts; with `used` (a mark for each place) those of marked places alone."""

    def __init__(self, bits: int, used: np.ndarray | None = None, stem: int = 6):
        self.bits, self.mask, self.used = bits, np.uint64((1 << bits) - 1), used
        self.tokens = Tokens(self.mask, stem)

    def of(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of some texts together: the text of each feature, its place (both in ascending order), and each text's tokens."""
        found = [TOKEN.findall(t.lower()) if t else [] for t in texts]
        sizes = np.array([len(x) for x in found], np.int64)
        h, word, stem = self.tokens.of([x for one in found for x in one])
        owner = np.repeat(np.arange(len(texts)), sizes)
        parts = [self._keys(word, owner), self._keys(stem, owner)]
        for gap, salt in ((1, 3), (2, 5)):
            parts.append(self._keys(C.mix(h[:-gap] * np.uint64(salt) + h[gap:]) & self.mask, owner[:-gap], owner[:-gap] == owner[gap:]))
        keys = np.unique(np.concatenate(parts))
        return keys >> self.bits, keys & int(self.mask), sizes

    def _keys(self, places: np.ndarray, owner: np.ndarray, among: np.ndarray | None = None) -> np.ndarray:
        places = places.astype(np.int64)
        if self.used is not None:
            among = self.used.take(places) if among is None else among & self.used.take(places)
        if among is not None:
            places, owner = places[among], owner[among]
        return owner << self.bits | places


def together(texts: list[str | None], most: int = 400_000):
    """(start, texts) of neighbours with about `most` characters together; a longer text is alone."""
    start, held = 0, 0
    for k, text in enumerate(texts):
        n = len(text or "")
        if k > start and held + n > most:
            yield start, texts[start:k]
            start, held = k, 0
        held += n
    if len(texts) > start:
        yield start, texts[start:]


def _extract(cfg: Ftrl):
    def run(batches):
        features = Features(cfg.bits, None, cfg.stem)
        for batch in C.pieces(batches, 200):
            blobs = []
            for _, texts in together(batch.column(2).to_pylist()):
                owner, places, _ = features.of(texts)
                cuts = np.searchsorted(owner, np.arange(len(texts) + 1))
                blobs += [places[a:b].astype(np.uint32).tobytes() for a, b in zip(cuts[:-1], cuts[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(blobs, pa.binary())], ["h", "y", "features"])

    return run


def train(rows: list[tuple[int, np.ndarray]], classes: int, cfg: Ftrl) -> tuple[np.ndarray, np.ndarray]:
    """One-against-rest weights (classes, 2**bits) and biases; rows are (class, features)."""
    size = 1 << cfg.bits
    z, n = np.zeros((classes, size)), np.zeros((classes, size))
    bias, bias_n = np.zeros(classes), np.zeros(classes)

    def weights(z, n):
        return np.where(np.abs(z) <= cfg.l1, 0.0, -(z - np.sign(z) * cfg.l1) / ((cfg.beta + np.sqrt(n)) / cfg.alpha + cfg.l2))

    seen = np.zeros(size, np.int32)
    for _, f in rows:
        seen[f] += 1
    rows = [(y, f[seen[f] >= cfg.least_rows]) for y, f in rows]
    kept, rows = rows[:: cfg.calibrate], [r for k, r in enumerate(rows) if k % cfg.calibrate]
    order = np.random.default_rng(5)
    for _ in range(cfg.epochs):
        for k in order.permutation(len(rows)):
            y, f = rows[k]
            zf, nf = z[:, f], n[:, f]
            w = weights(zf, nf)
            p = 1 / (1 + np.exp(-np.clip(w.sum(1) + bias, -30, 30)))
            g = p - (np.arange(classes) == y)
            g2 = (g * g)[:, None]
            z[:, f] = zf + g[:, None] - (np.sqrt(nf + g2) - np.sqrt(nf)) / cfg.alpha * w
            n[:, f] = nf + g2
            bias_n += g * g
            bias -= cfg.alpha / (cfg.beta + np.sqrt(bias_n)) * g
    w = weights(z, n)
    for c in range(classes):
        scale, offset = calibration(np.array([w[c, f].sum() + bias[c] for _, f in kept]), np.array([float(y == c) for y, _ in kept]))
        w[c], bias[c] = w[c] * scale, bias[c] * scale + offset
    return w, bias


def calibration(s: np.ndarray, y: np.ndarray, steps: int = 30) -> tuple[float, float]:
    """Scale and offset of a one-dimensional logistic fit, by Newton's method; a weak prior keeps both near (1, 0)."""
    v, x = np.array([1.0, 0.0]), np.stack([s, np.ones(len(s))], 1)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ v, -30, 30)))
        grad = x.T @ (p - y) + 0.1 * (v - [1, 0])
        v = v - np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(2), grad)
    return (float(v[0]), float(v[1])) if np.isfinite(v).all() and v[0] > 0 else (1.0, 0.0)


def _fit(classes: int, cfg: Ftrl):
    def run(batches):
        rows = [(y, np.frombuffer(f, np.uint32)) for b in batches for y, f in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
        w, bias = train(rows, classes, cfg) if rows else (np.zeros((classes, 1)), np.zeros(classes))
        c, at = np.nonzero(w)
        c, at, v = np.concatenate([c, np.arange(classes)]), np.concatenate([at, np.full(classes, -1)]), np.concatenate([w[c, at], bias])
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int32)), pa.array(at.astype(np.int64)), pa.array(v)], ["c", "at", "w"])

    return run


def sample(docs: DataFrame, marks: DataFrame, learn: Column, most_rows: int) -> DataFrame:
    """(h, y, text) of at most `most_rows` labelled ids: those least by a hash of the id, each with its least text, however
    many rows repeat it. `marks` has m_id and y."""
    ids = marks.filter("y is not null and m_id is not null").filter(learn).withColumn("h", F.xxhash64("m_id", F.lit(17)))
    # Hashes are spread evenly, so a cut at a quarter more than the wanted share leaves few to be sorted.
    share = 1.25 * most_rows / max(1, ids.count())
    if share < 1:
        ids = ids.filter(F.col("h") < int(2**64 * share) - 2**63)
    ids = ids.orderBy("h", "m_id").limit(most_rows)
    return docs.join(ids, F.col("doc_id") == F.col("m_id")).groupBy("m_id", "h", F.col("y").cast("long").alias("y")).agg(F.min("text").alias("text")).select("h", "y", "text")


def fit(docs: DataFrame, marks: DataFrame, learn: Column, classes: int, cfg: Ftrl = Ftrl()) -> tuple[np.ndarray, np.ndarray]:
    """Weights and biases; the nonzero weights alone come to the driver."""
    rows = sample(docs, marks, learn, cfg.most_rows).mapInArrow(_extract(cfg), "h long, y long, features binary")
    found = rows.repartition(1).sortWithinPartitions("h", "features").mapInArrow(_fit(classes, cfg), "c int, at long, w double").toArrow()
    c, at, v = (found.column(k).to_numpy() for k in ("c", "at", "w"))
    w, bias = np.zeros((classes, 1 << cfg.bits), np.float32), np.zeros(classes)
    w[c[at >= 0], at[at >= 0]] = v[at >= 0]
    bias[c[at < 0]] = v[at < 0]
    return w, bias


def _score(model, cfg: Ftrl, names: list[str], at: int):
    """Rows -> the same with n_tokens and one probability for each class, under the last of `names`; the text is column `at`."""

    def run(batches):
        w, bias = model.value
        features = Features(cfg.bits, (w != 0).any(0), cfg.stem)
        for batch in C.pieces(batches, 500):
            out, sizes = np.tile(bias, (batch.num_rows, 1)), np.zeros(batch.num_rows, np.int64)
            for start, texts in together(batch.column(at).to_pylist()):
                owner, places, n = features.of(texts)
                sizes[start : start + len(texts)] = n
                for c in range(len(w)):
                    out[start : start + len(texts), c] += np.bincount(owner, w[c, places], len(texts))
            p = 1 / (1 + np.exp(-np.clip(out, -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sizes, pa.int64()), C.flat_float64(p)], names)

    return run


def class_scores(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], cfg: Ftrl = Ftrl(), keep: list[str] = ["doc_id"], prefix: str = "") -> DataFrame:  # noqa: B006
    """The columns `keep`, and n_tokens and p (a probability for each class, against the rest), their names after `prefix`."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    if "text" not in keep:
        return class_scores(docs, model, cfg, [*keep, "text"], prefix).drop("text")
    kept = docs.select(*keep)
    schema = T.StructType([*kept.schema, T.StructField(prefix + "n_tokens", T.LongType()), T.StructField(prefix + "p", T.ArrayType(T.DoubleType()))])
    return kept.mapInArrow(_score(sent, cfg, schema.names, keep.index("text")), schema)


def toxicity(docs: DataFrame, labels: DataFrame, cfg: Ftrl = Ftrl(), threshold: float = 0.5, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """One row for each document: doc_id, held_out, score, predicted. Held-out rows' labels are never learnt from."""
    docs = C.intake(docs, doc_id=doc_id, text=text)
    marks = labels.select(labels[doc_id].alias("m_id"), labels[label].alias("m")).groupBy("m_id").agg((1 - F.max("m")).alias("y"))
    # The one class that is told from the rest, number 0, is the toxic one.
    scored = class_scores(docs, fit(docs, marks, ~C.held_out(F.col("m_id")), 1, cfg), cfg)
    score = F.col("p")[0]
    return scored.select("doc_id", C.held_out(F.col("doc_id")).alias("held_out"), score.alias("score"), (score >= threshold).cast("int").alias("predicted"), "n_tokens")
