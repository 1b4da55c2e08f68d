"""LM scoring by masked pseudo-likelihood.

A small bidirectional window network predicts every token from the two tokens before it and the two after it; a
document's score is the sum of the logarithms of those conditional probabilities. Words are told apart by 32-bit hashes
and counted over the whole corpus. The `own_words` most frequent ones have places of their own, in classes of `width`; all
others fall into classes by their count. The network gives the probability of the class and, of an own word, that of its
place in the class; another word's share of its class is its count's share of the class's counts. Counts of other words
are held in as many counters as there are words, up to `counters`, where words begin to share counters. As context, other
words share `shared` embeddings.

Training takes every window of every document, once a round. Documents are dealt by a hash of id and words into parts of
about `part_windows` windows, each ordered by that hash, so the result doesn't depend on how the table is partitioned.
Each part is learnt from the same start, and the parts' parameters are averaged, weighted by windows, in two steps in
the cluster. The driver holds one set of parameters (0.6 MB) and the counters (5 bytes each).

Words are those of lower-cased texts (letters and digits). Very long texts are taken whole, a stretch at a time. Defined
results: null and wordless texts have no tokens, a sum of 0 and a null mean; rows that repeat an id are scored each, and
equal texts alike; an empty table gives no rows; columns other than the named ones are never read.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C


@dataclass(frozen=True)
class WindowLm:
    own_words: int = 3072
    bands: int = 16
    width: int = 64
    shared: int = 2048
    counters: int = 1 << 21
    dim: int = 16
    side: int = 2
    rounds: int = 1
    rate: float = 0.6
    batch: int = 4096
    part_windows: int = 4_000_000

    @property
    def own_classes(self) -> int:
        return self.own_words // self.width

    @property
    def classes(self) -> int:
        return self.own_classes + self.bands

    @property
    def pad(self) -> int:
        """The place that stands for what lies beyond the ends of a text."""
        return self.own_words + self.shared


def log_softmax_at(s: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Of each row of `s` the logarithm of the softmax at one place; `s` is used up."""
    s -= s.max(1, keepdims=True)
    picked = s[np.arange(len(s)), at]
    np.exp(s, out=s)
    return picked - np.log(s.sum(1))


#: Steps from 0 to 1 in which scoring takes the hidden values.
HIDDEN_STEPS = 1024


class Net:
    """Parameters in one flat vector; the last column of `cls` and `word` is the offset, for which `hidden` ends in a one."""

    scoring = False

    def __init__(self, cfg: WindowLm, flat: np.ndarray | None = None):
        self.cfg = cfg
        d = cfg.dim
        shapes = {"embed": (cfg.pad + 1, d), "place": (2 * cfg.side, d), "bias": (d,), "cls": (cfg.classes, d + 1), "word": (cfg.own_classes, cfg.width, d + 1)}
        if flat is None:
            rng = np.random.default_rng(1)
            scale = {"embed": 0.3, "place": 0.5, "cls": 0.1, "word": 0.1}
            start = {k: rng.normal(0, scale.get(k, 0), s) for k, s in shapes.items()}
            start["cls"][..., d] = start["word"][..., d] = 0
            flat = np.concatenate([x.ravel() for x in start.values()]).astype(np.float32)
        self.flat, at = np.array(flat, np.float32), 0
        for k, s in shapes.items():
            n = int(np.prod(s))
            setattr(self, k, self.flat[at : at + n].reshape(s))
            at += n

    def for_scoring(self) -> Net:
        """From now on outputs are sums of multiples of a power of two, small enough that float32 adds them without rounding.
        How a library orders such sums, which differs with the number of rows at once, then can't tell equal texts apart."""
        tops = (self.cls, self.word)
        most = max(1.0, *(float(np.abs(x).sum(-1).max()) for x in tops))
        steps = np.float32(2.0 ** (23 - np.log2(HIDDEN_STEPS) - np.ceil(np.log2(most))))
        for x in tops:
            x[...] = np.rint(x * steps) / steps
        self.scoring = True
        return self

    def embedded(self, context: np.ndarray) -> np.ndarray:
        """(2 * side, n, dim)"""
        return self.embed.take(context.ravel(), axis=0).reshape(*context.shape, self.cfg.dim)

    def hidden(self, e: np.ndarray) -> np.ndarray:
        h = np.ones((e.shape[1], self.cfg.dim + 1), np.float32)
        z = np.einsum("knd,kd->nd", e, self.place)
        z += self.bias
        np.tanh(z, out=h[:, :-1])
        return h

    def by_class(self, cls: np.ndarray):
        """Rows of own words in the order of their classes, and (class, start, end) of each."""
        own = np.flatnonzero(cls < self.cfg.own_classes)
        order = own[np.argsort(cls[own], kind="stable")]
        return order, [(int(cls[order[a]]), a, b) for a, b in C.runs_of(cls[order])]

    def log_probs(self, ids: np.ndarray, context: np.ndarray, cls: np.ndarray, tail: np.ndarray) -> np.ndarray:
        h = self.hidden(self.embedded(context))
        if self.scoring:
            h = np.rint(h * np.float32(HIDDEN_STEPS)) / np.float32(HIDDEN_STEPS)
        out = log_softmax_at(h @ self.cls.T, cls) + tail
        order, runs = self.by_class(cls)
        hs, t = h[order], np.empty((len(order), self.cfg.width), np.float32)
        for c, a, b in runs:
            np.matmul(hs[a:b], self.word[c].T, out=t[a:b])
        out[order] += log_softmax_at(t, ids[order] % self.cfg.width)
        return out

    @staticmethod
    def _errors(s: np.ndarray, at: np.ndarray, rate: float) -> np.ndarray:
        """`rate` times the softmax of s less the one-hot truth."""
        s -= s.max(1, keepdims=True)
        np.exp(s, out=s)
        s *= rate / s.sum(1, keepdims=True)
        s[np.arange(len(s)), at] -= rate
        return s

    def step(self, ids: np.ndarray, context: np.ndarray, cls: np.ndarray, rate: float) -> None:
        n, d, e = len(ids), self.cfg.dim, self.embedded(context)
        h, rate = self.hidden(e), np.float32(rate / n)
        p = self._errors(h @ self.cls.T, cls, rate)
        dh = p @ self.cls[:, :d]
        self.cls -= 8 * (p.T @ h)
        order, runs = self.by_class(cls)
        hs, t = h[order], np.empty((len(order), self.cfg.width), np.float32)
        for c, a, b in runs:
            np.matmul(hs[a:b], self.word[c].T, out=t[a:b])
        q = self._errors(t, ids[order] % self.cfg.width, rate)
        back = np.empty((len(order), d), np.float32)
        for c, a, b in runs:
            np.matmul(q[a:b], self.word[c][:, :d], out=back[a:b])
            self.word[c] -= 16 * (q[a:b].T @ hs[a:b])
        dh[order] += back
        h = h[:, :d]
        dz = dh * (1 - h * h)
        self.bias -= dz.sum(0)
        # Gradients of all contexts' words, summed by word, a dimension at a time.
        change, flat = np.einsum("knd,nd->kd", e, dz), context.ravel().astype(np.intp)
        turned, scale = np.ascontiguousarray(dz.T), self.place.T.copy()
        for k in range(d):
            self.embed[:, k] -= 16 * np.bincount(flat, (scale[k][:, None] * turned[k]).ravel(), len(self.embed))
        self.place -= change


@dataclass
class Counts:
    """Hashes of the own words; of each counter its band and the logarithm of its share of that band's counts."""

    own: np.ndarray
    band: np.ndarray
    share: np.ndarray

    @staticmethod
    def of(cfg: WindowLm, own: np.ndarray, counts: np.ndarray) -> Counts:
        most = np.log2(max(1, counts.max(initial=0))) + 1
        band = np.minimum(cfg.bands - 1, np.floor(cfg.bands * np.log2(np.maximum(counts, 1)) / most)).astype(np.uint8)
        total = np.bincount(band, counts, cfg.bands)
        return Counts(own, band, np.log(np.maximum(counts, 1) / np.maximum(total[band], 1)).astype(np.float32))


class Places:
    """Hashes of words to places (as context), classes, and the logarithms of the shares within classes by count."""

    def __init__(self, cfg: WindowLm, counts: Counts):
        self.cfg, self.counts, self.order = cfg, counts, np.argsort(counts.own).astype(np.uint16)
        self.sorted = counts.own[self.order]

    def of(self, blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h = np.frombuffer(blob, np.uint32)
        places = (self.cfg.own_words + C.mix(h.astype(np.uint64)) % np.uint64(self.cfg.shared)).astype(np.uint16)
        at = h % np.uint32(len(self.counts.band))
        cls, tail = self.counts.band[at] + np.uint8(self.cfg.own_classes), self.counts.share[at]
        if len(self.sorted):
            k = np.minimum(np.searchsorted(self.sorted, h), len(self.sorted) - 1)
            own = self.sorted.take(k) == h
            places[own] = self.order[k[own]]
            cls[own], tail[own] = places[own] // self.cfg.width, 0
        return places, cls, tail


def windows(cfg: WindowLm, rows: Iterable[tuple[np.ndarray, np.ndarray, np.ndarray]], most: int = 1 << 19):
    """Of texts' (places, classes, shares): (places, contexts, classes, shares, text of each) of all tokens, in stretches of
    about `most` of them; a longer text is cut, with what lies around each cut as context."""
    side, pad = cfg.side, np.full(cfg.side, cfg.pad, np.uint16)
    held: list[tuple] = []

    def out():
        line = np.concatenate([s for s, *_ in held])
        sizes = np.array([len(c) for _, c, _, _ in held])
        first = np.cumsum(np.concatenate([[0], sizes[:-1] + 2 * side])) + side
        at = np.repeat(first - np.cumsum(np.concatenate([[0], sizes[:-1]])), sizes) + np.arange(sizes.sum())
        context = np.stack([line.take(at + k) for k in range(-side, side + 1) if k])
        return line[at], context, np.concatenate([c for _, c, _, _ in held]), np.concatenate([t for _, _, t, _ in held]), np.repeat([k for *_, k in held], sizes)

    n = 0
    for k, (places, cls, tail) in enumerate(rows):
        line = np.concatenate([pad, places, pad])
        for lo in range(0, len(places), most):
            hi = min(lo + most, len(places))
            held.append((line[lo : hi + 2 * side], cls[lo:hi], tail[lo:hi], k))
            n += hi - lo
            if n >= most:
                yield out()
                held, n = [], 0
    if held:
        yield out()


def _encode(batches):
    """(doc_id, text) -> (doc_id, words): each text is cut into words once, which are 32-bit hashes from here on."""
    hashes = C.WordHashes()
    for batch in C.pieces(batches, 200):
        blobs = [hashes.of(C.folded_words(t)).astype(np.uint32).tobytes() for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(blobs, pa.binary())], ["doc_id", "words"])


def _tally(most: int = 4_000_000):
    def run(batches):
        held: list[np.ndarray] = []

        def out():
            words, n = np.unique(np.concatenate([np.zeros(0, np.uint32), *held]), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(words.astype(np.int64)), pa.array(n.astype(np.int64))], ["word", "n"])

        for batch in C.pieces(batches, 200):
            held += [np.frombuffer(blob, np.uint32) for blob in batch.column(0).to_pylist()]
            if sum(map(len, held)) >= most:
                yield out()
                held.clear()
        yield out()

    return run


SUMS = "slot int, part int, weight double, vec binary"


def _train(cfg: WindowLm, counts, flat, round_: int, slot: int = 1024):
    """Each part's parameters after its own rows, times its number of windows, in slots."""

    def run(batches):
        from pyspark import TaskContext

        net, places, total = Net(cfg, flat.value), Places(cfg, counts.value), 0
        rows = (places.of(blob) for batch in C.pieces(batches, 500) for blob in batch.column(0).to_pylist())
        for ids, context, cls, _, _ in windows(cfg, rows):
            order = np.random.default_rng(total + round_).permutation(len(ids))
            for lo in range(0, len(order), cfg.batch):
                k = order[lo : lo + cfg.batch]
                net.step(ids[k], context[:, k], cls[k], cfg.rate / (1 + round_))
            total += len(ids)
        if total:
            part = TaskContext.get().partitionId() % 1024
            slots = np.array_split(net.flat.astype(np.float64) * total, -(-len(net.flat) // slot))
            yield pa.RecordBatch.from_arrays([pa.array(range(len(slots)), pa.int32()), pa.array([part] * len(slots), pa.int32()), pa.array([float(total)] * len(slots)), pa.array([s.astype(np.float32).tobytes() for s in slots], pa.binary())], ["slot", "part", "weight", "vec"])

    return run


def _sum_slots(batches):
    """Sums of the rows of each key, one row after another."""
    for table in C.run_rows(batches, "key", 200):
        keys = table.column("key").to_numpy()
        for a, b in C.runs_of(keys):
            vec = sum(np.frombuffer(x, np.float32).astype(np.float64) for x in table.column("vec").slice(a, b - a).to_pylist())
            yield pa.RecordBatch.from_arrays([table.column("slot").slice(a, 1).combine_chunks(), table.column("part").slice(a, 1).combine_chunks(), pa.array([float(np.sum(table.column("weight").slice(a, b - a).to_numpy()))]), pa.array([vec.astype(np.float32).tobytes()], pa.binary())], ["slot", "part", "weight", "vec"])


def _average(parts: DataFrame) -> np.ndarray:
    by = lambda df, key: df.withColumn("key", key).repartition("key").sortWithinPartitions("key", "part").mapInArrow(_sum_slots, SUMS)
    once = by(parts, F.col("slot") * 1024 + F.col("part"))
    rows = by(once, F.col("slot").cast("int")).toArrow().sort_by("slot")
    return np.concatenate([np.frombuffer(v, np.float32) / w for v, w in zip(rows.column("vec").to_pylist(), rows.column("weight").to_pylist())])


def _score(cfg: WindowLm, counts, flat, most: int = 4096):
    def run(batches):
        net, places = Net(cfg, flat.value).for_scoring(), Places(cfg, counts.value)
        for batch in C.pieces(batches, 100):
            sizes, sums = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows)
            for ids, context, cls, tail, owner in windows(cfg, map(places.of, batch.column(1).to_pylist())):
                logs = np.concatenate([net.log_probs(ids[k : k + most], context[:, k : k + most], cls[k : k + most], tail[k : k + most]) for k in range(0, len(ids), most)])
                sizes += np.bincount(owner, minlength=len(sizes))
                sums += np.bincount(owner, logs.astype(np.float64), len(sizes))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(sizes), pa.array(sums)], ["doc_id", "n_tokens", "sum_log_prob"])

    return run


def vocabulary(coded: DataFrame, cfg: WindowLm) -> tuple[Counts, int]:
    """Counts of all words of the corpus, and the number of its tokens."""
    counts = C.materialize(coded.select("words").mapInArrow(_tally(), "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "counts")
    top = counts.orderBy(F.desc("n"), "word").limit(cfg.own_words)
    own = np.array([r.word for r in top.collect()], np.uint32)
    words, tokens = counts.agg(F.count(F.lit(1)), F.sum("n")).first()
    size = min(cfg.counters, 1 << max(0, words - 1).bit_length())
    rest = counts.join(F.broadcast(top.select(F.col("word").alias("own"))), F.col("word") == F.col("own"), "left_anti")
    found = rest.groupBy((F.col("word") % size).cast("int").alias("at")).agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros(size, np.int64)
    table[found.column("at").to_numpy()] = found.column("n").to_numpy()
    C.release(counts)
    return Counts.of(cfg, own, table), int(tokens or 0)


def dealt(coded: DataFrame, cfg: WindowLm, tokens: int) -> DataFrame:
    """The words of all documents, in parts and an order that their ids and words alone decide."""
    key = F.xxhash64("doc_id", "words")
    parts = max(1, -(-tokens // cfg.part_windows))
    return coded.select("words", key.alias("key")).repartition(parts, "key").sortWithinPartitions("key").select("words")


def pseudo_likelihood(docs: DataFrame, cfg: WindowLm = WindowLm(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each document: doc_id, n_tokens, sum_log_prob, mean_log_prob."""
    docs, sc = C.intake(docs, doc_id=doc_id, text=text), docs.sparkSession.sparkContext
    coded = C.materialize(docs.mapInArrow(_encode, "doc_id long, words binary"), "words")
    found, tokens = vocabulary(coded, cfg)
    counts, flat = sc.broadcast(found), Net(cfg).flat
    for k in range(cfg.rounds if tokens else 0):
        flat = _average(dealt(coded, cfg, tokens).mapInArrow(_train(cfg, counts, sc.broadcast(flat), k), SUMS))
    scored = coded.mapInArrow(_score(cfg, counts, sc.broadcast(flat)), "doc_id long, n_tokens long, sum_log_prob double")
    return scored.withColumn("mean_log_prob", F.when(F.col("n_tokens") > 0, F.col("sum_log_prob") / F.col("n_tokens")))
