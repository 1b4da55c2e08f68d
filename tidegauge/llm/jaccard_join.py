"""N-gram Jaccard self-join by chosen paths.

Each text becomes the set of its word shingles. A run samples one shared token of every set (the least
under that run's hash); sets that sampled the same token meet in a bucket. A bucket that is too large is
split again on further sampled tokens; the rest is compared by brute force, in blocks of bounded size.
Two sets of similarity s meet in a run with probability s, so runs are repeated at every level until the
chance to meet reaches `target_recall` at the threshold.

Defined results: null and wordless texts have no shingles, no links and a class of their own; fewer words
than a shingle are one shingle; texts with equal shingle sets are copies (one representative, linked to each
other); an empty table gives no rows; a null id keeps its row, with a null class unless it has copies with ids.
A set is named by a number of its own, not by an id, so rows that repeat an id with different texts are members each
with their own links, and rows that repeat both are copies. Very long texts are taken whole; blocks are bounded in
shingles as well as in rows. Links that are equal in similarity all count. Only the named columns are read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .url_filter import BlockedBloom


@dataclass(frozen=True)
class ChosenPaths:
    """width: words of a shingle. levels: how often a bucket may be split. split_above: rows of a bucket that is
    split rather than compared. block, block_shingles: rows, and about how many shingles, that one brute-force task takes
    from each side. sketch: 16-bit
    min-hashes that a pair is held against before its sets are read; a pair is dropped when it agrees on fewer
    than six standard deviations below what the threshold predicts."""

    width: int = 5
    threshold: float = 0.8
    target_recall: float = 0.9999
    levels: int = 3
    split_above: int = 8192
    block: int = 1024
    block_shingles: int = 2_000_000
    sketch: int = 64

    @property
    def runs(self) -> int:
        """Repetitions at each level, so that all levels together miss 1 - target_recall at most."""
        return max(1, math.ceil(math.log((1 - self.target_recall) / self.levels) / math.log(1 - self.threshold)))

    @property
    def agreements(self) -> int:
        mean = self.sketch * self.threshold
        return max(1, math.floor(mean - 6 * math.sqrt(mean * (1 - self.threshold))))


SIGNED = "doc_id long, h long, n long, fp1 long, fp2 long, path array<long>, sketch binary"


def _fingerprint(tokens: np.ndarray) -> np.ndarray:
    """128 bits that don't depend on the order."""
    return np.array([C.mix(tokens).sum(dtype=np.uint64), C.mix(tokens ^ np.uint64(0x9E3779B97F4A7C15)).sum(dtype=np.uint64)], np.uint64)


def _sign(plan: ChosenPaths):
    """(doc_id, text, hash of the text) -> SIGNED."""
    n_path = plan.levels * plan.runs
    seeds = np.random.default_rng(7).integers(1, 2**63, max(n_path, plan.sketch), dtype=np.uint64) | np.uint64(1)

    def run(batches):
        hashes = C.WordHashes()
        for batch in C.pieces(batches, 200):
            texts = batch.column(1).to_pylist()
            sets = [C.shingle_hashes(hashes.of(C.folded_words(t)), plan.width) for t in texts]
            sizes = np.array([len(s) for s in sets], np.int64)
            full = np.flatnonzero(sizes)
            fps = np.stack([_fingerprint(s) for s in sets]).T if sets else np.zeros((2, 0), np.uint64)
            least = np.zeros((len(seeds), len(sets)), np.uint64)
            if len(full):
                tokens, starts = np.concatenate([sets[k] for k in full]), np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
                for k, seed in enumerate(seeds):
                    least[k, full] = np.minimum.reduceat((tokens ^ (seed >> np.uint64(7))) * seed, starts)
            least = C.mix(least)
            sketch = np.ascontiguousarray(least[: plan.sketch].astype(np.uint16).T)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), batch.column(2), pa.array(sizes), pa.array(np.ascontiguousarray(fps[0]).view(np.int64)), pa.array(np.ascontiguousarray(fps[1]).view(np.int64)), C.flat_int64(np.ascontiguousarray(least[:n_path].T).view(np.int64).ravel(), np.full(len(sets), n_path)), pa.array([row.tobytes() for row in sketch], pa.binary())],
                ["doc_id", "h", "n", "fp1", "fp2", "path", "sketch"],
            )

    return run


SET = ["least", "n", "fp1", "fp2"]


def _shingles(plan: ChosenPaths):
    """(doc_id, text) -> SET and tokens."""

    def run(batches):
        hashes = C.WordHashes()
        for batch in C.pieces(batches, 200):
            sets = [C.shingle_hashes(hashes.of(C.folded_words(t)), plan.width) for t in batch.column(1).to_pylist()]
            fps = [_fingerprint(s).view(np.int64).tolist() for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()), *[pa.array([f[k] for f in fps], pa.int64()) for k in (0, 1)], pa.array([s.tobytes() for s in sets], pa.binary())], [*SET, "tokens"])

    return run


def _meets_here(first: list[int], paths: np.ndarray, a: slice, runs: int) -> np.ndarray:
    """Pairs (rows of `a`, all rows) whose first agreement at each level is this bucket's: each pair counts in one bucket."""
    ok = np.ones((a.stop - a.start, len(paths)), bool)
    for level, at in enumerate(first):
        for k in range(level * runs, level * runs + at):
            ok &= paths[a, k][:, None] != paths[None, :, k]
    return ok


def _may_link(plan: ChosenPaths, n, paths, block, first, a: slice, across: bool) -> np.ndarray:
    ok = _meets_here(first, paths, a, plan.runs)
    low, high = np.minimum(n[a, None], n[None]), np.maximum(n[a, None], n[None])
    ok &= low >= plan.threshold * high - 1e-9
    if across:
        ok &= block[a, None] != block[None]
    ok[np.arange(a.stop - a.start), np.arange(a.start, a.stop)] = False
    return ok


def _groups(table: pa.Table):
    col = lambda name: table.column(name).to_numpy(zero_copy_only=False)
    lists = table.column("path").combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    paths = lists.flatten().to_numpy().reshape(table.num_rows, -1)
    yield from ((a, b, col, paths) for a, b in C.runs_of(col("task")))


def _candidates(plan: ChosenPaths):
    """Members of each task that agree with another member on enough of the sketch."""

    def run(batches):
        for table in C.run_rows(batches, "task"):
            sketches = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint16).reshape(table.num_rows, -1)
            n, block, across = (table.column(c).to_numpy(zero_copy_only=False) for c in ("n", "block", "across"))
            firsts = table.column("first").to_pylist() if table.num_rows else []
            keep = np.zeros(table.num_rows, bool)
            for a, b, _, paths in _groups(table):
                if b - a < 2:
                    continue
                sk, p = sketches[a:b], paths[a:b]
                for lo in range(0, b - a, 64):
                    part = slice(lo, min(lo + 64, b - a))
                    ok = _may_link(plan, n[a:b], p, block[a:b], firsts[a], part, bool(across[a]))
                    if ok.any():
                        ok &= (sk[part, None, :] == sk[None]).sum(-1, dtype=np.int16) >= plan.agreements
                        keep[a + part.start : a + part.stop] |= ok.any(1)
            if keep.any():
                out = table.filter(pa.array(keep)).select(["task", "rep", *SET, "weight", "block", "across", "first", "path"])
                yield from out.to_batches()

    return run


def _overlaps(sets: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """Sizes of all intersections: products of 0/1 matrices over the tokens that two sets or more hold."""
    tokens = np.concatenate(sets)
    rows = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, ids, df = np.unique(tokens, return_inverse=True, return_counts=True)
    rank = np.cumsum(df > 1) - 1
    shared = df[ids] > 1
    rows, ids = rows[shared], rank[ids[shared]]
    order = np.argsort(ids, kind="stable")
    rows, ids = rows[order], ids[order]
    total = np.zeros((len(sets), len(sets)), np.float32)
    for lo in range(0, int(ids[-1]) + 1 if len(ids) else 0, columns):
        s, e = np.searchsorted(ids, [lo, lo + columns])
        x = np.zeros((len(sets), min(columns, int(ids[-1]) + 1 - lo)), np.float32)
        x[rows[s:e], ids[s:e] - lo] = 1
        total += x @ x.T
    return total


def _verified(plan: ChosenPaths):
    """Exact links of each task: for every linked member its least linked relative there and its link counts."""

    def run(batches):
        for table in C.run_rows(batches, "task", 500):
            n, block, across, weight, rep = (table.column(c).to_numpy(zero_copy_only=False) for c in ("n", "block", "across", "weight", "rep"))
            firsts, blobs = table.column("first").to_pylist(), table.column("tokens").to_pylist()
            out = []
            for a, b, _, paths in _groups(table):
                order = a + np.unique(rep[a:b], return_index=True)[1]
                m = len(order)
                if m < 2:
                    continue
                linked = _may_link(plan, n[order], paths[order], block[order], firsts[a], slice(0, m), bool(across[a]))
                if not linked.any():
                    continue
                sets = [np.frombuffer(blobs[k], np.uint64) for k in order]
                if m == 2:
                    common = np.full((2, 2), len(np.intersect1d(*sets, assume_unique=True)), np.float64)
                else:
                    common = _overlaps(sets)
                linked &= (1 + plan.threshold) * common >= plan.threshold * (n[order, None] + n[None, order]) - 1e-6
                label = np.arange(m)
                while True:
                    new = np.minimum(label, np.where(linked, label[None], m).min(1))
                    new = new[new]
                    if (new == label).all():
                        break
                    label = new
                hit = np.flatnonzero(linked.any(1))
                out.append((rep[order][hit], rep[order][label[hit]], linked.sum(1)[hit], (linked @ weight[order])[hit]))
            if out:
                cols = [np.concatenate(x).astype(np.int64) for x in zip(*out)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["rep", "root", "texts", "docs"])

    return run


def connected(edges: DataFrame) -> DataFrame:
    """(u, v) -> (u, root): alternating large and small stars until the edges no longer change; all in the cluster."""

    def star(pairs: DataFrame, large: bool) -> DataFrame:
        both = pairs.union(pairs.select("v", "u")) if large else pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("u", "m").alias("m"))
        met = both.join(least, F.col("u") == F.col("c"))
        if large:
            return met.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        return met.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select(F.col("c").alias("u"), F.col("m").alias("v"))).filter("u <> v").distinct()

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    now = C.materialize(edges.filter("u <> v").distinct(), "edges")
    before = state(now)
    while True:
        after = C.materialize(star(star(now, True), False), "edges")
        C.release(now)
        now, seen = after, state(after)
        if seen == before:
            return now.select("u", F.col("v").alias("root"))
        before = seen


def _buckets(reps: DataFrame, plan: ChosenPaths) -> DataFrame:
    """(task, rep, block, across, first): who is compared with whom; oversized buckets are split level by level."""
    r = plan.runs
    leaves, rows = [], None
    for level in range(plan.levels):
        if rows is None:
            found = reps.select("rep", "n", F.posexplode(F.slice("path", 1, r)).alias("c", "token")).select(F.xxhash64("c", "token").alias("bucket"), F.array("c").alias("first"), "rep", "n")
        else:
            found = rows.join(reps.select("rep", F.slice("path", level * r + 1, r).alias("path")), "rep").select("rep", "n", "bucket", "first", F.posexplode("path").alias("c", "token"))
            found = found.select(F.xxhash64("bucket", "c", "token").alias("bucket"), F.concat("first", F.array("c")).alias("first"), "rep", "n")
        size = found.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("shingles")).filter("size > 1")
        met = C.materialize(found.join(size, "bucket"), f"level{level}")
        last = level == plan.levels - 1
        leaves.append(met if last else met.filter(F.col("size") <= plan.split_above))
        rows = None if last else met.filter(F.col("size") > plan.split_above)
        if last or rows.isEmpty():
            break
    leaf = leaves[0]
    for more in leaves[1:]:
        leaf = leaf.union(more)
    blocks = F.least(F.col("size"), F.ceil(F.greatest(F.col("size") / plan.block, F.col("shingles") / plan.block_shingles)))
    dealt = leaf.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("rep", F.lit(3)), F.col("blocks")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    return dealt.select(F.xxhash64("bucket", F.least("block", "other"), F.greatest("block", "other")).alias("task"), "rep", "block", (F.col("block") != F.col("other")).alias("across"), "first")


def _only(docs: DataFrame, ids: DataFrame, broadcast_ids: int = 1_000_000) -> DataFrame:
    """Documents of the given ids. Ids are counted first: few are broadcast; more make a Bloom filter of bounded size, so that
    the exact join that follows doesn't deal out the texts of all other documents."""
    n = ids.count()
    if n <= broadcast_ids:
        return docs.join(F.broadcast(ids), "doc_id", "left_semi")
    bloom = BlockedBloom.build(ids.select(F.xxhash64("doc_id").alias("h")), n)
    return bloom.passed(docs, F.xxhash64("doc_id")).join(ids, "doc_id", "left_semi")


def _joined(docs: DataFrame, plan: ChosenPaths) -> DataFrame:
    """doc_id, h (hash of the text), the columns of jaccard_join(), and stays: whether it has the id and the set that its
    class is named by."""
    signed = C.materialize(docs.select("doc_id", "text", F.xxhash64("text").alias("h")).mapInArrow(_sign(plan), SIGNED), "signed")
    same = ["n", "fp1", "fp2"]
    sets = signed.filter("n > 0").groupBy(*same).agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("weight"), F.first("path").alias("path"), F.first("sketch").alias("sketch"))
    # Numbers are given once, as the table is written.
    sets = C.materialize(sets.withColumn("rep", F.monotonically_increasing_id()), "sets")
    reps = sets.filter("least is not null")

    wide = reps.select("rep", *SET, "weight", "path", "sketch")
    met = _buckets(reps, plan).join(wide, "rep").select("task", "rep", *SET, "weight", "block", "across", "first", "path", "sketch")
    near = met.repartition("task").sortWithinPartitions("task").mapInArrow(_candidates(plan), "task long, rep long, least long, n long, fp1 long, fp2 long, weight long, block long, across boolean, first array<int>, path array<long>")
    near = C.materialize(near, "near")
    texts = _only(docs, near.select(F.col("least").alias("doc_id")).distinct())
    tokens = texts.select("doc_id", "text").mapInArrow(_shingles(plan), "least long, n long, fp1 long, fp2 long, tokens binary").dropDuplicates(SET)
    dealt = near.join(tokens, SET).select("task", "rep", "n", "weight", "block", "across", "first", "path", "tokens")
    links = C.materialize(dealt.repartition("task").sortWithinPartitions("task").mapInArrow(_verified(plan), "rep long, root long, texts long, docs long"), "links")

    classes = C.materialize(connected(links.select(F.col("rep").alias("u"), F.col("root").alias("v"))).select(F.col("u").alias("rep"), "root"), "classes")
    members = classes.union(classes.select(F.col("root").alias("rep"), "root").distinct()).join(reps.select("rep", *SET), "rep")
    head = members.groupBy("root").agg(F.min(F.struct("least", "fp1", "fp2")).alias("head"))
    named = members.select("rep", "root").join(head, "root").select("rep", "head")
    counts = links.groupBy("rep").agg(F.sum("texts").alias("texts"), F.sum("docs").alias("docs"))
    known = sets.select(*same, "rep", "least", "weight").join(named, "rep", "left").join(counts, "rep", "left")
    known = known.withColumn("head", F.coalesce("head", F.struct("least", "fp1", "fp2")))
    known = known.select(*[F.col(c).alias(f"k_{c}") for c in same], "weight", "head", "texts", "docs")
    full = signed.select("doc_id", "h", *same).join(known, [F.col(c) == F.col(f"k_{c}") for c in same], "left")
    copies = F.coalesce("weight", F.lit(1).cast("long"))
    return full.select(
        "doc_id", "h", F.coalesce("head.least", "doc_id").alias("class_id"), (copies - 1 + F.coalesce("docs", F.lit(0).cast("long"))).alias("n_links"),
        F.coalesce("texts", F.lit(0).cast("long")).alias("n_text_links"), F.col("n").alias("n_shingles"), copies.alias("n_copies"),
        F.coalesce(F.struct(F.col("doc_id").alias("least"), "fp1", "fp2") == F.col("head"), F.lit(True)).alias("stays"),
    )


def jaccard_join(docs: DataFrame, plan: ChosenPaths = ChosenPaths(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each document: doc_id, class_id (least id of all that links connect with it), n_links (other
    documents of similarity `threshold` or more, copies included), n_text_links (the same, of different shingle
    sets, each counted once), n_shingles and n_copies (documents with its shingle set, itself included)."""
    return _joined(C.intake(docs, doc_id=doc_id, text=text), plan).drop("h", "stays")


def keep_one(docs: DataFrame, plan: ChosenPaths = ChosenPaths(), broadcast_rows: int = 1_000_000) -> DataFrame:
    """One document of each class, of its least id, with all its columns; rows with a null id or no words all stay. Rows are
    told apart by id and text; of rows alike in both one stays."""
    joined = C.materialize(_joined(C.intake(docs, doc_id="doc_id", text="text"), plan).filter("doc_id is not null and n_shingles > 0"), "joined")
    named = lambda df: df.select(F.col("doc_id").alias("d_id"), F.col("h").alias("d_h"))
    drop = C.materialize(named(joined.filter("not stays")).distinct(), "drop")
    twice = C.materialize(named(joined.filter("stays").groupBy("doc_id", "h").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")), "twice")
    is_it = (F.col("doc_id") == F.col("d_id")) & (F.xxhash64("text") == F.col("d_h"))
    small = lambda df: F.broadcast(df) if df.count() <= broadcast_rows else df
    kept = docs.join(small(drop), is_it, "left_anti").select(*docs.columns)
    if twice.isEmpty():
        return kept
    alike = kept.join(small(twice), is_it, "left_semi").select(*docs.columns).dropDuplicates(["doc_id", "text"])
    return kept.join(small(twice), is_it, "left_anti").select(*docs.columns).union(alike)
