"""Shared helpers of the text operators: shared-folder tables, word hashing, column intake."""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of the near-duplicate and decontamination operators, after lower-casing A-Z.
FOLDED_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: What lies between those words.
NO_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Words between ASCII white space.
SPACED_WORD = r"[^\x20\x09-\x0D]+"
SPACE_RUN = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a new local folder, which only
    a session in one process can share; on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="tidegauge-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write `df` as Parquet into the shared folder and read it back with the same schema."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def release(df: DataFrame) -> None:
    """Delete a table made by materialize() that nothing reads any more."""
    if path := getattr(df, "written_to", None):
        jvm = df.sparkSession.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def intake(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under the operator's own names: extra or clashing columns never matter."""
    return df.select(*[df[old].alias(new) for new, old in columns.items()])


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """crc32 of the id as text leaves no remainder: rows whose labels nothing may learn from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds == 0


def unit_hash(doc_id: Column, seed: str) -> Column:
    """A reproducible uniform number in [0, 1) for each id."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed), doc_id.cast("string"))), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


class WordHashes(dict):
    """word -> 64-bit hash; forgets everything when it has grown to `most` words."""

    def __init__(self, most: int = 200_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: str) -> int:
        if len(self) >= self.most:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return value

    def of(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that every bit of the result depends on every bit of x."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingle_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """Distinct hashes of all runs of `width` words; fewer words, but not none, are one run."""
    n = len(hashes)
    if not n:
        return hashes
    width = min(width, n)
    h = np.zeros(n - width + 1, np.uint64)
    for k in range(width):
        h = mix(h + hashes[k : n - width + 1 + k] + np.uint64(k + 1))
    return np.unique(h)


def folded_words(text: str | None, find=re.compile(FOLDED_WORD).findall) -> list[str]:
    """Words of a whole text after lower-casing; none for null."""
    return find(text.lower()) if text else []


def pieces(batches, rows: int = 500):
    """Arrow batches in smaller slices, to bound what Python holds at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def flat_int64(values: np.ndarray, counts) -> pa.Array:
    """A list<int64> column from its flat values and each row's length."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(values.astype(np.int64)))


def run_rows(batches, key: str, most_rows: int = 2000):
    """Of batches sorted by `key`: pa.Tables, each with whole runs of the key only."""
    held: list[pa.RecordBatch] = []

    def table(parts):
        return pa.Table.from_batches(parts).combine_chunks()

    for batch in pieces(batches, most_rows):
        if not batch.num_rows:
            continue
        keys = batch.column(batch.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        if held:
            before = held[-1].column(held[-1].schema.get_field_index(key))[-1].as_py()
            if before != keys[0]:
                yield table(held)
                held = []
            elif not len(starts):
                held.append(batch)
                continue
            else:
                yield table([*held, batch.slice(0, starts[0])])
                batch, held = batch.slice(starts[0]), []
                starts = starts[1:] - starts[0]
        cut = int(starts[-1]) if len(starts) else 0
        if cut:
            yield table([batch.slice(0, cut)])
        held = [batch.slice(cut)]
    if held:
        yield table(held)


def runs_of(keys: np.ndarray):
    """(start, end) of each run of equal neighbours."""
    cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
    return zip(cuts[:-1], cuts[1:]) if len(keys) else ()


def flat_float64(rows: np.ndarray) -> pa.Array:
    """A list<double> column from a matrix."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * rows.shape[1], pa.int32()), pa.array(np.ascontiguousarray(rows, np.float64).ravel()))
