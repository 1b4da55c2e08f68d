r"""Token counts: pieces are counted once per distinct pre-token, joined to the documents' pre-token frequencies and summed.

A pre-token is a run of spaces with the characters up to the next space or line feed. No piece of such a vocabulary
holds a space behind another character, and none holds a line feed, so merges never cross a pre-token (both are checked
when the model is read). The most frequent pre-tokens, bounded in number and length, are sent to all executors; the
others, which are rare, are dealt out by a shuffle. Very long texts are taken whole. Ids are never kept.

Defined results: null texts are empty and have no tokens; rows that repeat an id are counted each; no rows of an empty
table; columns other than the named ones are never read. Model files are read on the driver and sent along, so executors need no such file.
"""

from __future__ import annotations

import re
from collections import Counter
from pathlib import Path

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

SPACE = "▁"
PRE_TOKEN = re.compile(r"\n|[ ▁]*[^ ▁\n]+|[ ▁]+")


def pre_tokens(text: str) -> list[str]:
    """Keys of the pre-tokens. One leading space is implied, as the model puts one before each text; a key that begins
    with a line feed is a line feed and what follows it without a space."""
    if not text:
        return []
    if "  " not in text and " \n" not in text and text[0] not in " \n" and text[-1] != " " and SPACE not in text:
        return text.replace("\n", " \n").split(" ")
    keys: list[str] = []
    for token in PRE_TOKEN.findall(" " + text):
        if token[0] in " ▁":
            keys.append(token[1:].replace(SPACE, " "))
        elif token != "\n" and keys and keys[-1] == "\n":
            keys[-1] += token
        else:
            keys.append(token)
    return keys


class PieceCounter:
    """Number of pieces of pre-token keys."""

    def __init__(self, model: bytes):
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)

    def separable(self) -> bool:
        pieces = [self.model.id_to_piece(k) for k in range(self.model.get_piece_size())]
        return not any(SPACE in p.lstrip(SPACE) or "\n" in p for p in pieces) and len(self.model.encode("\n")) == 2

    def counts(self, keys: list[str]) -> list[int]:
        found = self.model.encode(keys, num_threads=1) if keys else []
        # The model puts a space before each text: it belongs to a key, but not before a line feed. A lone space is the empty key.
        return [len(ids) - 1 if key[:1] == "\n" else len(ids) or 1 for key, ids in zip(keys, found)]


def _tally(most: int = 300_000):
    """Texts -> (key, freq), summed as far as memory allows."""

    def run(batches):
        seen: Counter = Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], ["key", "freq"])

        for batch in C.pieces(batches, 200):
            for text in batch.column(0).to_pylist():
                if text:
                    seen.update(pre_tokens(text))
            if len(seen) >= most:
                yield out()
                seen.clear()
        yield out()

    return run


def _count_pieces(model: bytes):
    def run(batches):
        counter = PieceCounter(model)
        for batch in C.pieces(batches, 5000):
            keys = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counter.counts(keys), pa.int64())], ["key", "freq", "pieces"])

    return run


def _look_up(head):
    """(doc_id, text) -> the sum over keys that `head` has, and the frequencies of the others."""
    kind = pa.list_(pa.struct([("key", pa.string()), ("freq", pa.int64())]))

    def run(batches):
        get = dict(zip(*head.value)).get
        for batch in C.pieces(batches, 200):
            sums, rest = [], []
            for text in batch.column(1).to_pylist():
                keys = pre_tokens(text or "")
                found = list(map(get, keys))
                sums.append(sum(filter(None, found)))
                rest.append([{"key": k, "freq": n} for k, n in Counter(k for k, p in zip(keys, found) if p is None).items()] if None in found else [])
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(2).cast(pa.int64()), pa.array(sums, pa.int64()), pa.array(rest, kind)], ["doc_id", "n_bytes", "known", "rest"])

    return run


def head(pieces: DataFrame, most: int) -> DataFrame:
    """(key, pieces) of the most frequent keys, `most` at most: those above a cutoff, which a histogram of the frequencies'
    logarithms gives (64 steps to the doubling), so that nothing is sorted and no task gathers more than that."""
    step = F.floor(F.log2("freq") * 64).cast("int")
    steps = sorted(pieces.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n")).collect(), reverse=True)
    held, cut = 0, None
    for at, n in steps:
        held += n
        if held > most:
            break
        cut = at
    return pieces.filter(step >= cut if cut is not None else F.lit(False)).select("key", "pieces")


def token_counts(docs: DataFrame, model: str | bytes, limit: int = 4096, head_keys: int = 250_000, head_key_chars: int = 32, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each document: doc_id, n_bytes, n_tokens, over_limit. `model`: path or content of a sentencepiece file."""
    proto = model if isinstance(model, bytes) else Path(model).read_bytes()
    if not PieceCounter(proto).separable():
        raise ValueError("pieces of this model cross pre-tokens; they can't be counted one by one")
    docs = C.intake(docs, doc_id=doc_id, text=text)
    freq = docs.select("text").mapInArrow(_tally(), "key string, freq long").groupBy("key").agg(F.sum("freq").alias("freq"))
    pieces = C.materialize(freq.mapInArrow(_count_pieces(proto), "key string, freq long, pieces long"), "pieces")
    top = head(pieces.filter(F.length("key") <= head_key_chars), head_keys).toArrow()
    sent = docs.sparkSession.sparkContext.broadcast((top.column("key").to_pylist(), top.column("pieces").to_pylist()))
    sized = docs.select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    known = sized.mapInArrow(_look_up(sent), "doc_id long, n_bytes long, known long, rest array<struct<key: string, freq: long>>")
    known = C.materialize(known.withColumn("row", F.monotonically_increasing_id()), "known")
    rest = known.select("row", F.explode("rest").alias("t")).select("row", "t.key", "t.freq")
    rare = rest.join(pieces.select("key", "pieces"), "key").groupBy("row").agg(F.sum(F.col("freq") * F.col("pieces")).alias("more"))
    total = known.select("row", "doc_id", "n_bytes", "known").join(rare, "row", "left")
    n = F.col("known") + F.coalesce("more", F.lit(0).cast("long"))
    return total.select("doc_id", "n_bytes", n.alias("n_tokens"), (n > limit).alias("over_limit"))
