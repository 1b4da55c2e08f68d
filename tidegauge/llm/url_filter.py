"""URL filter: a blocked Bloom filter of listed canonical URLs passes possible hits to an exact hash join.

A URL is judged by the longest fitting rule; where no rule fits, it is blocked if its canonical form is listed.
Canonical form: host without `www.` and the path without `.html` and final slashes, in lower-case hosts; query and
fragment don't count. The filter has blocks of 512 bits (eight words); a key sets one bit in each word of its block.

Defined results: null URLs and those without `://` have an empty host and path, fit no rule, are not listed and so
allowed; null list entries are no entries; repeated rows are each judged; an empty list blocks nothing; empty pages give no rows;
columns other than the named ones are never read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C
from .decontaminate import LOWER, UPPER

#: The rules of the contract: (verdict, host, path).
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path; both empty for null or without `://`."""
    rest = F.when(F.contains(url, F.lit("://")), F.regexp_replace(url, r"(?s)^.*?://", ""))
    host = F.translate(F.regexp_extract(rest, r"(?s)^[^/?#]*", 0), UPPER, LOWER)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def canonical(host: Column, path: Column) -> Column:
    """Null where there is no host."""
    return F.when(host != "", F.concat(F.regexp_replace(host, r"^www\.", ""), F.regexp_replace(F.regexp_replace(path, r"\.html$", ""), r"/+$", "")))


class BlockedBloom:
    """512-bit blocks; `bits` filter bits for each key, fewer where the filter would grow beyond `most_bytes`: then more keys
    pass that the exact join has to sort out."""

    def __init__(self, words: np.ndarray):
        self.words = words.reshape(-1, 8)

    @staticmethod
    def places(hashes: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
        """The block of each key, and the bit it sets in each of the block's eight words."""
        h = hashes.view(np.uint64)
        block = ((h >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)
        bits = (C.mix(h)[:, None] >> (np.arange(8, dtype=np.uint64) * np.uint64(6))) & np.uint64(63)
        return block.astype(np.int64), np.uint64(1) << bits

    @classmethod
    def build(cls, hashes: DataFrame, keys: int, bits: int = 12, most_bytes: int = 64 << 20) -> BlockedBloom:
        """`hashes` has one long column h. Its partitions' blocks are united in the cluster; the driver gets the filter alone."""
        blocks = max(1, min(-(-keys * bits // 512), most_bytes // 64))

        def run(frames):
            for frame in frames:
                block, masks = cls.places(frame["h"].to_numpy(np.int64), blocks)
                own, at = np.unique(block, return_inverse=True)
                words = np.zeros((len(own), 8), np.uint64)
                for k in range(8):
                    np.bitwise_or.at(words[:, k], at, masks[:, k])
                yield pd.DataFrame({"block": own, **{f"w{k}": words[:, k].view(np.int64) for k in range(8)}})

        parts = hashes.mapInPandas(run, "block long, " + ", ".join(f"w{k} long" for k in range(8)))
        rows = parts.groupBy("block").agg(*[F.bit_or(f"w{k}").alias(f"w{k}") for k in range(8)]).toPandas()
        words = np.zeros((blocks, 8), np.uint64)
        words[rows["block"].to_numpy(np.int64)] = rows[[f"w{k}" for k in range(8)]].to_numpy(np.int64).view(np.uint64)
        return cls(words)

    def passed(self, df: DataFrame, hashed: Column) -> DataFrame:
        """The rows whose hash the filter may hold."""
        words = df.sparkSession.sparkContext.broadcast(self.words)

        @F.pandas_udf("boolean")
        def may_hold(h: pd.Series) -> pd.Series:
            return pd.Series(BlockedBloom(words.value).may_hold(h.to_numpy(np.int64)))

        return df.filter(may_hold(hashed))

    def may_hold(self, hashes: np.ndarray) -> np.ndarray:
        block, masks = self.places(hashes, len(self.words))
        return ((self.words[block] & masks) == masks).all(1)


def listed(urls: DataFrame, blocklist: DataFrame, most_filter_bytes: int = 64 << 20, bits: int = 12) -> DataFrame:
    """`urls` (with a column canon) and is_listed: whether the blocklist (a column canon) has it. The filter, of
    `most_filter_bytes` at most, is sent to all executors; what it lets pass is joined exactly."""
    entries = C.materialize(blocklist.select(F.col("canon").alias("entry")).filter("entry is not null").distinct(), "blocklist")
    bloom = BlockedBloom.build(entries.select(F.xxhash64("entry").alias("h")), entries.count(), bits, most_filter_bytes)
    possible = bloom.passed(urls.filter("canon is not null"), F.xxhash64("canon"))
    # Each possible URL is looked up once, however many pages share it.
    hits = possible.select("canon").distinct().join(entries, F.col("canon") == F.col("entry"), "left_semi").select(F.col("canon").alias("hit"))
    hits = C.materialize(hits, "listed")
    return urls.join(hits, F.col("canon") == F.col("hit"), "left").withColumn("is_listed", F.col("hit").isNotNull()).drop("hit")


def filter_urls(pages: DataFrame, blocklist: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, page_id: str = "page_id", url: str = "url", list_url: str = "url") -> DataFrame:
    """One row for each page: page_id, host, path, rule, verdict, is_listed. `blocklist` has raw URLs in `list_url`."""
    at = lambda df, name: split_url(df[name])
    host, path = at(pages, url)
    judged = pages.select(pages[page_id].alias("page_id"), host.alias("host"), path.alias("path"))
    bad_host, bad_path = at(blocklist, list_url)
    entries = blocklist.select(bad_host.alias("host"), bad_path.alias("path")).select(canonical(F.col("host"), F.col("path")).alias("canon"))
    judged = listed(judged.withColumn("canon", canonical(F.col("host"), F.col("path"))), entries)
    verdict = rule = None
    # Longest rule first: the first that fits decides.
    for what, rule_host, rule_path in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((F.col("host") == rule_host) | F.endswith("host", F.lit("." + rule_host))) & F.startswith("path", F.lit(rule_path))
        verdict = F.when(fits, F.lit(what)) if verdict is None else verdict.when(fits, F.lit(what))
        rule = F.when(fits, F.lit(rule_host + rule_path)) if rule is None else rule.when(fits, F.lit(rule_host + rule_path))
    own = F.when(F.col("is_listed"), F.lit("block")).otherwise(F.lit("allow"))
    return judged.select("page_id", "host", "path", (F.lit(None).cast("string") if rule is None else rule).alias("rule"), (own if verdict is None else F.coalesce(verdict, own)).alias("verdict"), "is_listed")
