"""Sharding by proportional stratified interleaving, with built-in expressions only.

The rows of each source are put into a seeded order; the row of rank r among n gets the fraction (r + u) / n, where u is a
seeded number in (0, 1) of the source. All rows sorted by that fraction interleave the sources in proportion, and sources
of few rows spread evenly, so equal cuts of that order have the mixture of the whole. Ranks come from counts of narrow
hash ranges and of rows within such a range, so that neither a source nor the whole order is ever sorted in one task.

Defined results: a null source is a source of its own; null texts have no bytes; ties of the order (equal fractions) go by
source; rows that repeat id and text are placed each, wherever their hash with a row number puts them; rows with a null
id go by their text's hash; very long texts count by their bytes alone; an empty table gives no rows; with fewer rows than
shards some shards stay empty; columns other than the named ones are never read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as C


def _ranked(df: DataFrame, within: list[str], cell: Column, order: list, name: str) -> DataFrame:
    """Adds `name`: the rank from 0 in `order` within `within`; `cell` is monotonous in `order`, and few rows share one."""
    df = df.withColumn("cell", cell)
    count = df.groupBy(*within, "cell").agg(F.count(F.lit(1)).alias("c"))
    # Cells are few against rows, but they too are summed in two steps: within a block of cells, then over blocks.
    count = count.withColumn("block", F.floor(F.col("cell") / 1024))
    block = count.groupBy(*within, "block").agg(F.sum("c").alias("b"))
    block = block.withColumn("b", F.coalesce(F.sum("b").over(Window.partitionBy(*within).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inner = F.coalesce(F.sum("c").over(Window.partitionBy(*within, "block").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    count = count.withColumn("i", inner).select(*within, "block", "cell", "i")
    same = lambda a, b, keys: [a[k].eqNullSafe(b[k]) for k in keys]
    start = count.join(block, same(count, block, [*within, "block"])).select(*[count[k] for k in within], count["cell"], (F.col("i") + F.col("b")).alias("before"))
    start = start.select(*[F.col(k).alias(f"s_{k}") for k in [*within, "cell"]], "before")
    place = F.row_number().over(Window.partitionBy(*within, "cell").orderBy(*order)) - 1
    ranked = df.withColumn("place", place).join(start, [F.col(k).eqNullSafe(F.col(f"s_{k}")) for k in [*within, "cell"]])
    return ranked.withColumn(name, F.col("before") + F.col("place")).drop("cell", "before", "place", *[f"s_{k}" for k in [*within, "cell"]])


def interleave(docs: DataFrame, shards: int = 40, seed: str = "tidegauge", rows_per_cell: int = 2000, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """One row for each document: doc_id, source, size, text_crc32, law, shard, slot, grown_shard (null: the law is `rows`)."""
    docs = C.intake(docs, doc_id=doc_id, text=text, source=source)
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 16
    slim = docs.select("doc_id", "source", size.alias("size"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"), F.monotonically_increasing_id().alias("row"))
    slim = C.materialize(slim, "rows")
    # Rows alike in id and text are told apart by the numbers they were written with, as one hash would put them into one cell.
    alike = slim.groupBy(F.col("doc_id").alias("a_id"), F.col("text_crc32").alias("a_crc")).agg(F.count(F.lit(1)).alias("a_n")).filter("a_n > 1")
    slim = slim.join(alike, F.col("doc_id").eqNullSafe(F.col("a_id")) & (F.col("text_crc32") == F.col("a_crc")), "left")
    seeded = lambda *parts: F.md5(F.concat_ws(":", F.lit(seed), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))
    h = seeded(F.col("doc_id"), F.col("text_crc32"), F.when(F.col("a_n") > 1, F.col("row")))
    slim = C.materialize(slim.select("doc_id", "source", "size", "text_crc32", h.alias("h")), "slim")
    total = slim.count()
    digits = max(1, min(7, math.ceil(math.log(max(1, total / rows_per_cell), 16))))
    of_source = slim.groupBy(F.col("source").alias("n_source")).agg(F.count(F.lit(1)).alias("n"))
    cell = F.conv(F.substring("h", 1, digits), 16, 10).cast("long")
    start = (F.conv(F.substring(seeded(F.lit("start"), F.col("source")), 1, 8), 16, 10).cast("double") + 0.5) / float(1 << 32)
    ranked = _ranked(slim, ["source"], cell, ["h", "doc_id", "text_crc32", "size"], "r")
    ranked = ranked.join(of_source, F.col("source").eqNullSafe(F.col("n_source"))).withColumn("f", (F.col("r") + start) / F.col("n"))
    cells = max(1, total // rows_per_cell)
    placed = _ranked(ranked.withColumn("one", F.lit(0)), ["one"], F.floor(F.col("f") * cells), ["f", F.asc_nulls_first("source"), "r"], "g")
    # Shard s takes the ranks from ceil(s * total / shards) on.
    shard = F.expr(f"(g * {shards}) div {max(1, total)}")
    placed = placed.withColumn("shard", shard.cast("int"))
    slot = F.col("g") - F.expr(f"(cast(shard as long) * {total} + {shards - 1}) div {shards}")
    return placed.select("doc_id", "source", "size", "text_crc32", F.lit("rows").alias("law"), "shard", slot.cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


#: The reflected polynomial of CRC-32.
CRC32 = 0xEDB88320


def oracle(shards: int = 40, seed: str = "tidegauge") -> str:
    """DuckDB's SQL for the rows of op4, by window functions over whole sources and the whole order; for tables whose rows
    differ in id or text (which place alike rows take is no matter of SQL)."""
    table = f"list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, {CRC32}) ELSE c // 2 END))"
    octets = "list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: CAST('0x' || x AS BIGINT))"
    crc = f"xor(list_reduce(list_prepend({0xFFFFFFFF}, {octets}), lambda c, b: xor(c // 256, crcs[xor(c % 256, b) + 1])), {0xFFFFFFFF})"
    return f"""WITH t AS (SELECT {table} AS crcs),
d AS (SELECT doc_id, source, CAST(coalesce(octet_length(encode(text)), 0) + 16 AS BIGINT) AS size, {crc} AS text_crc32 FROM documents, t),
h AS (SELECT *, md5('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || text_crc32 || ':') AS h,
    (CAST('0x' || left(md5('{seed}:start:' || coalesce(source, '')), 8) AS BIGINT) + CAST(0.5 AS DOUBLE)) / CAST({1 << 32} AS DOUBLE) AS start FROM d),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY h, doc_id, text_crc32, size) - 1 AS r, count(*) OVER (PARTITION BY source) AS n FROM h),
g AS (SELECT *, row_number() OVER (ORDER BY (r + start) / n, source NULLS FIRST, r) - 1 AS g, count(*) OVER () AS total FROM r),
s AS (SELECT *, g * {shards} // total AS shard FROM g)
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(shard AS INTEGER) AS shard, g - (shard * total + {shards - 1}) // {shards} AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM s"""
