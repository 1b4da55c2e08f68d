"""Relational operators without a syntax of their own in Spark."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import broadcast_if_small, materialize


def distinct_on(df: DataFrame, keys: Sequence[str], order: Sequence[tuple[str, bool]]) -> DataFrame:
    """First row of each key in `order`, given as (column, ascending); the keys must be the order's prefix."""
    if set(c for c, _ in order[: len(keys)]) != set(keys) and order:
        raise ValueError("SELECT DISTINCT ON expressions must match initial ORDER BY expressions")
    rest = [F.asc(c) if up else F.desc(c) for c, up in order if c not in keys] or [F.lit(1)]
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*rest))).filter("__n = 1").drop("__n")


def groups_frame(df: DataFrame, aggregate: Column, by: Sequence[str], order: Sequence[str], before: int, after: int, name: str) -> DataFrame:
    """An aggregate over a frame of peer groups: ranges over the dense rank."""
    ranked = df.withColumn("__g", F.dense_rank().over(Window.partitionBy(*by).orderBy(*order)))
    return ranked.withColumn(name, aggregate.over(Window.partitionBy(*by).orderBy("__g").rangeBetween(-before, after))).drop("__g")


def with_ordinality(df: DataFrame, order: Sequence[str], name: str = "ordinality", rows_per_range: int = 100_000) -> DataFrame:
    """Row numbers from 1 in `order` over the whole table: numbers within ranges and the counts of the ranges before, so
    that no task sorts everything. Ties are settled by all columns."""
    keys = [*order, *[c for c in df.columns if c not in order]]
    parts = max(1, -(-df.count() // rows_per_range))
    ranged = df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("__p", F.spark_partition_id())
    # Ranges are fixed by writing them once into the shared folder; a second evaluation could draw other bounds.
    ranged = materialize(ranged, "ranges")
    counts = ranged.groupBy("__p").agg(F.count(F.lit(1)).alias("__c"))
    start = counts.withColumn("__s", F.coalesce(F.sum("__c").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__c")
    numbered = ranged.withColumn("__n", F.row_number().over(Window.partitionBy("__p").orderBy(*keys)))
    return numbered.join(start, "__p").withColumn(name, F.col("__n") + F.col("__s")).drop("__p", "__n", "__s")


def rows_from(df: DataFrame, **arrays: Column) -> DataFrame:
    """Several set-returning functions side by side, padded with nulls."""
    zipped = df.select(*df.columns, F.inline_outer(F.arrays_zip(*[a.alias(n) for n, a in arrays.items()])))
    return zipped.toDF(*df.columns, *arrays)


def lookup_join(facts: DataFrame, side: DataFrame, on: Sequence[str], how: str = "inner", broadcast_bytes: int = 64 << 20) -> DataFrame:
    """A join that looks a bounded side up: broadcast if its bytes are summed to be few, else dealt out with skew handling."""
    return facts.join(broadcast_if_small(side, broadcast_bytes) if how not in ("right", "full") else side, list(on), how)


def max_one_row(df: DataFrame) -> DataFrame:
    """The input, or an error if it has more than one row."""
    rows = df.limit(2)
    if rows.count() > 1:
        raise ValueError("more than one row returned by a subquery used as an expression")
    return rows


def salted_aggregate(df: DataFrame, keys: Sequence[str], sums: dict[str, Column], merges: dict[str, Column], salts: int = 32) -> DataFrame:
    """A two-step aggregate for hot keys whose first step can't be thinned before the shuffle. The salt is the number of the
    rows' task, so a task that runs again, with its rows in whatever order, deals them out as before."""
    first = df.withColumn("__s", F.pmod(F.spark_partition_id(), F.lit(salts))).groupBy(*keys, "__s").agg(*[a.alias(n) for n, a in sums.items()])
    return first.groupBy(*keys).agg(*[a.alias(n) for n, a in merges.items()])
