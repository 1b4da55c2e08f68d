"""Operators on time-series tables: gap filling, differences, duplicates, tags, retention and cross-model joins."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.timeseries import time_bucket, width_of
from ..shared import broadcast_if_small

DEDUP_RULES = ("override", "discard", "keep", "reject", "merge")


def gapfill(df: DataFrame, ts: str, width: int | str, aggregates: Mapping[str, Column], by: Sequence[str] = (), interpolate: Mapping[str, str | tuple] | None = None, bucket: str = "bucket") -> DataFrame:
    """Aggregates per bucket, with every missing bucket between the first and the last one (of each group of `by`).

    `interpolate` fills an aggregate in the added buckets: 'null' (as is), and as extensions 'prev', 'next', 'linear' or
    ('constant', value). Only groups are joined and filled, after the data has been aggregated."""
    seconds, months = width_of(width)
    if months:
        raise ValueError("gap filling takes widths of a fixed length")
    for name in interpolate or {}:
        if name not in aggregates:
            raise ValueError(f"interpolate needs an aggregate, and {name!r} is none")
    clash = {bucket, *by} & set(aggregates)
    if clash:
        raise ValueError(f"names are used twice: {sorted(clash)}")
    grouped = df.groupBy(*by, time_bucket(ts, width).alias(bucket)).agg(*[a.alias(n) for n, a in aggregates.items()])
    step = F.expr(f"interval {seconds} seconds")
    span = grouped.groupBy(*by).agg(F.min(bucket).alias("__lo"), F.max(bucket).alias("__hi")).filter("__lo is not null")
    frame = span.select(*by, F.explode(F.sequence("__lo", "__hi", step)).alias(bucket))
    right = grouped.select(*[F.col(c).alias(f"__{c}") for c in [*by, bucket]], F.lit(True).alias("__real"), *aggregates)
    on = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in [*by, bucket]]
    full = frame.join(right, on, "left").select(*by, bucket, "__real", *aggregates)
    back = Window.partitionBy(*by).orderBy(bucket).rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*by).orderBy(bucket).rowsBetween(0, Window.unboundedFollowing)
    filled = {}
    for name, mode in (interpolate or {}).items():
        kind, value = mode if isinstance(mode, tuple) else (mode, None)
        known = F.when(F.col("__real") & F.col(name).isNotNull(), F.struct(F.col(bucket).alias("t"), F.col(name).alias("v")))
        prev, after = F.last(known, ignorenulls=True).over(back), F.first(known, ignorenulls=True).over(ahead)
        if kind == "null":
            continue
        if kind == "linear":
            share = (F.unix_micros(bucket) - F.unix_micros(prev["t"])) / (F.unix_micros(after["t"]) - F.unix_micros(prev["t"]))
            guess = prev["v"] + (after["v"] - prev["v"]) * share
        elif kind in ("prev", "next", "constant"):
            guess = {"prev": prev["v"], "next": after["v"], "constant": F.lit(value)}[kind]
        else:
            raise ValueError(f"no such mode: {kind!r}")
        filled[name] = F.when(F.col("__real"), F.col(name)).otherwise(guess)
    return full.select(*by, bucket, *[filled.get(n, F.col(n)).alias(n) for n in aggregates])


def diff(df: DataFrame, column: str, ts: str, by: Sequence[str] = (), name: str = "diff", keep_first: bool = False) -> DataFrame:
    """Value less the previous value of the same series; the first row of a series has no difference and is left out."""
    w = Window.partitionBy(*by).orderBy(ts)
    out = df.withColumn(name, F.col(column) - F.lag(column).over(w))
    return out if keep_first else out.withColumn("__n", F.row_number().over(w)).filter("__n > 1").drop("__n")


def deduplicate(df: DataFrame, keys: Sequence[str], sequence: str, rule: str = "override") -> DataFrame:
    """Rows of equal keys (primary tags and time): the last wins (override), the first wins (discard), all stay (keep),
    they are an error (reject), or each column takes its last value that isn't null (merge)."""
    if rule not in DEDUP_RULES:
        raise ValueError(f"no such rule: {rule!r}")
    if rule == "keep":
        return df
    rest = [c for c in df.columns if c not in keys]
    if rule == "merge":
        return df.groupBy(*keys).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(sequence))).alias(c) for c in rest]).select(*df.columns)
    if rule == "reject":
        w = Window.partitionBy(*keys)
        error = F.raise_error(F.lit("duplicate primary tag and time")).cast("boolean")
        return df.withColumn("__n", F.count(F.lit(1)).over(w)).filter(F.when(F.col("__n") > 1, error).otherwise(True)).drop("__n")
    # An aggregate rather than a window: rows are thinned before they are dealt out.
    pick = F.max_by if rule == "override" else F.min_by
    return df.groupBy(*keys).agg(pick(F.struct(*rest), F.col(sequence)).alias("__row")).select(*keys, "__row.*").select(*df.columns)


def tag_table(df: DataFrame, primary: Sequence[str], tags: Sequence[str], sequence: str) -> DataFrame:
    """One row for each entity; of conflicting tags the ones written first stay."""
    return df.groupBy(*primary).agg(*[F.min_by(t, sequence).alias(t) for t in tags])


def tag_values(df: DataFrame, tags: Sequence[str]) -> DataFrame:
    return df.select(*tags).distinct()


def scan(df: DataFrame, ts: str, start=None, end=None, columns: Sequence[str] | None = None) -> DataFrame:
    """A span [start, end] of a time-series table; both the span and the columns reach the Parquet reader."""
    if start is not None:
        df = df.filter(F.col(ts) >= F.lit(start).cast(df.schema[ts].dataType))
    if end is not None:
        df = df.filter(F.col(ts) <= F.lit(end).cast(df.schema[ts].dataType))
    return df.select(*columns) if columns else df


def ordered_scan(df: DataFrame, ts: str, k: int, descending: bool = False, offset: int = 0) -> DataFrame:
    """The first k rows by time: a top-k in each task, not a sort of all."""
    return df.orderBy(F.desc(ts) if descending else F.asc(ts)).offset(offset).limit(k)


def retain(df: DataFrame, ts: str, days: int, now: Column | None = None) -> DataFrame:
    """Rows not older than the retention."""
    return df.filter(F.col(ts) >= (now if now is not None else F.current_timestamp()) - F.expr(f"interval {days} days"))


def delete_span(df: DataFrame, ts: str, start, end, entity: Column) -> DataFrame:
    """What stays after deleting the rows of an entity within [start, end]."""
    return df.filter(~F.coalesce(entity & F.col(ts).between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")), F.lit(False)))


def aggregate_then_join(facts: DataFrame, dims: DataFrame, key: str, sums: Mapping[str, Column], by: Sequence[str], counts: Sequence[str] = (), also_by: Sequence[str] = (), broadcast_bytes: int = 64 << 20) -> DataFrame:
    """Inside-out aggregation of a join on a tag: facts are first aggregated per tag value (and `also_by`), then joined to the
    relational side and aggregated again. `sums` are aggregates that add up; counts, too, are summed and 0 without rows.
    The relational side is broadcast if its bytes are summed to be few; the key must be unique there."""
    part = facts.groupBy(key, *also_by).agg(*[a.alias(n) for n, a in sums.items()])
    joined = part.join(broadcast_if_small(dims, broadcast_bytes), key)
    out = joined.groupBy(*by, *also_by) if by or also_by else joined
    return out.agg(*[(F.coalesce(F.sum(n), F.lit(0)) if n in counts else F.sum(n)).alias(n) for n in sums])


def partition_column(ts: str, days: int = 1) -> Column:
    """The partition a row is written to: the day its interval begins."""
    day = F.datediff(F.to_date(ts), F.lit("1970-01-01").cast("date"))
    return F.date_add(F.lit("1970-01-01").cast("date"), (day - F.pmod(day, F.lit(days))).cast("int"))
