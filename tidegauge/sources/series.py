"""Mutations of time-series tables, scans answered by file statistics, versions of a table, and co-located joins."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import replace
from datetime import UTC, datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.timeseries import deduplicate
from . import tables
from .catalog import TimeSeriesTable
from .tables import TimeSeriesError

#: Changes of a column's type that lose nothing.
WIDER = {"smallint": {"int", "bigint", "float", "double", "string"}, "int": {"bigint", "double", "string"}, "bigint": {"string"}, "float": {"double", "string"}, "double": {"string"}, "boolean": {"string"}}
#: Seconds of the units of `as_of` spans.
UNITS = {"ms": 0.001, "s": 1, "m": 60, "h": 3600, "d": 86400}


def insert(table: DataFrame, rows: DataFrame, series: TimeSeriesTable, rule: str = "override", order: str | None = None) -> DataFrame:
    """Rows added by name, with the table's rule for equal primary tags and times: see operators.timeseries.deduplicate.

    Among new rows of one key the one with the greatest `order` counts as the last; without it, or if it is equal, a hash
    of the row decides, so that a repeated task decides alike. Only the time span of the new rows is dealt out; rows of
    the table beyond it, and of no time, pass as they are."""
    batch = tables.insert(table.limit(0), rows)
    if rule == "keep":
        return table.unionByName(batch)
    # Instants go through numbers: as local times of the driver they could be ambiguous.
    instant = isinstance(table.schema[series.ts].dataType, T.TimestampType)
    ends = [f(series.ts) for f in (F.min, F.max)]
    ends = batch.agg(*[F.unix_micros(e) if instant else e for e in ends]).first()
    if ends[0] is None:
        return table.unionByName(batch)
    low, high = [F.timestamp_micros(F.lit(e)) if instant else F.lit(e) for e in ends]
    inside = F.coalesce(F.col(series.ts).between(low, high), F.lit(False))
    row_hash = F.xxhash64(*table.columns)
    last = [F.col(order)] if order else []
    both = table.filter(inside).withColumn("__at", F.struct(F.lit(0).alias("new"), *last, row_hash.alias("hash")))
    both = both.unionByName(batch.filter(inside).withColumn("__at", F.struct(F.lit(1).alias("new"), *last, row_hash.alias("hash"))))
    done = deduplicate(both, [*series.primary, series.ts], "__at", rule).select(*table.columns)
    return table.filter(~inside).unionByName(done).unionByName(batch.filter(F.col(series.ts).isNull()))


def update_tags(table: DataFrame, series: TimeSeriesTable, assignments: Mapping[str, Column], where: Column) -> DataFrame:
    """UPDATE of tags that aren't primary; other columns of a time-series table can't be updated."""
    fixed = [c for c in assignments if c not in series.tags or c in series.primary]
    if fixed:
        raise TimeSeriesError(f"only tags that are not primary can be updated, not {', '.join(sorted(fixed))}")
    return tables.update(table, assignments, where)


def alter(table: DataFrame, series: TimeSeriesTable, add: Mapping[str, str] | None = None, drop: Sequence[str] = (), rename: Mapping[str, str] | None = None, retype: Mapping[str, str] | None = None, tags: bool = False, **settings: int) -> tuple[DataFrame, TimeSeriesTable]:
    """ALTER TABLE: columns (with `tags`: tags) are added as null, dropped, renamed or given a wider type, in that order;
    `settings` are retention_days and interval_days. The time column and primary tags stay; so does one metric."""
    add, rename, retype = dict(add or {}), dict(rename or {}), dict(retype or {})
    fixed = {series.ts, *series.primary} & {*drop, *rename, *retype}
    if fixed:
        raise TimeSeriesError(f"the time column and primary tags can't be altered: {', '.join(sorted(fixed))}")
    twice = [c for c in [*add, *rename.values()] if c in table.columns]
    missing = [c for c in [*drop, *rename, *retype] if c not in table.columns]
    if twice or missing:
        raise TimeSeriesError(f"columns exist already: {twice}" if twice else f"no such columns: {missing}")
    for c, kind in retype.items():
        if kind not in WIDER.get(table.schema[c].dataType.simpleString(), ()):
            raise TimeSeriesError(f"type of {c} can't become {kind}")
    named = lambda cs: tuple(rename.get(c, c) for c in cs if c not in drop)
    metrics = named(series.metrics) + (() if tags else tuple(add))
    if not metrics:
        raise TimeSeriesError("a time-series table keeps at least one metric")
    out = table.withColumns({c: F.lit(None).cast(kind) for c, kind in add.items()}).drop(*drop)
    out = out.withColumns({c: F.col(c).cast(kind) for c, kind in retype.items()}).withColumnsRenamed(rename)
    return out, replace(series, metrics=metrics, tags=named(series.tags) + (tuple(add) if tags else ()), **settings)


def statistic_scan(spark: SparkSession, path: str, aggregates: Sequence[Column]) -> DataFrame:
    """Counts, least and greatest values of a whole Parquet table, taken from the files' footers where their types allow
    (not times and strings, which are read as usual). The reader that can do this is chosen in a session beside this one."""
    beside = spark.newSession()
    for key in ("spark.sql.session.timeZone", "spark.sql.ansi.enabled"):
        beside.conf.set(key, spark.conf.get(key))
    beside.conf.set("spark.sql.sources.useV1SourceList", "")
    beside.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    return beside.read.parquet(path).agg(*aggregates)


class Versions:
    """A table kept as one Parquet folder a version, named by the microsecond it was committed; old versions can be read."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _found(self) -> list[int]:
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(at):
            return []
        done = [s.getPath() for s in fs.listStatus(at) if fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
        return sorted(int(p.getName()[1:]) for p in done if re.fullmatch(r"v\d+", p.getName()))

    def commit(self, df: DataFrame, at: datetime | None = None) -> int:
        """Writes a version; one that isn't whole is never read. Times must grow."""
        micros = _micros(at or datetime.now(UTC))
        if (found := self._found()) and micros <= found[-1]:
            raise ValueError("a later version is there already")
        df.write.parquet(f"{self.path}/v{micros:020d}")
        return micros

    def read(self, as_of: str | None = None, now: datetime | None = None) -> DataFrame:
        """The newest version, or the newest at a time: a timestamp, nanoseconds since 1970, or a span back like '-10s'."""
        now = _micros(now or datetime.now(UTC))
        limit = now if as_of is None else time_of(as_of, now)
        if limit > now:
            raise ValueError("AS OF SYSTEM TIME: cannot specify a time in the future")
        older = [v for v in self._found() if v <= limit]
        if not older:
            raise ValueError("no version of the table is that old")
        return self.spark.read.parquet(f"{self.path}/v{older[-1]:020d}")


def _micros(at: datetime) -> int:
    at = at if at.tzinfo else at.replace(tzinfo=UTC)
    return (at - datetime(1970, 1, 1, tzinfo=UTC)) // timedelta(microseconds=1)


def time_of(text: str, now: int) -> int:
    """Microseconds since 1970 of a timestamp, of nanoseconds, or of a span before `now`."""
    text = text.strip()
    if re.fullmatch(r"\d+(\.\d*)?", text):
        if not int(text.split(".")[0]):
            raise ValueError("AS OF SYSTEM TIME: a zero timestamp is invalid")
        return int(text.split(".")[0]) // 1000
    if re.fullmatch(r"-(\d+(\.\d+)?(ms|s|m|h|d))+", text):
        return now - sum(round(float(n) * UNITS[u] * 1_000_000) for n, u in re.findall(r"(\d+(?:\.\d+)?)(ms|s|m|h|d)", text))
    try:
        return _micros(datetime.fromisoformat(text))
    except ValueError:
        raise ValueError(f"AS OF SYSTEM TIME: neither a timestamp, a decimal nor a span back: {text!r}") from None


def write_interleaved(df: DataFrame, name: str, keys: Sequence[str], buckets: int, path: str) -> DataFrame:
    """A table dealt into buckets by `keys` and sorted in each; tables of equal keys and buckets join without a shuffle."""
    df.repartition(buckets, *keys).write.mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys).option("path", path).saveAsTable(name)
    return df.sparkSession.table(name)


def interleaved_join(parent: DataFrame, child: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Parent and child rows of equal keys, merged bucket by bucket."""
    return parent.hint("merge").join(child, list(keys), how)
