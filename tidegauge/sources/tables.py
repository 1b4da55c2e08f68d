"""Mutations of plain tables as rewrites, constraints, CSV import and export, statistics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class TimeSeriesError(ValueError):
    """A statement that time-series tables don't have."""


def insert(table: DataFrame, rows: DataFrame, defaults: Mapping[str, Column] | None = None) -> DataFrame:
    """Rows by name; columns that they lack take the default or null."""
    missing = {c: (defaults or {}).get(c, F.lit(None)) for c in table.columns if c not in rows.columns}
    rows = rows.withColumns({c: v.cast(table.schema[c].dataType) for c, v in missing.items()})
    return table.unionByName(rows.select(*[F.col(c).cast(table.schema[c].dataType).alias(c) for c in table.columns]))


def upsert(table: DataFrame, rows: DataFrame, keys: Sequence[str], update: bool = True) -> DataFrame:
    """Insert or update by key; without `update`, rows whose key is there already are skipped."""
    if update:
        return table.join(rows.select(*keys), list(keys), "left_anti").select(*table.columns).unionByName(rows.select(*table.columns))
    return table.unionByName(rows.join(table.select(*keys), list(keys), "left_anti").select(*table.columns))


def update(table: DataFrame, assignments: Mapping[str, Column], where: Column, time_series: bool = False) -> DataFrame:
    if time_series:
        raise TimeSeriesError("UPDATE is not supported on time-series tables")
    hit = F.coalesce(where, F.lit(False))
    return table.withColumns({c: F.when(hit, v.cast(table.schema[c].dataType)).otherwise(F.col(c)) for c, v in assignments.items()})


def update_from(table: DataFrame, other: DataFrame, keys: Sequence[str], assignments: Mapping[str, str]) -> DataFrame:
    """UPDATE ... FROM by key; `assignments`: column of the table -> column of the other, whose keys must be unique."""
    side = other.select(*[F.col(k).alias(f"__{k}") for k in keys], *[F.col(v).alias(f"__new_{c}") for c, v in assignments.items()], F.lit(True).alias("__hit"))
    joined = table.join(side, [F.col(k) == F.col(f"__{k}") for k in keys], "left")
    return joined.select(*[F.when(F.col("__hit"), F.col(f"__new_{c}")).otherwise(F.col(c)).alias(c) if c in assignments else F.col(c) for c in table.columns])


def delete(table: DataFrame, where: Column) -> DataFrame:
    return table.filter(~F.coalesce(where, F.lit(False)))


def check(table: DataFrame, condition: Column, name: str) -> DataFrame:
    """CHECK: a row that makes the condition false is an error when it is read; null passes."""
    return table.filter(F.when(F.coalesce(condition, F.lit(True)), True).otherwise(F.raise_error(F.lit(f"failed to satisfy CHECK constraint {name}")).cast("boolean")))


def foreign_key_violations(child: DataFrame, parent: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """Rows of the child whose keys, none of them null, aren't in the parent."""
    known = child.filter(" and ".join(f"`{c}` is not null" for c in columns))
    side = parent.select(*[F.col(p).alias(f"__{p}") for p in columns.values()]).distinct()
    return known.join(side, [F.col(c) == F.col(f"__{p}") for c, p in columns.items()], "left_anti")


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str, columns: Sequence[str] | None = None, delimiter: str = ",", enclosed: str = '"', escaped: str = "\\", nullif: str = "", comment: str | None = None, header: bool = False) -> DataFrame:
    """CSV with a given schema; `columns`: those that the file has, in its order; the others are null."""
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    present = T.StructType([schema[c] for c in columns]) if columns else schema
    options = {"sep": delimiter, "quote": enclosed, "escape": escaped, "nullValue": nullif, "header": header, "mode": "FAILFAST", "multiLine": False}
    df = spark.read.options(**options, **({"comment": comment} if comment else {})).schema(present).csv(path)
    return df.select(*[F.col(f.name) if f.name in present.names else F.lit(None).cast(f.dataType).alias(f.name) for f in schema])


def write_csv(df: DataFrame, path: str, delimiter: str = ",", enclosed: str = '"', escaped: str = "\\", nullas: str = "", header: bool = False, mode: str = "errorifexists") -> None:
    df.write.mode(mode).options(sep=delimiter, quote=enclosed, escape=escaped, nullValue=nullas, header=header, emptyValue=enclosed * 2).csv(path)


def write_partitioned(df: DataFrame, path: str, ts: str, days: int = 1, mode: str = "append") -> None:
    """Parquet in folders of time intervals, each written by few tasks, sorted by time for row-group pruning."""
    from ..operators.timeseries import partition_column

    parted = df.withColumn("ts_interval", partition_column(ts, days))
    parted.repartition("ts_interval").sortWithinPartitions("ts_interval", ts).write.mode(mode).partitionBy("ts_interval").parquet(path)


def statistics(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows, nulls, distinct values (a sketch), least and greatest value of each column, in one pass."""
    aggs = [F.struct(F.lit(c).alias("column"), F.count(F.lit(1)).alias("rows"), F.count_if(F.col(c).isNull()).alias("nulls"), F.approx_count_distinct(c).alias("distinct"), F.min(c).cast("string").alias("least"), F.max(c).cast("string").alias("most")) for c in columns]
    return df.agg(F.array(*aggs).alias("s")).select(F.inline("s"))


def fingerprint(df: DataFrame) -> DataFrame:
    """An order-independent fingerprint of the rows."""
    return df.agg(F.bit_xor(F.xxhash64(*df.columns)).alias("fingerprint"), F.count(F.lit(1)).alias("rows"))
