"""Registry of relational and time-series tables, functions and sequences of a session."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.timeseries import retain


@dataclass(frozen=True)
class TimeSeriesTable:
    """A time column, metrics, tags (of which some are primary), retention and partition interval in days."""

    name: str
    ts: str
    metrics: tuple[str, ...]
    tags: tuple[str, ...] = ()
    primary: tuple[str, ...] = ()
    retention_days: int | None = None
    interval_days: int = 1

    def schema_with_roles(self, schema: T.StructType) -> T.StructType:
        role = {self.ts: "ts", **dict.fromkeys(self.metrics, "metric"), **dict.fromkeys(self.tags, "tag"), **dict.fromkeys(self.primary, "ptag")}
        return T.StructType([T.StructField(f.name, f.dataType, f.nullable, {"role": role.get(f.name, "column")}) for f in schema])


@dataclass
class Catalog:
    spark: SparkSession
    tables: dict[str, tuple[DataFrame, TimeSeriesTable | None]] = field(default_factory=dict)
    functions: dict[str, str] = field(default_factory=dict)

    def register(self, name: str, df: DataFrame, series: TimeSeriesTable | None = None) -> None:
        """A table; scans of a time-series table with a retention, by SQL too, have only rows that aren't expired then.
        Retention needs a column of times: numbers have no age, and such a table keeps all rows."""
        self.tables[name] = (df, series)
        self.scan(name).createOrReplaceTempView(name)

    def scan(self, name: str, now: Column | None = None) -> DataFrame:
        df, series = self.tables[name]
        if series and series.retention_days and isinstance(df.schema[series.ts].dataType, T.TimestampType | T.TimestampNTZType | T.DateType):
            return retain(df, series.ts, series.retention_days, now)
        return df

    def show_tables(self) -> DataFrame:
        rows = [(n, "TIME SERIES" if s else "BASE") for n, (_, s) in sorted(self.tables.items())]
        return self.spark.createDataFrame(rows, "table_name string, table_type string")

    def show_columns(self, name: str) -> DataFrame:
        df, series = self.tables[name]
        schema = series.schema_with_roles(df.schema) if series else df.schema
        return self.spark.createDataFrame([(f.name, f.dataType.simpleString(), f.nullable, f.metadata.get("role", "column")) for f in schema], "column_name string, data_type string, nullable boolean, role string")

    def show_tag_values(self, name: str) -> DataFrame:
        df, series = self.tables[name]
        if not series:
            raise ValueError(f"{name} is not a time-series table")
        return df.select(*series.primary, *[t for t in series.tags if t not in series.primary]).distinct()

    def show_retentions(self) -> DataFrame:
        return self.spark.createDataFrame([(n, s.retention_days, s.interval_days) for n, (_, s) in sorted(self.tables.items()) if s], "name string, retention_days int, interval_days int")

    def create_function(self, name: str, function: Callable, returns: str, vectorized: bool = True) -> None:
        """A scalar function for SQL; names are lower-cased, not empty, and must be new."""
        name = name.lower()
        if not name:
            raise ValueError("empty function name")
        if name in self.functions or self.spark.catalog.functionExists(name):
            raise ValueError(f"function named '{name}' already exists")
        self.spark.udf.register(name, F.pandas_udf(function, returns) if vectorized else F.udf(function, returns))
        self.functions[name] = returns

    def drop_function(self, name: str) -> None:
        if self.functions.pop(name.lower(), None) is None:
            raise ValueError(f"function '{name}' does not exist")
        self.spark.sql(f"DROP TEMPORARY FUNCTION IF EXISTS {name.lower()}")

    def show_functions(self) -> DataFrame:
        return self.spark.createDataFrame(sorted(self.functions.items()), "function_name string, returns string")


class Sequence:
    """nextval, currval, lastval and setval on the driver; for ids in bulk use monotonically_increasing_id()."""

    def __init__(self, start: int = 1, increment: int = 1):
        self.next, self.increment, self.value = start, increment, None

    def nextval(self) -> int:
        self.value, self.next = self.next, self.next + self.increment
        return self.value

    def currval(self) -> int:
        if self.value is None:
            raise ValueError("currval of sequence is not yet defined in this session")
        return self.value

    lastval = currval

    def setval(self, value: int) -> int:
        self.value, self.next = value, value + self.increment
        return value
