"""The metrics pipeline: downsample each source's series, fill between points, aggregate the sources, derive."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.timeseries import time_bucket

SAMPLE_SECONDS = 10
AGGREGATES = ("avg", "sum", "max", "min", "first", "last", "variance")
DERIVATIVES = ("none", "derivative", "non_negative")


def metrics_query(df: DataFrame, name: str, source: str, ts: str, value: str, period: int, downsampler: str = "avg", source_aggregator: str = "sum", derivative: str = "none") -> DataFrame:
    """(name, bucket, value) of each series over all its sources; `period`: seconds, a multiple of the sample period."""
    if period <= 0 or period % SAMPLE_SECONDS:
        raise ValueError(f"the period must be a multiple of {SAMPLE_SECONDS} s")
    if downsampler not in AGGREGATES or source_aggregator not in AGGREGATES or source_aggregator in ("first", "last"):
        raise ValueError("no such aggregator here")
    if derivative not in DERIVATIVES:
        raise ValueError(f"no such derivative: {derivative!r}")
    v, t = F.col("v"), F.col("t")
    down = {"avg": F.avg(v), "sum": F.sum(v), "max": F.max(v), "min": F.min(v), "first": F.min_by(v, t), "last": F.max_by(v, t), "variance": F.var_pop(v)}
    rows = df.select(F.col(name).alias("name"), F.col(source).alias("source"), F.col(ts).alias("t"), F.col(value).cast("double").alias("v"))
    # Within a sample slot the latest value wins.
    slots = rows.groupBy("name", "source", time_bucket("t", SAMPLE_SECONDS).alias("slot")).agg(F.max_by("v", "t").alias("v"), F.max("t").alias("t"))
    points = slots.groupBy("name", "source", time_bucket("slot", period).alias("bucket")).agg(down[downsampler].alias("v"))
    # Missing buckets between two points of a source lie on the line between them.
    w = Window.partitionBy("name", "source").orderBy("bucket")
    step = F.lit(period * 1_000_000)
    pair = points.withColumn("next_b", F.lead("bucket").over(w)).withColumn("next_v", F.lead("v").over(w))
    gap = F.coalesce((F.unix_micros("next_b") - F.unix_micros("bucket")) / step, F.lit(1.0)).cast("long")
    line = pair.withColumn("gap", gap).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("gap") - 1)))
    filled = line.select("name", F.timestamp_micros(F.unix_micros("bucket") + F.col("k") * step).alias("bucket"), F.when(F.col("k") == 0, F.col("v")).otherwise(F.col("v") + (F.col("next_v") - F.col("v")) * F.col("k") / F.col("gap")).alias("v"))
    over = {"avg": F.avg("v"), "sum": F.sum("v"), "max": F.max("v"), "min": F.min("v"), "variance": F.var_pop("v")}
    out = filled.groupBy("name", "bucket").agg(over[source_aggregator].alias("value"))
    if derivative == "none":
        return out
    w = Window.partitionBy("name").orderBy("bucket")
    rate = (F.col("value") - F.lag("value").over(w)) / ((F.unix_micros("bucket") - F.unix_micros(F.lag("bucket").over(w))) / 1e6)
    rate = F.when(rate < 0, F.lit(0.0)).otherwise(rate) if derivative == "non_negative" else rate
    return out.withColumn("value", rate).filter("value is not null")


def rollup(df: DataFrame, keys: list[str], ts: str, value: str, period: int = 1800) -> DataFrame:
    """Coarser samples that can be merged: count, sum, min, max, first, last and the variance's sum of squares."""
    v, t = F.col(value), F.col(ts)
    return df.groupBy(*keys, time_bucket(ts, period).alias("bucket")).agg(F.count(v).alias("n"), F.sum(v).alias("total"), F.min(v).alias("least"), F.max(v).alias("most"), F.min_by(v, t).alias("first"), F.max_by(v, t).alias("last"), F.sum(v * v).alias("squares"))
