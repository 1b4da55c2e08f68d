"""Session settings and table loading."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(master: str = "local[*]", **settings: str) -> SparkSession:
    """A session with the settings that the results rely on: UTC and ANSI arithmetic."""
    builder = SparkSession.builder.master(master).appName("tidegauge")
    for key, value in {**SETTINGS, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_views(spark: SparkSession, sf_dir: str, names: list[str] | None = None) -> SparkSession:
    """Temporary views of the tables; scans stay lazy, so a view that a query doesn't use costs nothing but its schema."""
    for name in names or TABLES:
        table(spark, sf_dir, name).createOrReplaceTempView(name)
    return spark
