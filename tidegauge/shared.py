"""The folder that driver and executors share, tables written there, and broadcasts of checked size."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a new local folder, which only a session in one process can share: on a
    cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="tidegauge-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write `df` as Parquet into the shared folder and read it back with the same schema."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def release(df: DataFrame) -> None:
    """Delete a table made by materialize() that nothing reads any more."""
    if path := getattr(df, "written_to", None):
        jvm = df.sparkSession.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def broadcast_if_small(df: DataFrame, most_bytes: int = 64 << 20) -> DataFrame:
    """A hint to broadcast `df` if its bytes, summed in one pass over the cluster, are within the bound; else `df` as it is."""
    sizes = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.StringType | T.BinaryType):
            sizes.append(F.coalesce(F.octet_length(c), F.lit(0)))
        elif isinstance(f.dataType, T.ArrayType | T.MapType | T.StructType):
            sizes.append(F.octet_length(F.to_json(F.struct(c))))
    row = F.lit(16 + 8 * len(df.columns))
    for size in sizes:
        row = row + size
    return F.broadcast(df) if (df.agg(F.sum(row)).first()[0] or 0) <= most_bytes else df
