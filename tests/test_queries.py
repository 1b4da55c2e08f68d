import os

import duckdb
import pandas as pd
import pytest

from tidegauge.plans import registry
from tidegauge.session import TABLES
from tidegauge.streaming.rollup import continuous_aggregate

SF = "/root/testdata/sf0.001"
NAMES = sorted(registry.SQL)
#: Queries that may have no rows at this size.
FEW = {"tpch_q7", "tpch_q18", "join_not_in", "sql_row_comparison", "predicate_similar"}


def rows(df: pd.DataFrame) -> list[tuple]:
    show = lambda v: None if pd.api.types.is_scalar(v) and pd.isna(v) else float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted((tuple(map(show, r)) for r in df[sorted(df.columns)].astype(object).itertuples(index=False)), key=str)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", NAMES)
def test_same_as_duckdb(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = rows(registry.QUERIES[name](spark, SF).toPandas())
    assert got == rows(con.sql(registry.SQL[name]).df())
    assert got or name in FEW


def test_every_statement_has_a_query():
    assert set(registry.SQL) <= set(registry.QUERIES)


def test_continuous_aggregate(spark, tmp_path):
    from pyspark.sql import functions as F

    src = str(tmp_path / "in")
    spark.sql("SELECT timestamp '2024-01-01 00:00:00' + make_interval(0,0,0,0,0,id) AS ts, id % 2 AS k, id AS v FROM range(180)").write.parquet(src)
    stream = spark.readStream.schema("ts timestamp, k long, v long").parquet(src)
    out = continuous_aggregate(stream, "ts", "1 hour", "10 minutes", ["k"], {"n": F.count(F.lit(1)), "total": F.sum("v")})
    q = out.writeStream.format("memory").queryName("rolled").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(60)
    assert sorted((r.bucket.hour, r.k, r.n) for r in spark.table("rolled").collect()) == [(h, k, 30) for h in range(3) for k in range(2)]


@pytest.mark.parametrize(
    "text,said",
    [
        ("SELECT ln(0) AS x", "cannot take logarithm of zero"), ("SELECT log(-1.0) AS x", "logarithm of a negative number"), ("SELECT sqrt(-1.0) AS x", "square root of a negative number"),
        ("SELECT interpolate(avg(value), 'null') FROM events", "must be used with time_bucket_gapfill"), ("SELECT time_bucket_gapfill(ts, 60) AS b, count(*) FROM events GROUP BY event_type", "must appear in the GROUP BY"),
        ("SELECT time_bucket_gapfill(ts, 60) AS b, interpolate(value, 'null') AS v FROM events GROUP BY b", "needs an aggregate"), ("SELECT time_bucket_gapfill(ts, 60) AS b, interpolate(avg(value + 1), 'null') AS v FROM events GROUP BY b", "bare column"),
        ("SELECT time_bucket_gapfill(ts, 60) AS b, interpolate(avg(value), 'odd') AS v FROM events GROUP BY b", "no such mode"), ("SELECT diff(value) FROM events", "window function"), ("SELECT convert_to('x', 'morse') AS x", "encoding"),
        ("SELECT DISTINCT ON (event_type) event_type FROM events ORDER BY ts", "must match initial ORDER BY"), ("SELECT iferror(sum(value), 0) AS x FROM events", "can't catch"), ("SELECT extract_duration('parsec', interval '1' day) AS x", "no such part"),
    ],
)
def test_errors_are_told(spark, text, said):
    from tidegauge.plans import dialect
    from tidegauge.session import with_views

    with pytest.raises(Exception, match=said):
        dialect.query(with_views(spark, SF), text, ts="ts").collect()


def test_forms_inside_literals_and_comments_stay(spark):
    from tidegauge.plans import dialect

    row = dialect.query(spark, "SELECT 'a -> b ^ c # d' AS x, '~ \\d' AS y /* 2 ^ 3 */ -- # ->").first()
    assert row.x == "a -> b ^ c # d"


def test_entry_without_the_text_subpackage():
    """Only its absence is passed over, not what it lacks."""
    import __spark_entry__ as entry

    assert entry._module("tidegauge.llm.no_such_module") is None and entry._module("no_such_pipeline") is None
    assert set(registry.QUERIES) <= set(entry.queries())
