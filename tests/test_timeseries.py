import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidegauge.functions import timeseries as ts
from tidegauge.operators import metrics
from tidegauge.operators import timeseries as series


def at(minute, second=0):
    return dt.datetime(2024, 1, 1, 10, minute, second)


@pytest.fixture
def readings(spark):
    rows = [(at(0), 1.0, None, "a"), (at(5), None, 7, "a"), (at(21), 3.0, 8, "a"), (at(40), 4.0, None, "b")]
    return spark.createDataFrame(rows, "t timestamp, x double, y int, tag string")


def test_first_and_last_skip_nulls_but_the_row_forms_do_not(readings):
    y, t = F.col("y"), F.col("t")
    row = readings.agg(ts.first(y, t).alias("f"), ts.last(y, t).alias("l"), ts.first_row(y, t).alias("fr"), ts.last_row(y, t).alias("lr"), ts.firstts(y, t).alias("ft"), ts.last(y, t, "2024-01-01 10:05:00").alias("b"), ts.last(y, t, "2023-01-01").alias("n")).first()
    assert (row.f, row.l, row.fr, row.lr, row.ft, row.b, row.n) == (7, 8, None, None, at(5), 7, None)


def test_empty_input(readings):
    row = readings.limit(0).agg(ts.last(F.col("y"), F.col("t")).alias("l"), F.count(F.lit(1)).alias("n")).first()
    assert (row.l, row.n) == (None, 0)


@pytest.mark.parametrize("width,start", [("300s", at(20)), (600, at(20)), ("1h", at(0)), ("1month", dt.datetime(2024, 1, 1)), ("2y", dt.datetime(2024, 1, 1))])
def test_bucket_starts(spark, width, start):
    df = spark.createDataFrame([(at(21, 5),)], "t timestamp")
    assert df.select(ts.time_bucket("t", width).alias("b")).first().b == start


@pytest.mark.parametrize("width", [0, "x", "5 parsecs", "0s"])
def test_bad_widths(width):
    with pytest.raises(ValueError):
        ts.width_of(width)


def test_gapfill_modes(readings):
    agg = {"v": F.max("x"), "p": F.max("x"), "n": F.max("x"), "c": F.max("x"), "l": F.max("x")}
    out = series.gapfill(readings.filter("x is not null"), "t", "10min", agg, interpolate={"v": "null", "p": "prev", "n": "next", "c": ("constant", 0.0), "l": "linear"}).orderBy("bucket").collect()
    assert [tuple(r)[1:] for r in out] == [(1.0,) * 5, (None, 1.0, 3.0, 0.0, 2.0), (3.0,) * 5, (None, 3.0, 4.0, 0.0, 3.5), (4.0,) * 5]


def test_gapfill_checks_names(readings):
    with pytest.raises(ValueError):
        series.gapfill(readings, "t", "10min", {"v": F.max("x")}, interpolate={"w": "null"})


def test_diff_leaves_out_first_rows(readings):
    assert [r["diff"] for r in series.diff(readings.filter("x is not null"), "x", "t", ["tag"]).collect()] == [2.0]


def test_dedup_rules(spark):
    rows = spark.createDataFrame([("k", 1, None, 5), ("k", 2, 3, None), ("j", 1, 1, 1)], "k string, s int, a int, b int")
    got = lambda rule: {(r.k, r.a, r.b) for r in series.deduplicate(rows, ["k"], "s", rule).collect()}
    assert got("override") == {("k", 3, None), ("j", 1, 1)}
    assert got("discard") == {("k", None, 5), ("j", 1, 1)}
    assert got("merge") == {("k", 3, 5), ("j", 1, 1)}
    assert len(series.deduplicate(rows, ["k"], "s", "keep").collect()) == 3
    with pytest.raises(Exception, match="duplicate"):
        series.deduplicate(rows, ["k"], "s", "reject").collect()


def test_first_tag_stays(spark):
    rows = spark.createDataFrame([(1, 23, 1), (1, 230, 2)], "p int, tag int, s int")
    assert series.tag_table(rows, ["p"], ["tag"], "s").first().tag == 23


def test_metrics_interpolates_between_points_of_a_source(spark):
    rows = [("m", "a", at(0), 0.0), ("m", "a", at(2), 20.0), ("m", "b", at(1), 5.0)]
    df = spark.createDataFrame(rows, "n string, s string, t timestamp, v double")
    out = metrics.metrics_query(df, "n", "s", "t", "v", 60).orderBy("bucket").collect()
    assert [r.value for r in out] == [0.0, 15.0, 20.0]
    with pytest.raises(ValueError):
        metrics.metrics_query(df, "n", "s", "t", "v", 15)
