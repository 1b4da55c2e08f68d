from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidegauge.sources import series
from tidegauge.sources.catalog import Catalog, TimeSeriesTable
from tidegauge.sources.tables import TimeSeriesError

METERS = TimeSeriesTable("meters", "ts", ("v", "w"), ("id", "place"), ("id",), 10)
DDL = "id int, ts timestamp, v double, w double, place string"


def rows(spark, *given):
    return spark.createDataFrame([(i, datetime(2024, 1, d), v, w, p) for i, d, v, w, p in given], DDL)


def plain(df):
    return sorted(((r.id, r.ts.day, r.v, r.w) for r in df.collect()), key=str)


@pytest.mark.parametrize(
    "rule,hit",
    [("override", [(1, 2, 9.0, None)]), ("discard", [(1, 2, 1.0, 2.0)]), ("merge", [(1, 2, 9.0, 2.0)]), ("keep", [(1, 2, 1.0, 2.0), (1, 2, 9.0, None)])],
)
def test_insert_follows_the_rule(spark, rule, hit):
    old = rows(spark, (1, 1, 0.0, 0.0, "a"), (1, 2, 1.0, 2.0, "a"), (2, 2, 3.0, 3.0, None))
    new = rows(spark, (1, 2, 9.0, None, "a"), (1, 3, 5.0, 5.0, "a"))
    assert plain(series.insert(old, new, METERS, rule)) == sorted([(1, 1, 0.0, 0.0), *hit, (2, 2, 3.0, 3.0), (1, 3, 5.0, 5.0)], key=str)


def test_insert_of_nothing_repeats_and_rejects(spark):
    old = rows(spark, (1, 1, 0.0, 0.0, "a"))
    assert plain(series.insert(old, old.limit(0), METERS)) == plain(old)
    assert plain(series.insert(old.limit(0), old.unionAll(old), METERS)) == plain(old)
    with pytest.raises(Exception, match="duplicate primary tag and time"):
        series.insert(old, old, METERS, "reject").collect()


def test_tags_alone_are_updated(spark):
    old = rows(spark, (1, 1, 0.0, 0.0, "a"), (2, 1, 0.0, 0.0, None))
    out = series.update_tags(old, METERS, {"place": F.lit("b")}, F.col("id") == 2)
    assert [r.place for r in out.orderBy("id").collect()] == ["a", "b"]
    for column in ("id", "v", "ts"):
        with pytest.raises(TimeSeriesError, match="only tags"):
            series.update_tags(old, METERS, {column: F.lit(1)}, F.lit(True))


def test_alter(spark):
    old = rows(spark, (1, 1, 0.5, 0.0, "a"))
    out, role = series.alter(old, METERS, add={"x": "int"}, drop=["w"], rename={"place": "site"}, retype={"v": "string"}, retention_days=3)
    assert out.collect()[0].asDict() == {"id": 1, "ts": datetime(2024, 1, 1), "v": "0.5", "site": "a", "x": None}
    assert (role.metrics, role.tags, role.retention_days) == (("v", "x"), ("id", "site"), 3)
    for wrong in ({"drop": ["ts"]}, {"rename": {"id": "i"}}, {"add": {"v": "int"}}, {"drop": ["none"]}, {"retype": {"v": "int"}}, {"drop": ["v", "w"]}):
        with pytest.raises(TimeSeriesError):
            series.alter(old, METERS, **wrong)


def test_scans_obey_the_retention(spark):
    catalog = Catalog(spark)
    catalog.register("meters", rows(spark, (1, 1, 0.0, 0.0, "a"), (1, 20, 1.0, 1.0, "a")), METERS)
    assert plain(catalog.scan("meters", F.lit("2024-01-25").cast("timestamp"))) == [(1, 20, 1.0, 1.0)]
    assert spark.table("meters").count() == 0
    catalog.register("kept", rows(spark, (1, 1, 0.0, 0.0, "a")), TimeSeriesTable("kept", "ts", ("v",)))
    assert spark.table("kept").count() == 1


def test_statistic_scan_reads_no_rows(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(1000).selectExpr("id", "CASE WHEN id % 2 = 0 THEN id END AS half").write.parquet(path)
    out = series.statistic_scan(spark, path, [F.count(F.lit(1)).alias("n"), F.count("half").alias("h"), F.max("id").alias("m")])
    assert out.first().asDict() == {"n": 1000, "h": 500, "m": 999}
    assert "PushedAggregation: [COUNT(*), COUNT(half), MAX(id)]" in out._jdf.queryExecution().toString()
    assert spark.conf.get("spark.sql.sources.useV1SourceList") != ""


def test_versions(spark, tmp_path):
    table = series.Versions(spark, str(tmp_path / "v"))
    with pytest.raises(ValueError, match="no version"):
        table.read()
    for day in (1, 2, 3):
        table.commit(spark.range(day), datetime(2024, 1, day))
    now = datetime(2024, 1, 3, 12)
    assert table.read(now=now).count() == 3
    assert table.read("2024-01-02 23:59:59", now).count() == 2
    assert table.read("-1d12h", now).count() == 2
    assert table.read("-12h1ms", now).count() == 2
    assert table.read("1704067200000000000.0", now).count() == 1
    (tmp_path / "v" / f"v{series._micros(datetime(2024, 1, 3, 6)):020d}").mkdir()
    assert table.read(now=now).count() == 3
    for wrong, said in (("2025-01-01", "future"), ("2023-01-01", "that old"), ("soon", "neither"), ("0", "zero")):
        with pytest.raises(ValueError, match=said):
            table.read(wrong, now)
    with pytest.raises(ValueError, match="later version"):
        table.commit(spark.range(1), datetime(2024, 1, 2))


def test_interleaved_tables_join_without_a_shuffle(spark, tmp_path):
    left = series.write_interleaved(spark.range(200).selectExpr("id AS k", "id * 2 AS a"), "parent_rows", ["k"], 4, str(tmp_path / "p"))
    right = series.write_interleaved(spark.range(600).selectExpr("id % 300 AS k", "id AS b"), "child_rows", ["k"], 4, str(tmp_path / "c"))
    out = series.interleaved_join(left, right, ["k"])
    assert out.count() == 400
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    for name in ("parent_rows", "child_rows"):
        spark.sql(f"DROP TABLE {name}")
