import pytest
from pyspark.sql import functions as F

from tidegauge.functions import geo, jsonb, scalar
from tidegauge.plans import dialect
from tidegauge.sources import tables
from tidegauge.sources.catalog import Catalog, Sequence, TimeSeriesTable


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_hashes_of_known_strings(spark):
    x = F.lit("123456789")
    assert one(spark, scalar.crc32c(x)) == 0xE3069283
    assert one(spark, scalar.crc32ieee(x)) == 0xCBF43926
    assert one(spark, scalar.fnv32a(F.lit("a"))) == 0xE40C292C
    assert one(spark, scalar.fnv64a(F.lit("a"))) == 0xAF63DC4C8601EC8C - (1 << 64)
    assert one(spark, scalar.fnv32(F.lit("a"))) == 0x050C5D7E


@pytest.mark.parametrize("call", [lambda: scalar.ln(F.lit(0.0)), lambda: scalar.log(F.lit(-1.0)), lambda: scalar.sqrt(F.lit(-4.0)), lambda: scalar.pow_int(F.lit(10), F.lit(30))])
def test_math_errors(spark, call):
    with pytest.raises(Exception):
        one(spark, call())


def test_math(spark):
    assert one(spark, scalar.log(F.lit(100.0))) == pytest.approx(2)
    assert one(spark, scalar.div(F.lit(9), F.lit(-2))) == -4
    assert one(spark, scalar.trunc(F.lit(-1.57), 1)) == -1.5
    assert one(spark, scalar.pow_int(F.lit(3), F.lit(4))) == 81


@pytest.mark.parametrize("text,pattern,expected", [("abc", "abc", True), ("abc", "a", False), ("abc", "%(b|d)%", True), ("abc", "(b|c)%", False), ("a.c", "a.c", True), ("abc", "a.c", False), ("abc", "a_c", True)])
def test_similar_to(spark, text, pattern, expected):
    assert one(spark, scalar.similar_to(F.lit(text), pattern)) is expected


def test_geometry():
    g = geo.parse
    box, inner, far = g("POLYGON((0 0, 4 0, 4 4, 0 4, 0 0))"), g("POINT(1 1)"), g("POINT(7 8)")
    assert geo.distance(box, far) == 5 and geo.distance(box, inner) == 0 and geo.area(box) == 16
    assert geo.contains(box, inner) and not geo.contains(box, g("POINT(0 1)")) and geo.covers(box, g("POINT(0 1)"))
    assert geo.touches(box, g("POINT(0 1)")) and not geo.touches(box, inner)
    assert geo.touches(box, g("POLYGON((4 0, 8 0, 8 4, 4 4, 4 0))")) and geo.intersects(box, g("LINESTRING(-1 -1, 5 5)"))
    assert geo.equals(box, g("POLYGON((4 0, 4 4, 0 4, 0 0, 4 0))")) and not geo.equals(box, inner)
    with pytest.raises(ValueError):
        g("CIRCLE(1)")


def test_json(spark):
    assert one(spark, jsonb.contains(F.lit('{"a": [1, {"b": 2}]}'), F.lit('{"a": [{"b": 2}]}'))) is True
    assert one(spark, jsonb.has_any(F.lit('{"a": 1}'), F.array(F.lit("z"), F.lit("a")))) is True
    assert one(spark, jsonb.has_all(F.lit('{"a": 1}'), F.array(F.lit("z"), F.lit("a")))) is False
    assert one(spark, jsonb.remove(F.lit('{"a": {"b": 1}}'), F.array(F.lit("a"), F.lit("b")))) == '{"a": {}}'
    assert one(spark, jsonb.typeof(F.lit("[1]"))) == "array"


def test_dialect(spark):
    spark.createDataFrame([(1, "x", 1), (1, "y", 2), (2, None, 3)], "a int, b string, t int").createOrReplaceTempView("dt")
    got = dialect.query(spark, "SELECT DISTINCT ON (a) a, b FROM dt ORDER BY a, t DESC").collect()
    assert [tuple(r) for r in got] == [(1, "y"), (2, None)]
    assert dialect.query(spark, "SELECT first(b) AS f, last_row(b) AS l FROM dt", ts="t").first() == ("x", None)
    assert dialect.query(spark, "SELECT count(*) AS n FROM dt WHERE b SIMILAR TO '(x|z)' AND a // 2 = :q", {"q": 0}).first().n == 1
    with pytest.raises(ValueError):
        dialect.rewrite("SELECT DISTINCT ON (a) a FROM dt ORDER BY b")


def test_mutations(spark):
    t = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    new = spark.createDataFrame([(2, "b"), (3, "c")], "k int, v string")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(tables.upsert(t, new, ["k"])) == [(1, "a"), (2, "b"), (3, "c")]
    assert rows(tables.upsert(t, new, ["k"], update=False)) == [(1, "a"), (2, None), (3, "c")]
    assert rows(tables.update_from(t, new, ["k"], {"v": "v"})) == [(1, "a"), (2, "b")]
    assert rows(tables.delete(t, F.col("v") == "a")) == [(2, None)]
    assert rows(tables.insert(t.limit(1), new.select("k"), {"v": F.lit("d")})) == [(1, "a"), (2, "d"), (3, "d")]
    with pytest.raises(tables.TimeSeriesError):
        tables.update(t, {"v": F.lit("z")}, F.lit(True), time_series=True)
    with pytest.raises(Exception, match="CHECK"):
        tables.check(t, F.col("k") < 2, "small").collect()


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 'say "hi", you'), (2, None), (3, "x|y")], "k int, v string")
    tables.write_csv(df, str(tmp_path / "t"), delimiter="|", nullas="\\N")
    back = tables.read_csv(spark, str(tmp_path / "t"), "k int, v string, w double", ["k", "v"], delimiter="|", nullif="\\N")
    assert sorted(map(tuple, back.collect())) == [(1, 'say "hi", you', None), (2, None, None), (3, "x|y", None)]


def test_catalog(spark):
    c = Catalog(spark)
    c.register("cat_t", spark.createDataFrame([(1, 2.0, "a")], "t int, v double, g string"), TimeSeriesTable("cat_t", "t", ("v",), ("g",), ("g",), 10))
    assert [r.role for r in c.show_columns("cat_t").collect()] == ["ts", "metric", "ptag"]
    assert c.show_tag_values("cat_t").first().g == "a" and c.show_retentions().first().retention_days == 10
    c.create_function("Twice", lambda s: s * 2, "double")
    assert spark.sql("SELECT twice(v) AS x FROM cat_t").first().x == 4.0
    with pytest.raises(ValueError):
        c.create_function("twice", lambda s: s, "double")
    c.drop_function("twice")
    s = Sequence()
    assert (s.nextval(), s.nextval(), s.currval(), s.setval(9), s.nextval()) == (1, 2, 2, 9, 10)


def test_integer_power_is_exact(spark):
    from pyspark.sql import functions as F

    from tidegauge.functions import scalar

    rows = [(3, 39), (-3, 39), (2, 62), (-2, 63), (7, 0), (0, 5), (1, 10**6), (-1, 10**6 + 1), (10, 18)]
    df = spark.createDataFrame(rows, "x long, y long")
    assert [r[0] for r in df.select(scalar.pow_int(F.col("x"), F.col("y"))).collect()] == [x**y for x, y in rows]
    for x, y in ((2, 63), (3, 41), (10, 400), (2, -1)):
        with pytest.raises(Exception, match="out of range"):
            spark.createDataFrame([(x, y)], "x long, y long").select(scalar.pow_int(F.col("x"), F.col("y"))).collect()


def test_checksums_of_many_texts(spark):
    from pyspark.sql import functions as F

    from tidegauge.functions import scalar

    texts = ["123456789", "", None, "a", "é" * 300, "123456789"]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", scalar.crc32c(F.col("t")).alias("c"), scalar.fnv64a(F.col("t")).alias("f")).orderBy("k").collect()

    def fnv(t):
        h = 0xCBF29CE484222325
        for byte in t.encode():
            h = ((h ^ byte) * 0x100000001B3) % 2**64
        return h - 2**64 if h >= 2**63 else h

    assert [r.f for r in rows] == [None if t is None else fnv(t) for t in texts]
    assert (rows[0].c, rows[1].c, rows[2].c, rows[5].c) == (0xE3069283, 0, None, 0xE3069283)


def test_json_keys_with_dots_and_brackets(spark):
    from pyspark.sql import functions as F

    from tidegauge.functions import jsonb

    df = spark.createDataFrame([('{"a.b": {"c[0]": [5, 6]}, "a": {"b": 1}}',)], "j string")
    assert df.select(jsonb.get(F.col("j"), "a.b", "c[0]", 1)).first()[0] == "6"
