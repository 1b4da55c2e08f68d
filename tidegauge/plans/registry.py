"""Queries over the driver tables, each with the same in DuckDB's SQL where SQL can express it.

`events` is the time-series table (time ts, primary tags user_id and event_type, metric value); the others are relational.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo, jsonb, scalar
from ..functions import timeseries as ts
from ..operators import metrics, relational
from ..operators import timeseries as series
from ..session import table, with_views
from ..shared import broadcast_if_small
from ..sources import series as ts_tables
from ..sources import tables
from ..sources.catalog import TimeSeriesTable
from . import dialect, forms

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def sql(name: str, spark_sql: str, duck_sql: str | None = None, time: str = "ts") -> None:
    """A query given as text of the dialect; `duck_sql` where DuckDB writes it in another way."""
    QUERIES[name] = lambda spark, sf_dir: dialect.query(with_views(spark, sf_dir), spark_sql, ts=time)
    SQL[name] = duck_sql or spark_sql


def frame(duck_sql: str | None = None):
    """A query given as a function of (table reader) -> DataFrame."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(lambda name: table(spark, sf_dir, name))
        if duck_sql:
            SQL[f.__name__] = duck_sql
        return f

    return add


def _floor(column: str, seconds: int) -> str:
    return f"make_timestamp(CAST(epoch_us({column}) // {seconds * 1000000} * {seconds * 1000000} AS BIGINT))"


HOUR, DAY = _floor("ts", 3600), _floor("ts", 86400)

# Time series: buckets, first and last, gaps, differences.

SQL["ts_bucket_first_last"] = f"SELECT {HOUR} AS bucket, event_type, count(*) AS n, round(avg(value), 6) AS avg_value, arg_min(value, ts) AS first_value, arg_max(value, ts) AS last_value FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-20' GROUP BY 1, 2"


def bucket_first_last(events: DataFrame) -> DataFrame:
    rows = series.scan(events, "ts", "2024-01-05 00:00:00", "2024-01-20 00:00:00", ["ts", "event_type", "value"])
    v, t = F.col("value"), F.col("ts")
    return rows.groupBy(ts.time_bucket("ts", "3600s").alias("bucket"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(v), 6).alias("avg_value"), ts.first(v, t).alias("first_value"), ts.last(v, t).alias("last_value"))


QUERIES["ts_bucket_first_last"] = lambda spark, sf_dir: bucket_first_last(table(spark, sf_dir, "events"))

NULLED = "CASE WHEN value > 50 THEN value END"
sql(
    "ts_first_last_nulls",
    f"SELECT user_id, first(x) AS f, last(x) AS l, first_row(x) AS fr, last_row(x) AS lr, firstts(x) AS ft, lastts(x) AS lt, first_row_ts(x) AS frt, last_row_ts(x) AS lrt FROM (SELECT user_id, ts, {NULLED} AS x FROM events) GROUP BY user_id",
    f"SELECT user_id, arg_min(x, ts) AS f, arg_max(x, ts) AS l, arg_min_null(x, ts) AS fr, arg_max_null(x, ts) AS lr, min(ts) FILTER (x IS NOT NULL) AS ft, max(ts) FILTER (x IS NOT NULL) AS lt, min(ts) AS frt, max(ts) AS lrt FROM (SELECT user_id, ts, {NULLED} AS x FROM events) GROUP BY user_id",
)
sql(
    "ts_last_bound",
    "SELECT event_type, last(value, '2024-01-10 12:00:00') AS v, last(value, '2020-01-01 00:00:00') AS none FROM events GROUP BY event_type",
    "SELECT event_type, arg_max(value, ts) FILTER (ts <= TIMESTAMP '2024-01-10 12:00:00') AS v, arg_max(value, ts) FILTER (ts <= TIMESTAMP '2020-01-01') AS none FROM events GROUP BY event_type",
)


@frame(f"SELECT arg_max(event_id, ts) AS \"last(event_id)\", max(ts) AS \"last(ts)\", arg_max(user_id, ts) AS \"last(user_id)\", arg_max(event_type, ts) AS \"last(event_type)\", arg_max(value, ts) AS \"last(value)\" FROM events")
def ts_last_star(t):
    return t("events").agg(*ts.star("last", ["event_id", "ts", "user_id", "event_type", "value"], "ts"))


sql("ts_bucket_day", "SELECT time_bucket(ts, '1d') AS bucket, count(*) AS n, max(value) AS most, min(value) AS least FROM events GROUP BY 1", f"SELECT {DAY} AS bucket, count(*) AS n, max(value) AS most, min(value) AS least FROM events GROUP BY 1")
sql("ts_bucket_odd_width", "SELECT time_bucket(ts, '100000s') AS bucket, count(*) AS n FROM events GROUP BY 1", f"SELECT {_floor('ts', 100000)} AS bucket, count(*) AS n FROM events GROUP BY 1")
sql("ts_bucket_month", "SELECT time_bucket(ts, '1month') AS bucket, count(*) AS n FROM events GROUP BY 1", "SELECT date_trunc('month', ts)::TIMESTAMP AS bucket, count(*) AS n FROM events GROUP BY 1")

FILLED = f"WITH a AS (SELECT user_id, {_floor('ts', 14400)} AS bucket, count(*) AS n, round(avg(value), 6) AS v FROM events WHERE event_type = 'click' GROUP BY 1, 2), s AS (SELECT user_id, unnest(generate_series(min(bucket), max(bucket), INTERVAL 4 HOUR)) AS bucket FROM a GROUP BY 1)"


@frame(FILLED + " SELECT s.user_id, s.bucket, n, v FROM s LEFT JOIN a ON s.user_id = a.user_id AND s.bucket = a.bucket")
def ts_gapfill(t):
    return series.gapfill(t("events").filter("event_type = 'click'"), "ts", "4h", {"n": F.count(F.lit(1)), "v": F.round(F.avg("value"), 6)}, ["user_id"], {"v": "null"})


@frame(FILLED + " SELECT s.user_id, s.bucket, coalesce(v, last_value(v IGNORE NULLS) OVER (PARTITION BY s.user_id ORDER BY s.bucket)) AS v, coalesce(n, 0) AS n FROM s LEFT JOIN a ON s.user_id = a.user_id AND s.bucket = a.bucket")
def ts_gapfill_previous(t):
    return series.gapfill(t("events").filter("event_type = 'click'"), "ts", "4h", {"v": F.round(F.avg("value"), 6), "n": F.count(F.lit(1))}, ["user_id"], {"v": "prev", "n": ("constant", 0)})


@frame("SELECT user_id, event_id, round(d, 6) AS d FROM (SELECT user_id, event_id, ts, value - lag(value) OVER w AS d, row_number() OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)) WHERE n > 1")
def ts_diff(t):
    return series.diff(t("events"), "value", "ts", ["user_id"], "d").select("user_id", "event_id", F.round("d", 6).alias("d"))


DOUBLED = "(SELECT user_id, date_trunc('day', ts) AS day, event_id, CASE WHEN value > 50 THEN value END AS value FROM events)"


def _doubled(t):
    return t("events").select("user_id", F.date_trunc("day", "ts").alias("day"), "event_id", F.expr("CASE WHEN value > 50 THEN value END").alias("value"))


@frame(f"SELECT user_id, day, max(event_id) AS event_id, arg_max_null(value, event_id) AS value FROM {DOUBLED} GROUP BY 1, 2")
def ts_dedup_override(t):
    return series.deduplicate(_doubled(t), ["user_id", "day"], "event_id")


@frame(f"SELECT user_id, day, min(event_id) AS event_id, arg_min_null(value, event_id) AS value FROM {DOUBLED} GROUP BY 1, 2")
def ts_dedup_discard(t):
    return series.deduplicate(_doubled(t), ["user_id", "day"], "event_id", "discard")


@frame(f"SELECT user_id, day, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM {DOUBLED} GROUP BY 1, 2")
def ts_dedup_merge(t):
    return series.deduplicate(_doubled(t), ["user_id", "day"], "event_id", "merge")


@frame("SELECT user_id, arg_min(event_type, ts) AS event_type FROM events GROUP BY 1")
def ts_tag_table(t):
    return series.tag_table(t("events"), ["user_id"], ["event_type"], "ts")


@frame("SELECT DISTINCT user_id, event_type FROM events")
def ts_tag_values(t):
    return series.tag_values(t("events"), ["user_id", "event_type"])


@frame("SELECT event_id, ts, value FROM events ORDER BY ts DESC LIMIT 25")
def ts_ordered_scan(t):
    return series.ordered_scan(t("events"), "ts", 25, True).select("event_id", "ts", "value")


@frame("SELECT count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-30' - INTERVAL 10 DAY")
def ts_retention(t):
    return series.retain(t("events"), "ts", 10, F.lit("2024-01-30").cast("timestamp")).agg(F.count(F.lit(1)).alias("n"))


@frame("SELECT count(*) AS n, count(DISTINCT user_id) AS users FROM events WHERE NOT (event_type = 'click' AND ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-15')")
def ts_delete_span(t):
    return series.delete_span(t("events"), "ts", "2024-01-05", "2024-01-15", F.col("event_type") == "click").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users"))


@frame(f"SELECT n_name, {DAY} AS bucket, count(*) AS n, round(sum(value), 4) AS total FROM events JOIN customer ON user_id = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2")
def cross_model_inside_out(t):
    dims = t("customer").join(broadcast_if_small(t("nation").select("n_nationkey", "n_name")), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("user_id"), "n_name")
    facts = t("events").withColumn("bucket", ts.time_bucket("ts", "1d"))
    out = series.aggregate_then_join(facts, dims, "user_id", {"n": F.count(F.lit(1)), "total": F.sum("value")}, ["n_name"], ["n"], ["bucket"])
    return out.select("n_name", "bucket", "n", F.round("total", 4).alias("total"))


METRICS = f"""WITH s AS (SELECT event_type AS name, user_id % 3 AS source, {_floor('ts', 10)} AS slot, arg_max(value, ts) AS v FROM events GROUP BY ALL),
p AS (SELECT name, source, {_floor('slot', 3600)} AS bucket, max(v) AS v FROM s GROUP BY ALL),
n AS (SELECT *, lead(bucket) OVER w AS nb, lead(v) OVER w AS nv FROM p WINDOW w AS (PARTITION BY name, source ORDER BY bucket)),
f AS (SELECT name, source, unnest(generate_series(bucket, coalesce(nb - INTERVAL 1 HOUR, bucket), INTERVAL 1 HOUR)) AS b, bucket, v, nb, nv FROM n),
l AS (SELECT name, b AS bucket, CASE WHEN b = bucket THEN v ELSE v + (nv - v) * (epoch(b) - epoch(bucket)) / (epoch(nb) - epoch(bucket)) END AS v FROM f),
a AS (SELECT name, bucket, avg(v) AS value FROM l GROUP BY ALL)
SELECT name, bucket, round(value, 9) AS value FROM (SELECT name, bucket, greatest((value - lag(value) OVER w) / (epoch(bucket) - epoch(lag(bucket) OVER w)), 0.0) AS value, lag(value) OVER w AS before FROM a WINDOW w AS (PARTITION BY name ORDER BY bucket)) WHERE before IS NOT NULL"""


@frame(METRICS)
def ts_metrics_derivative(t):
    rows = t("events").withColumn("source", F.col("user_id") % 3)
    return metrics.metrics_query(rows, "event_type", "source", "ts", "value", 3600, "max", "avg", "non_negative").withColumn("value", F.round("value", 9))


@frame(f"SELECT event_type, {_floor('ts', 1800)} AS bucket, count(value) AS n, round(sum(value), 4) AS total, min(value) AS least, max(value) AS most, arg_min(value, ts) AS \"first\", arg_max(value, ts) AS \"last\" FROM events GROUP BY 1, 2")
def ts_rollup(t):
    return metrics.rollup(t("events"), ["event_type"], "ts", "value").withColumn("total", F.round("total", 4)).drop("squares")


sql("ts_top_users", "SELECT user_id, max(value) AS most FROM events WHERE ts >= timestamp '2024-01-03' GROUP BY user_id ORDER BY most DESC, user_id LIMIT 10", "SELECT user_id, max(value) AS most FROM events WHERE ts >= TIMESTAMP '2024-01-03' GROUP BY user_id ORDER BY most DESC, user_id LIMIT 10")

# TPC-H, as far as the tables go.

sql(
    "tpch_q1",
    "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, CAST(sum(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18, 4))) AS DOUBLE) AS sum_disc, CAST(sum(CAST(l_extendedprice * (1 - l_discount) * (1 + l_tax) AS DECIMAL(18, 6))) AS DOUBLE) AS sum_charge, round(avg(l_quantity), 6) AS avg_qty, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= DATE '1998-09-02' GROUP BY l_returnflag, l_linestatus",
)
#: TPC-H's own text, but for columns that the tables lack (o_shippriority; addresses and phones of q10) and for nations, which have other names.
REVENUE = "CAST(sum(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18, 4))) AS DOUBLE)"
sql("tpch_q3", f"SELECT l_orderkey, {REVENUE} AS revenue, o_orderdate FROM customer, orders, lineitem WHERE c_mktsegment = 'BUILDING' AND c_custkey = o_custkey AND l_orderkey = o_orderkey AND o_orderdate < TIMESTAMP '1995-03-15 00:00:00' AND l_shipdate > TIMESTAMP '1995-03-15 00:00:00' GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC, o_orderdate, l_orderkey LIMIT 10")
sql("tpch_q5", f"SELECT n_name, {REVENUE} AS revenue FROM customer, orders, lineitem, supplier, nation, region WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND l_suppkey = s_suppkey AND c_nationkey = s_nationkey AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey AND r_name = 'ASIA' AND o_orderdate >= TIMESTAMP '1996-01-01 00:00:00' AND o_orderdate < TIMESTAMP '1997-01-01 00:00:00' GROUP BY n_name ORDER BY revenue DESC")
sql("tpch_q6", "SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue, count(*) AS n FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-01-01 00:00:00' AND l_shipdate < TIMESTAMP '1997-01-01 00:00:00' AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24")
sql("tpch_q7", f"SELECT supp_nation, cust_nation, l_year, {REVENUE} AS revenue FROM (SELECT n1.n_name AS supp_nation, n2.n_name AS cust_nation, CAST(year(l_shipdate) AS BIGINT) AS l_year, l_extendedprice, l_discount FROM supplier, lineitem, orders, customer, nation n1, nation n2 WHERE s_suppkey = l_suppkey AND o_orderkey = l_orderkey AND c_custkey = o_custkey AND s_nationkey = n1.n_nationkey AND c_nationkey = n2.n_nationkey AND ((n1.n_name = 'NATION_6' AND n2.n_name = 'NATION_7') OR (n1.n_name = 'NATION_7' AND n2.n_name = 'NATION_6')) AND l_shipdate BETWEEN TIMESTAMP '1995-01-01 00:00:00' AND TIMESTAMP '1996-12-31 00:00:00') AS shipping GROUP BY supp_nation, cust_nation, l_year ORDER BY supp_nation, cust_nation, l_year")
sql("tpch_q10", f"SELECT c_custkey, c_name, {REVENUE} AS revenue, c_acctbal, n_name FROM customer, orders, lineitem, nation WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND o_orderdate >= TIMESTAMP '1995-10-01 00:00:00' AND o_orderdate < TIMESTAMP '1996-01-01 00:00:00' AND l_returnflag = 'R' AND c_nationkey = n_nationkey GROUP BY c_custkey, c_name, c_acctbal, n_name ORDER BY revenue DESC, c_custkey LIMIT 20")
sql("tpch_q14", "SELECT round(100.0 * sum(CASE WHEN p_type LIKE 'PROMO%' THEN l_extendedprice * (1 - l_discount) ELSE 0 END) / sum(l_extendedprice * (1 - l_discount)), 6) AS promo FROM lineitem, part WHERE l_partkey = p_partkey AND l_shipdate >= TIMESTAMP '1995-09-01 00:00:00' AND l_shipdate < TIMESTAMP '1995-10-01 00:00:00'")
sql("tpch_q18", "SELECT c_name, o_orderkey, o_totalprice, sum(l_quantity) AS qty FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING sum(l_quantity) > 150) GROUP BY c_name, o_orderkey, o_totalprice")

# Joins.

sql("join_inner", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
sql("join_left", "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
sql("join_right", "SELECT o_orderkey, c_name FROM customer RIGHT JOIN orders ON c_custkey = o_custkey AND c_acctbal > 5000")
sql("join_full", "SELECT c.k AS ck, s.k AS sk FROM (SELECT DISTINCT c_nationkey AS k FROM customer WHERE c_acctbal > 9500) c FULL OUTER JOIN (SELECT DISTINCT s_nationkey AS k FROM supplier WHERE s_acctbal < 3000) s ON c.k = s.k")
sql("join_semi", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)")
sql("join_anti", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
sql("join_not_in", "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 48)")
sql("join_using", "SELECT k, a, b FROM (SELECT n_nationkey AS k, n_name AS a FROM nation) x JOIN (SELECT s_nationkey AS k, s_name AS b FROM supplier) y USING (k)")
sql("join_natural", "SELECT k, a, b FROM (SELECT n_nationkey AS k, n_name AS a FROM nation) x NATURAL JOIN (SELECT s_nationkey AS k, count(*) AS b FROM supplier GROUP BY 1) y")
sql("join_theta", "SELECT a.n_name AS x, b.n_name AS y FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
sql("join_cross", "SELECT r_name, n_name FROM region CROSS JOIN nation")
sql("join_lateral", "SELECT c_custkey, o.m FROM customer, LATERAL (SELECT max(o_totalprice) AS m FROM orders WHERE o_custkey = c_custkey) o")
sql("join_hash_hint", "SELECT /*+ SHUFFLE_HASH(orders) */ c_mktsegment, count(*) AS n FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_mktsegment", "SELECT c_mktsegment, count(*) AS n FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_mktsegment")
sql("join_merge_hint", "SELECT /*+ MERGE(orders) */ c_mktsegment, count(*) AS n FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_mktsegment", "SELECT c_mktsegment, count(*) AS n FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_mktsegment")


@frame("SELECT n_name, round(sum(s_acctbal), 4) AS total FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1")
def join_lookup(t):
    side = t("nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    return relational.lookup_join(t("supplier"), side, ["s_nationkey"]).groupBy("n_name").agg(F.round(F.sum("s_acctbal"), 4).alias("total"))


# Set operations, subqueries, CTEs.

NATIONS = ("SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 0", "SELECT s_nationkey AS k FROM supplier WHERE s_nationkey % 5 < 3")
for _op in ("UNION", "UNION ALL", "INTERSECT", "INTERSECT ALL", "EXCEPT", "EXCEPT ALL"):
    sql("set_" + _op.lower().replace(" ", "_"), f"{NATIONS[0]} {_op} {NATIONS[1]}")
sql("cte_recursive", "WITH RECURSIVE r(n, f) AS (SELECT CAST(1 AS BIGINT), CAST(1 AS BIGINT) UNION ALL SELECT n + 1, f * (n + 1) FROM r WHERE n < 15) SELECT n, f FROM r")
sql("cte_twice", "WITH a AS (SELECT o_custkey AS k, sum(o_totalprice) AS t FROM orders GROUP BY 1) SELECT a.k, round(a.t, 2) AS t FROM a WHERE a.t > (SELECT 2 * avg(t) FROM a)")
sql("subquery_correlated", "SELECT o_orderkey FROM orders o WHERE o_totalprice > (SELECT 1.5 * avg(o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)")
sql("subquery_scalar", "SELECT p_partkey, round(p_retailprice - (SELECT avg(p_retailprice) FROM part), 4) AS d FROM part")
sql("values_rows", "SELECT a, b FROM (VALUES (1, 'x'), (2, 'y'), (NULL, 'z')) AS v(a, b)")
sql("subquery_array", "SELECT r_name, array_join(array_sort(collect_list(n_name)), ',') AS names FROM region JOIN nation ON r_regionkey = n_regionkey GROUP BY r_name", "SELECT r_name, string_agg(n_name, ',' ORDER BY n_name) AS names FROM region JOIN nation ON r_regionkey = n_regionkey GROUP BY r_name")

# Aggregation.

sql("agg_filter_having", "SELECT l_returnflag AS f, count(*) FILTER (WHERE l_quantity > 25) AS n, count(DISTINCT l_suppkey) AS s FROM lineitem GROUP BY l_returnflag HAVING count(*) > 10")
sql("agg_statistics", "SELECT l_linestatus AS s, round(stddev_samp(l_quantity), 6) AS sd, round(var_samp(l_quantity), 6) AS var, round(corr(l_quantity, l_extendedprice), 6) AS corr FROM lineitem GROUP BY l_linestatus")
sql("agg_bool", "SELECT l_suppkey AS k, bool_and(l_quantity > 1) AS every_one, bool_or(l_quantity > 49) AS any_one FROM lineitem GROUP BY l_suppkey")
sql("agg_bits", "SELECT o_orderstatus AS s, bit_xor(o_orderkey) AS x FROM orders GROUP BY o_orderstatus")
sql("agg_sum_int", "SELECT l_returnflag AS f, CAST(sum(l_linenumber) AS BIGINT) AS total, max(l_shipdate) AS latest, min(l_shipdate) AS earliest FROM lineitem GROUP BY l_returnflag")
sql("agg_string", "SELECT n_regionkey AS k, listagg(n_name, ';') WITHIN GROUP (ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey AS k, string_agg(n_name, ';' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
sql("agg_empty", "SELECT count(*) AS n, max(o_totalprice) AS m, bool_and(o_totalprice > 0) AS b FROM orders WHERE o_orderkey < 0")
sql("agg_distinct", "SELECT DISTINCT p_brand, p_size FROM part")
sql("agg_ordinals", "SELECT p_brand, count(*) AS n FROM part GROUP BY 1 ORDER BY 2 DESC, 1")
sql("distinct_on", "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_totalprice FROM orders ORDER BY o_custkey, o_totalprice DESC, o_orderkey")


@frame("SELECT l_shipmonth AS m, round(sum(l_extendedprice), 2) AS total, count(*) AS n FROM (SELECT date_trunc('month', l_shipdate)::TIMESTAMP AS l_shipmonth, l_extendedprice FROM lineitem) GROUP BY 1")
def agg_salted(t):
    rows = t("lineitem").select(F.date_trunc("month", "l_shipdate").alias("m"), "l_extendedprice")
    out = relational.salted_aggregate(rows, ["m"], {"s": F.sum("l_extendedprice"), "c": F.count(F.lit(1))}, {"total": F.sum("s"), "n": F.sum("c")})
    return out.select("m", F.round("total", 2).alias("total"), "n")


# Windows, order, limits, set-returning functions.

W = "PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey"
sql("window_ranks", "SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) AS rn, rank() OVER w AS r, dense_rank() OVER w AS d, round(percent_rank() OVER w, 8) AS p, round(cume_dist() OVER w, 8) AS c FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_size)".replace("row_number() OVER (ORDER BY p_partkey)", "row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey)"))
sql("window_lag", f"SELECT o_orderkey, lag(o_totalprice, 1, 0.0) OVER ({W}) AS before, lead(o_totalprice) OVER ({W}) AS after, first_value(o_orderkey) OVER ({W}) AS first_key FROM orders")
sql("window_rows", f"SELECT o_orderkey, round(sum(o_totalprice) OVER ({W} ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING), 2) AS s, max(o_totalprice) OVER ({W} ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS m FROM orders")
sql("window_range", "SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderdate RANGE BETWEEN INTERVAL '90' DAY PRECEDING AND CURRENT ROW) AS n FROM orders")


@frame("SELECT p_partkey, round(sum(p_retailprice) OVER (PARTITION BY p_brand ORDER BY p_size GROUPS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 2) AS s FROM part")
def window_groups(t):
    return relational.groups_frame(t("part"), F.sum("p_retailprice"), ["p_brand"], ["p_size"], 1, 1, "s").select("p_partkey", F.round("s", 2).alias("s"))


@frame("SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS ordinality FROM orders")
def ordinality(t):
    return relational.with_ordinality(t("orders").select("o_totalprice", "o_orderkey"), ["o_totalprice", "o_orderkey"], rows_per_range=2000).select("o_orderkey", "ordinality")


@frame("SELECT n_nationkey, unnest(range(1, n_regionkey + 2)) AS a, unnest(['x', 'y']) AS b FROM nation")
def rows_from(t):
    return relational.rows_from(t("nation").select("n_nationkey", "n_regionkey"), a=F.sequence(F.lit(1).cast("long"), F.col("n_regionkey").cast("long") + 1), b=F.array(F.lit("x"), F.lit("y"))).drop("n_regionkey")


sql("order_nulls_limit", "SELECT a, b FROM (SELECT c_custkey AS b, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS a FROM customer) ORDER BY a NULLS FIRST, b LIMIT 20 OFFSET 5", "SELECT a, b FROM (SELECT c_custkey AS b, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS a FROM customer) ORDER BY a NULLS FIRST, b LIMIT 20 OFFSET 5")
sql("top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 15")
sql("generate_series", "SELECT explode(sequence(CAST(1 AS BIGINT), CAST(20 AS BIGINT), CAST(3 AS BIGINT))) AS g", "SELECT unnest(generate_series(CAST(1 AS BIGINT), CAST(20 AS BIGINT), 3)) AS g")

# Predicates and scalars.

sql("predicate_like", "SELECT p_partkey FROM part WHERE p_name LIKE '%a_e%' OR p_type ILIKE '%brass' OR p_name LIKE '10!%' ESCAPE '!'")
sql("predicate_similar", "SELECT p_partkey FROM part WHERE p_type SIMILAR TO '(PROMO|STAND_RD|S%L)' AND p_name SIMILAR TO '%(ring|bolt|widget)'", "SELECT p_partkey FROM part WHERE regexp_full_match(p_type, '(PROMO|STAND.RD|S.*L)') AND regexp_full_match(p_name, '.*(ring|bolt|widget)')")
sql("predicate_regex", "SELECT p_partkey, p_name ~ 'e.$' AS m, p_type ~* 'promo' AS i, p_name !~ '^[a-m]' AS n FROM part", "SELECT p_partkey, regexp_matches(p_name, 'e.$') AS m, regexp_matches(p_type, '(?i)promo') AS i, NOT regexp_matches(p_name, '^[a-m]') AS n FROM part")
sql("predicate_three_valued", "SELECT c_custkey, a IN (1, NULL) AS i, a NOT IN (1, 2) AS n, a IS NOT DISTINCT FROM b AS d, a = b AS e FROM (SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN c_nationkey END AS a, CASE WHEN c_acctbal < 5000 THEN c_nationkey END AS b FROM customer)")
sql("arithmetic", "SELECT o_orderkey, o_orderkey // 7 AS q, -o_orderkey % 7 AS m, o_orderkey & 12 AS a, o_orderkey | 3 AS o, shiftleft(o_orderkey, 2) AS l, o_orderkey / 4 AS d FROM orders", "SELECT o_orderkey, o_orderkey // 7 AS q, -o_orderkey % 7 AS m, o_orderkey & 12 AS a, o_orderkey | 3 AS o, o_orderkey << 2 AS l, o_orderkey / 4 AS d FROM orders")
sql(
    "functions_math",
    "SELECT p_partkey, round(ln(p_retailprice), 8) AS ln, round(log10(p_retailprice), 8) AS lg, round(sqrt(p_retailprice), 8) AS sq, round(cbrt(p_retailprice), 8) AS cb, CAST(ceil(p_retailprice) AS BIGINT) AS ce, CAST(floor(p_retailprice) AS BIGINT) AS fl, round(sin(p_size), 8) AS si, round(cot(p_size), 8) AS co, round(atan2(p_size, 3), 8) AS at, round(radians(p_size), 8) AS ra, CAST(sign(p_size - 25) AS DOUBLE) AS sg, round(power(p_size, 1.5), 6) AS po, round(exp(p_size / 10.0), 4) AS ex FROM part",
)
sql("functions_string", "SELECT p_partkey, length(p_name) AS n, upper(p_name) AS u, lower(p_type) AS l, reverse(p_name) AS r, substr(p_name, 2, 3) AS s, replace(p_type, 'A', 'b') AS e, left(p_name, 3) AS f, trim(concat('  ', p_name, ' ')) AS t, ascii(p_name) AS a, repeat(p_brand, 2) AS rr, bit_length(p_name) AS b, octet_length(encode(p_name, 'utf-8')) AS o FROM part", "SELECT p_partkey, length(p_name) AS n, upper(p_name) AS u, lower(p_type) AS l, reverse(p_name) AS r, substr(p_name, 2, 3) AS s, replace(p_type, 'A', 'b') AS e, left(p_name, 3) AS f, trim(concat('  ', p_name, ' ')) AS t, ascii(p_name) AS a, repeat(p_brand, 2) AS rr, bit_length(p_name) AS b, octet_length(encode(p_name)) AS o FROM part")
sql("functions_date", "SELECT o_orderkey, date_trunc('month', o_orderdate) AS m, CAST(extract(year FROM o_orderdate) AS BIGINT) AS y, CAST(extract(doy FROM o_orderdate) AS BIGINT) AS d, CAST(extract(quarter FROM o_orderdate) AS BIGINT) AS q, o_orderdate + INTERVAL '3' DAY AS p FROM orders", "SELECT o_orderkey, date_trunc('month', o_orderdate)::TIMESTAMP AS m, CAST(extract(year FROM o_orderdate) AS BIGINT) AS y, CAST(extract(doy FROM o_orderdate) AS BIGINT) AS d, CAST(extract(quarter FROM o_orderdate) AS BIGINT) AS q, o_orderdate + INTERVAL 3 DAY AS p FROM orders")
sql("functions_conditional", "SELECT c_custkey, CASE WHEN c_acctbal > 5000 THEN 'rich' WHEN c_acctbal > 0 THEN 'some' ELSE 'none' END AS w, coalesce(nullif(c_nationkey, 3), -1) AS n, greatest(c_acctbal, 100.0) AS g, if(c_acctbal < 0, 1, 0) AS i FROM customer")


@frame("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, json_contains(props, '{\"k\": 7}') AS has7 FROM events")
def json_operators(t):
    return t("events").select("event_id", jsonb.get(F.col("props"), "k").cast("long").alias("k"), jsonb.contains(F.col("props"), F.lit('{"k": 7}')).alias("has7"))


@frame("SELECT p_partkey, p_size = 10 OR p_size = 20 OR p_size = 30 AS any_eq, p_size > 5 AND p_size > 9 AS all_gt, p_size BETWEEN 10 AND 40 AS sym, p_size > 20 AS has FROM part")
def quantified(t):
    arr = lambda *x: F.array(*map(F.lit, x))
    size = F.col("p_size")
    return t("part").select("p_partkey", scalar.any_of(size, "=", arr(10, 20, 30)).alias("any_eq"), scalar.all_of(size, ">", arr(5, 9)).alias("all_gt"), scalar.between_symmetric(size, F.lit(40), F.lit(10)).alias("sym"), scalar.array_contains_all(F.sequence(F.lit(1), size), arr(21)).alias("has"))


def _table_crc(polynomial: int) -> str:
    """The remainders of all bytes for a reflected polynomial."""
    return f"list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, {polynomial}) ELSE c // 2 END))"


def _fnv_sql(bits: int, xor_first: bool) -> str:
    prime, basis = scalar.FNV[bits]
    step = f"xor(h, b) * {prime} % {1 << bits}" if xor_first else f"xor(h * {prime} % {1 << bits}, b)"
    h = f"list_reduce(list_prepend(CAST({basis} AS HUGEINT), bytes), lambda h, b: {step})"
    return f"CAST({h} - CASE WHEN {h} >= {1 << 63} THEN {1 << 64} ELSE 0 END AS BIGINT)"


def _crc_sql(table: str) -> str:
    return f"xor(list_reduce(list_prepend({0xFFFFFFFF}, low), lambda c, b: xor(c // 256, {table}[xor(c % 256, b) + 1])), {0xFFFFFFFF})"


HASHES = f"""WITH t AS (SELECT {_table_crc(scalar.CRC32C)} AS castagnoli, {_table_crc(0xEDB88320)} AS ieee),
n AS (SELECT n_nationkey, list_transform(string_split(n_name, ''), lambda c: CAST(ord(c) AS BIGINT)) AS low, list_transform(string_split(n_name, ''), lambda c: CAST(ord(c) AS HUGEINT)) AS bytes, castagnoli, ieee FROM nation, t)
SELECT n_nationkey, {_fnv_sql(32, False)} AS fnv32, {_fnv_sql(32, True)} AS fnv32a, {_fnv_sql(64, False)} AS fnv64, {_fnv_sql(64, True)} AS fnv64a, {_crc_sql("castagnoli")} AS crc32c, {_crc_sql("ieee")} AS crc32ieee FROM n"""


@frame(HASHES)
def functions_hash(t):
    x = F.col("n_name")
    return t("nation").select("n_nationkey", scalar.fnv32(x).alias("fnv32"), scalar.fnv32a(x).alias("fnv32a"), scalar.fnv64(x).alias("fnv64"), scalar.fnv64a(x).alias("fnv64a"), scalar.crc32c(x).alias("crc32c"), scalar.crc32ieee(x).alias("crc32ieee"))


@frame("SELECT c_custkey, sqrt(pow(c_nationkey - 3, 2) + pow(c_custkey % 7 - 4, 2)) AS d, c_nationkey <= 10 AND c_custkey % 7 <= 5 AS inside, 50.0 AS area FROM customer")
def geo_functions(t):
    point = F.concat(F.lit("POINT("), F.col("c_nationkey"), F.lit(" "), F.col("c_custkey") % 7, F.lit(")"))
    box = F.lit("POLYGON((0 0, 10 0, 10 5, 0 5, 0 0))")
    return t("customer").select("c_custkey", geo.st_distance(point, F.lit("POINT(3 4)")).alias("d"), geo.st_covers(box, point).alias("inside"), geo.st_area(box).alias("area"))


# Mutations.


@frame("SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_nationkey < 5 UNION ALL SELECT n_nationkey, upper(n_name) || '!', n_regionkey FROM nation WHERE n_nationkey >= 5")
def mutation_upsert(t):
    return tables.upsert(t("nation"), t("nation").filter("n_nationkey >= 5").withColumn("n_name", F.concat(F.upper("n_name"), F.lit("!"))), ["n_nationkey"])


@frame("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 0.0 ELSE c_acctbal END AS c_acctbal FROM customer WHERE c_nationkey <> 7")
def mutation_update_delete(t):
    rows = tables.update(t("customer"), {"c_acctbal": F.lit(0.0)}, F.col("c_acctbal") < 0)
    return tables.delete(rows, F.col("c_nationkey") == 7).select("c_custkey", "c_acctbal")


@frame("SELECT count(*) AS n FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def mutation_foreign_keys(t):
    return tables.foreign_key_violations(t("orders"), t("customer").filter("c_acctbal > 0"), {"o_custkey": "c_custkey"}).agg(F.count(F.lit(1)).alias("n"))


# Mutations of time-series tables.

DAILY = TimeSeriesTable("daily", "day", ("value", "n"), ("user_id", "label"), ("user_id",), 10)
DAYS = "(SELECT user_id, date_trunc('day', ts) AS day, max(value) AS value, CASE WHEN count(*) > 1 THEN count(*) END AS n, 'u' || user_id AS label FROM events WHERE event_id % 2 = {} GROUP BY ALL)"
BOTH = f"SELECT coalesce(o.user_id, w.user_id) AS user_id, coalesce(o.day, w.day) AS day, {{}} AS value, {{}} AS n FROM {DAYS.format(0)} o FULL JOIN (SELECT * FROM {DAYS.format(1)} WHERE day < TIMESTAMP '2024-01-16') w ON o.user_id = w.user_id AND o.day = w.day"


def _days(t, odd: int) -> DataFrame:
    rows = t("events").filter(F.col("event_id") % 2 == odd).groupBy("user_id", F.date_trunc("day", "ts").alias("day"))
    return rows.agg(F.max("value").alias("value"), F.expr("CASE WHEN count(1) > 1 THEN count(1) END").alias("n")).withColumn("label", F.concat(F.lit("u"), F.col("user_id")))


def _inserted(t, rule: str) -> DataFrame:
    return ts_tables.insert(_days(t, 0), _days(t, 1).filter("day < timestamp '2024-01-16'"), DAILY, rule).drop("label")


@frame(BOTH.format("CASE WHEN w.user_id IS NULL THEN o.value ELSE w.value END", "CASE WHEN w.user_id IS NULL THEN o.n ELSE w.n END"))
def ts_insert_override(t):
    return _inserted(t, "override")


@frame(BOTH.format("CASE WHEN o.user_id IS NULL THEN w.value ELSE o.value END", "CASE WHEN o.user_id IS NULL THEN w.n ELSE o.n END"))
def ts_insert_discard(t):
    return _inserted(t, "discard")


@frame(BOTH.format("coalesce(w.value, o.value)", "coalesce(w.n, o.n)"))
def ts_insert_merge(t):
    return _inserted(t, "merge")


@frame(f"SELECT user_id, day, CASE WHEN user_id < 20 THEN 'low' ELSE label END AS label FROM {DAYS.format(0)}")
def ts_update_tags(t):
    return ts_tables.update_tags(_days(t, 0), DAILY, {"label": F.lit("low")}, F.col("user_id") < 20).select("user_id", "day", "label")


@frame(f"SELECT user_id, day, CAST(value AS VARCHAR) IS NOT NULL AS text, label AS name, CAST(NULL AS DOUBLE) AS extra FROM {DAYS.format(0)}")
def ts_alter(t):
    out, _ = ts_tables.alter(_days(t, 0), DAILY, add={"extra": "double"}, drop=["n"], rename={"label": "name"}, retype={"value": "string"})
    return out.withColumn("text", F.col("value").isNotNull()).drop("value")


def ts_statistic_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = [F.count(F.lit(1)).alias("n"), F.count("value").alias("filled"), F.min("event_id").alias("least"), F.max("event_id").alias("most"), F.max("value").alias("high")]
    return ts_tables.statistic_scan(spark, f"{sf_dir}/events.parquet", asked)


QUERIES["ts_statistic_scan"] = ts_statistic_scan
SQL["ts_statistic_scan"] = "SELECT count(*) AS n, count(value) AS filled, min(event_id) AS least, max(event_id) AS most, max(value) AS high FROM events"


for _name, (_text, *_duck) in forms.FORMS.items():
    sql(_name, _text, *_duck)
