"""Statements of the dialect, one for each group of functions and forms: name -> (statement, the same in DuckDB's SQL if it
is written in another way there)."""

HOURS = "make_timestamp(CAST(epoch_us(ts) // 14400000000 * 14400000000 AS BIGINT))"
FILLED = f"WITH a AS (SELECT user_id, {HOURS} AS bucket, max(value) AS v, count(*) AS n FROM events WHERE event_type = 'click' GROUP BY 1, 2), s AS (SELECT user_id, unnest(generate_series(min(bucket), max(bucket), INTERVAL 4 HOUR)) AS bucket FROM a GROUP BY 1)"
GAPS = "SELECT user_id, time_bucket_gapfill(ts, '4h') AS bucket, {} AS v, count(*) AS n FROM events WHERE event_type = 'click' GROUP BY user_id, time_bucket_gapfill(ts, '4h')"
JOINED = "FROM s LEFT JOIN a ON s.user_id = a.user_id AND s.bucket = a.bucket"
PROPS = "SELECT event_id, '{\"a\": {\"b.c\": [' || event_id || ', \"x\"]}, \"n\": null, \"u\": \"' || event_type || '\"}' AS j FROM events"
P = "CAST(p_partkey AS BIGINT)"

FORMS = {
    # Time series.
    "sql_gapfill_null": (GAPS.format("interpolate(max(value), 'null')"), f"{FILLED} SELECT s.user_id, s.bucket, v, n {JOINED}"),
    "sql_gapfill_prev": (GAPS.format("interpolate(max(value), 'prev')"), f"{FILLED} SELECT s.user_id, s.bucket, coalesce(v, last_value(v IGNORE NULLS) OVER (PARTITION BY s.user_id ORDER BY s.bucket)) AS v, n {JOINED}"),
    "sql_gapfill_constant": (GAPS.format("interpolate(max(value), 0.5)"), f"{FILLED} SELECT s.user_id, s.bucket, coalesce(v, 0.5) AS v, n {JOINED}"),
    "sql_gapfill_whole": ("SELECT time_bucket_gapfill(ts, 7200) AS bucket, count(*) AS n FROM events WHERE user_id = 8 GROUP BY bucket", "WITH a AS (SELECT make_timestamp(CAST(epoch_us(ts) // 7200000000 * 7200000000 AS BIGINT)) AS bucket, count(*) AS n FROM events WHERE user_id = 8 GROUP BY 1), s AS (SELECT unnest(generate_series(min(bucket), max(bucket), INTERVAL 2 HOUR)) AS bucket FROM a) SELECT s.bucket, n FROM s LEFT JOIN a ON s.bucket = a.bucket"),
    "sql_diff": ("SELECT event_id, round(diff(value) OVER (PARTITION BY user_id ORDER BY ts), 6) AS d FROM events", "SELECT event_id, round(value - lag(value) OVER (PARTITION BY user_id ORDER BY ts), 6) AS d FROM events"),
    "sql_last_star": ("SELECT last(*) FROM events", 'SELECT arg_max(event_id, ts) AS "last(event_id)", max(ts) AS "last(ts)", arg_max(user_id, ts) AS "last(user_id)", arg_max(event_type, ts) AS "last(event_type)", arg_max(value, ts) AS "last(value)", arg_max(props, ts) AS "last(props)" FROM events'),
    "sql_first_star": ("SELECT first_row(*) FROM events WHERE user_id > 5", 'SELECT arg_min(event_id, ts) AS "first_row(event_id)", min(ts) AS "first_row(ts)", arg_min(user_id, ts) AS "first_row(user_id)", arg_min(event_type, ts) AS "first_row(event_type)", arg_min(value, ts) AS "first_row(value)", arg_min(props, ts) AS "first_row(props)" FROM events WHERE user_id > 5'),
    # JSON.
    "sql_json_path": (f"SELECT event_id, j->'a'->'b.c'->0 AS a, j->'a'->'b.c'->>1 AS b, j #>> '{{a,b.c,0}}' AS c, j->>'n' AS n, j->'n' AS jn, j->'u' AS u, j->>'none' AS none FROM ({PROPS})", f"SELECT event_id, CAST(event_id AS VARCHAR) AS a, 'x' AS b, CAST(event_id AS VARCHAR) AS c, CAST(NULL AS VARCHAR) AS n, 'null' AS jn, '\"' || (j->>'u') || '\"' AS u, CAST(NULL AS VARCHAR) AS none FROM ({PROPS})"),
    "sql_json_contains": ("SELECT event_id, props @> '{\"k\": 7}' AS has7, '{\"k\": 8}' <@ props AS in8, props ? 'k' AS has, props ?| ARRAY['z', 'k'] AS some, props ?& ARRAY['z', 'k'] AS every FROM events", "SELECT event_id, json_contains(props, '{\"k\": 7}') AS has7, json_contains(props, '{\"k\": 8}') AS in8, true AS has, true AS some, false AS every FROM events"),
    "sql_json_remove": ("SELECT event_id, props #- '{k}' AS j, json_typeof(props) AS kind, json_typeof(props->'k') AS of_k, jsonb_array_length('[1, 2]') AS n FROM events", "SELECT event_id, '{}' AS j, 'object' AS kind, 'number' AS of_k, 2 AS n FROM events"),
    "sql_json_build": ("SELECT n_nationkey, jsonb_build_object('k', n_nationkey, 'name', n_name, 'none', NULL) AS o, jsonb_build_array(n_nationkey, n_name) AS a, jsonb_pretty(jsonb_build_object('k', n_nationkey)) AS p FROM nation", "SELECT n_nationkey, '{\"k\":' || n_nationkey || ',\"name\":\"' || n_name || '\",\"none\":null}' AS o, '[' || n_nationkey || ',\"' || n_name || '\"]' AS a, '{' || chr(10) || '    \"k\": ' || n_nationkey || chr(10) || '}' AS p FROM nation"),
    "sql_json_elements": ("SELECT n_nationkey, jsonb_array_elements('[' || n_nationkey || ', \"x\", {\"a\": 1}]') AS e FROM nation", "SELECT n_nationkey, unnest([CAST(n_nationkey AS VARCHAR), '\"x\"', '{\"a\":1}']) AS e FROM nation"),
    "sql_json_agg": ("SELECT n_regionkey, json_agg(n_nationkey ORDER BY n_nationkey) AS j, jsonb_agg(DISTINCT n_regionkey) AS d FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, '[' || string_agg(n_nationkey, ',' ORDER BY n_nationkey) || ']' AS j, '[' || n_regionkey || ']' AS d FROM nation GROUP BY n_regionkey"),
    # DISTINCT ON, quantified comparisons, subqueries.
    "sql_distinct_on_subquery": ("SELECT o_custkey, o_orderkey FROM (SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_totalprice FROM orders ORDER BY o_custkey, o_totalprice DESC, o_orderkey) d WHERE o_totalprice > 200000",),
    "sql_distinct_on_limit": ("SELECT DISTINCT ON (o_custkey) o_custkey, o_totalprice AS most FROM orders ORDER BY o_custkey, o_totalprice DESC LIMIT 20 OFFSET 3",),
    "sql_any_all_array": ("SELECT p_partkey, p_size = ANY(ARRAY[10, 20, 30]) AS a, p_size > ALL(ARRAY[5, 9]) AS b, p_size + 1 <> SOME(ARRAY[2, 3]) AS c, p_size = ANY(ARRAY[1, NULL]) AS d FROM part", "SELECT p_partkey, p_size IN (10, 20, 30) AS a, p_size > 9 AS b, p_size + 1 <> 2 OR p_size + 1 <> 3 AS c, p_size IN (1, NULL) AS d FROM part"),
    "sql_any_all_subquery": ("SELECT p_partkey FROM part WHERE p_size >= ALL (SELECT p_size FROM part WHERE p_brand = 'Brand#7') OR p_partkey = ANY (SELECT l_partkey FROM lineitem WHERE l_quantity > 49)", "SELECT p_partkey FROM part WHERE p_size >= (SELECT max(p_size) FROM part WHERE p_brand = 'Brand#7') OR p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49)"),
    "sql_between_symmetric": ("SELECT p_partkey, p_size BETWEEN SYMMETRIC 40 AND 10 AS a, p_size NOT BETWEEN SYMMETRIC 30 AND 20 AS b FROM part", "SELECT p_partkey, p_size BETWEEN 10 AND 40 AS a, p_size NOT BETWEEN 20 AND 30 AS b FROM part"),
    "sql_array_subquery": ("SELECT r_regionkey, array_to_string(sort_array(ARRAY(SELECT n_name FROM nation WHERE n_regionkey = r_regionkey)), ';') AS names FROM region", "SELECT r_regionkey, string_agg(n_name, ';' ORDER BY n_name) AS names FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_regionkey"),
    "sql_array_operators": ("SELECT p_partkey, ARRAY[p_size, 1, 2] @> ARRAY[2, 1] AS a, ARRAY[p_size] <@ ARRAY[7, 8, 9] AS b, ARRAY[p_size, 50] && ARRAY[7, 8] AS c, array_to_string(ARRAY[p_size] || ARRAY[1], ',') AS d FROM part", "SELECT p_partkey, true AS a, p_size IN (7, 8, 9) AS b, p_size IN (7, 8) AS c, p_size || ',1' AS d FROM part"),
    "sql_row_comparison": ("SELECT o_orderkey FROM orders WHERE (o_custkey, o_orderkey) > (CAST(500 AS BIGINT), CAST(100 AS BIGINT)) AND (o_orderstatus, o_custkey) IN (('F', CAST(700 AS BIGINT)), ('O', CAST(800 AS BIGINT)), ('P', CAST(900 AS BIGINT)))",),
    "sql_is_nan_unknown": ("SELECT c_custkey, x IS NAN AS a, x IS NOT NAN AS b, (x > 1) IS UNKNOWN AS u, x IS NULL AS n, (x > 1) IS NOT TRUE AS nt FROM (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN CAST('NaN' AS DOUBLE) WHEN c_custkey % 3 = 1 THEN c_acctbal END AS x FROM customer)", "SELECT c_custkey, isnan(x) AS a, NOT isnan(x) AS b, (x > 1) IS NULL AS u, x IS NULL AS n, (x > 1) IS NOT TRUE AS nt FROM (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN CAST('NaN' AS DOUBLE) WHEN c_custkey % 3 = 1 THEN c_acctbal END AS x FROM customer)"),
    "sql_join_method_words": ("SELECT c_mktsegment, count(*) AS n FROM customer INNER HASH JOIN orders ON c_custkey = o_custkey GROUP BY c_mktsegment", "SELECT c_mktsegment, count(*) AS n FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_mktsegment"),
    "sql_join_merge_word": ("SELECT c_mktsegment, count(o_orderkey) AS n FROM customer LEFT MERGE JOIN orders ON c_custkey = o_custkey GROUP BY c_mktsegment", "SELECT c_mktsegment, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_mktsegment"),
    "sql_join_lookup_word": ("SELECT r_name, count(*) AS n FROM nation INNER LOOKUP JOIN region ON n_regionkey = r_regionkey GROUP BY r_name", "SELECT r_name, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name"),
    "sql_casts": ("SELECT p_partkey, p_size::STRING AS a, (p_size:::BIGINT) + 1 AS b, annotate_type(p_size, 'double') AS c, CAST(p_retailprice AS BIGINT) AS d FROM part", "SELECT p_partkey, CAST(p_size AS VARCHAR) AS a, CAST(p_size AS BIGINT) + 1 AS b, CAST(p_size AS DOUBLE) AS c, CAST(trunc(p_retailprice) AS BIGINT) AS d FROM part"),
    # Operators and mathematics.
    "sql_power_and_bits": (f"SELECT p_partkey, p_size ^ 2 AS p, 2 ^ 3 AS eight, {P} # 5 AS x, {P} << 2 AS l, {P} >> 1 AS r, ~{P} AS t, |/ CAST(p_size AS DOUBLE) AS s, round(||/ CAST(p_size AS DOUBLE), 9) AS c FROM part", f"SELECT p_partkey, pow(p_size, 2) AS p, 8.0::DOUBLE AS eight, xor({P}, 5) AS x, {P} << 2 AS l, {P} >> 1 AS r, ~{P} AS t, sqrt(p_size) AS s, round(cbrt(p_size), 9) AS c FROM part"),
    "sql_log": ("SELECT p_partkey, round(log(p_retailprice), 9) AS l, round(log(2.0, p_retailprice), 9) AS l2, round(ln(p_retailprice), 9) AS n, sqrt(p_retailprice) AS s, log(100.0) AS two FROM part", "SELECT p_partkey, round(log10(p_retailprice), 9) AS l, round(ln(p_retailprice) / ln(2.0), 9) AS l2, round(ln(p_retailprice), 9) AS n, sqrt(p_retailprice) AS s, 2.0::DOUBLE AS two FROM part"),
    "sql_math": ("SELECT p_partkey, abs(p_size - 25) AS a, CAST(ceiling(p_retailprice / 7) AS BIGINT) AS c, round(cos(p_size), 9) AS co, round(tan(p_size), 9) AS ta, CAST(div(p_partkey, 7) AS BIGINT) AS d, mod(p_size, 7) AS m, round(pi(), 9) AS pi, pow(p_size, 2) AS p, power(p_size, 3) AS p3, trunc(-p_retailprice) AS t, trunc(p_retailprice, 0) AS t0, width_bucket(p_size, 0.0, 50.0, 5) AS w, isnan(p_retailprice) AS i, round(degrees(p_size), 6) AS de, random() < 1 AS r FROM part", "SELECT p_partkey, abs(p_size - 25) AS a, CAST(ceil(p_retailprice / 7) AS BIGINT) AS c, round(cos(p_size), 9) AS co, round(tan(p_size), 9) AS ta, CAST(p_partkey // 7 AS BIGINT) AS d, p_size % 7 AS m, round(pi(), 9) AS pi, pow(p_size, 2) AS p, pow(p_size, 3) AS p3, trunc(-p_retailprice) AS t, trunc(p_retailprice) AS t0, CASE WHEN p_size >= 50 THEN 6 ELSE p_size // 10 + 1 END AS w, isnan(p_retailprice) AS i, round(degrees(p_size), 6) AS de, true AS r FROM part"),
    "sql_regex": (r"SELECT p_partkey, p_brand ~ '#\d$' AS one, p_brand ~ '#\d\d' AS two, p_type ~* '^promo$' AS i, p_name !~ '\w+\s\w+' AS n, p_name !~* 'RING' AS ni FROM part", r"SELECT p_partkey, regexp_matches(p_brand, '#\d$') AS one, regexp_matches(p_brand, '#\d\d') AS two, regexp_matches(p_type, '(?i)^promo$') AS i, NOT regexp_matches(p_name, '\w+\s\w+') AS n, NOT regexp_matches(p_name, '(?i)RING') AS ni FROM part"),
    "sql_like_escapes": ("SELECT p_partkey, like_escape(p_name, '%r!_%', '!') AS a, not_like_escape(p_name, '%ring', '') AS b, ilike_escape(p_type, 'prom_', '') AS c, similar_to_escape(p_type, '(PROMO|SMALL)', '!') AS d, not_similar_to_escape(p_type, 'L%', '!') AS e FROM part", "SELECT p_partkey, p_name LIKE '%r!_%' ESCAPE '!' AS a, p_name NOT LIKE '%ring' AS b, p_type ILIKE 'prom_' AS c, p_type IN ('PROMO', 'SMALL') AS d, p_type NOT LIKE 'L%' AS e FROM part"),
    # Strings.
    "sql_strings": (r"SELECT p_partkey, substring(p_name, 2, 3) AS a, substring(p_name FROM 3) AS b, left(p_name, 2) AS c, right(p_name, 2) AS r, btrim(concat('xx', p_name, 'x'), 'x') AS d, regexp_replace(p_name, '[aeiou]', '_') AS e, regexp_replace(p_name, '([aeiou])', '<\1>', 'g') AS f, regexp_extract(p_brand, '\d+') AS g, to_hex(p_partkey) AS h, strpos(p_name, 'r') AS i, split_part(p_name, ' ', 2) AS j, lpad(p_type, 10, '*') AS k, initcap(p_name) AS l, quote_literal(p_name) AS q FROM part", r"SELECT p_partkey, substring(p_name, 2, 3) AS a, substring(p_name, 3) AS b, p_name[:2] AS c, p_name[-2:] AS r, trim(concat('xx', p_name, 'x'), 'x') AS d, regexp_replace(p_name, '[aeiou]', '_') AS e, regexp_replace(p_name, '([aeiou])', '<\1>', 'g') AS f, regexp_extract(p_brand, '\d+') AS g, lower(to_hex(p_partkey)) AS h, strpos(p_name, 'r') AS i, split_part(p_name, ' ', 2) AS j, lpad(p_type, 10, '*') AS k, array_to_string([upper(x[1]) || lower(substring(x, 2)) FOR x IN string_split(p_name, ' ')], ' ') AS l, '''' || p_name || '''' AS q FROM part"),
    "sql_encodings": ("SELECT n_nationkey, convert_from(convert_to(n_name, 'UTF8'), 'utf-8') AS a, octet_length(convert_to(n_name || 'é', 'latin1')) AS b, octet_length(n_name || 'é') AS c, bit_length(n_name) AS d, to_english(n_nationkey - 5) AS e, sha256(n_name) AS s, md5(n_name) AS m FROM nation", "SELECT n_nationkey, n_name AS a, length(n_name) + 1 AS b, length(n_name) + 2 AS c, 8 * length(n_name) AS d, CASE WHEN n_nationkey < 5 THEN 'minus-' ELSE '' END || array_to_string([(['zero', 'one', 'two', 'three', 'four', 'five', 'six', 'seven', 'eight', 'nine'])[CAST(x AS INT) + 1] FOR x IN string_split(CAST(abs(n_nationkey - 5) AS VARCHAR), '')], '-') AS e, sha256(n_name) AS s, md5(n_name) AS m FROM nation"),
    # Conditions and errors.
    "sql_conditions": ("SELECT c_custkey, ifnull(nullif(c_nationkey, 3), -1) AS a, iferror(CAST(CASE WHEN c_nationkey > 9 THEN 'x' ELSE '7' END AS INT), -1) AS b, iserror(100 / c_nationkey) AS c, iferror(100 / c_nationkey, -1.0) AS d, least(c_nationkey, 5) AS e, pg_typeof(c_name) AS t, pg_typeof(c_acctbal) AS t2, if(c_nationkey > 9, 'x', 'y') AS f FROM customer", "SELECT c_custkey, coalesce(nullif(c_nationkey, 3), -1) AS a, CASE WHEN c_nationkey > 9 THEN -1 ELSE 7 END AS b, c_nationkey = 0 AS c, CASE WHEN c_nationkey = 0 THEN -1.0 ELSE 100::DOUBLE / c_nationkey END AS d, least(c_nationkey, 5) AS e, 'string' AS t, 'float' AS t2, CASE WHEN c_nationkey > 9 THEN 'x' ELSE 'y' END AS f FROM customer"),
    # Times.
    "sql_times": ("SELECT o_orderkey, extract_duration('hour', o_orderdate - timestamp '1995-01-01 00:00:00') AS h, extract_duration(day, o_orderdate - timestamp '1995-01-01 00:00:00') AS d, timezone('America/New_York', o_orderdate) AS z, o_orderdate AT TIME ZONE 'Asia/Tokyo' AS k, experimental_strptime(experimental_strftime(o_orderdate, '%Y-%m-%d %H:%M:%S'), '%Y-%m-%d %H:%M:%S') AS p, experimental_strftime(o_orderdate, '%d/%m/%y') AS f, extract_duration('second', age(o_orderdate, timestamp '1995-01-01 00:00:00')) AS s FROM orders", "SELECT o_orderkey, CAST(epoch(o_orderdate - TIMESTAMP '1995-01-01') / 3600 AS BIGINT) AS h, CAST(epoch(o_orderdate - TIMESTAMP '1995-01-01') / 86400 AS BIGINT) AS d, timezone('America/New_York', o_orderdate::TIMESTAMP AT TIME ZONE 'UTC') AS z, o_orderdate + INTERVAL 9 HOUR AS k, o_orderdate AS p, strftime(o_orderdate, '%d/%m/%y') AS f, epoch(o_orderdate - TIMESTAMP '1995-01-01') AS s FROM orders"),
    "sql_clocks": ("SELECT abs(extract_duration('second', now() - clock_timestamp())) < 60 AS a, statement_timestamp() = transaction_timestamp() AS b, current_timestamp() >= localtimestamp() AS c, current_date() = CAST(now() AS DATE) AS d, length(timeofday()) > 20 AS e, length(localtime()) = 15 AS f, length(CAST(current_time() AS STRING)) >= 8 AS g", "SELECT true AS a, true AS b, true AS c, true AS d, true AS e, true AS f, true AS g"),
    # Aggregates by name.
    "sql_aggregates": ("SELECT n_regionkey, count_rows() AS c, sum_int(n_nationkey) AS s, xor_agg(n_nationkey) AS x, string_agg(n_name, ';' ORDER BY n_name) AS t, concat_agg(n_name ORDER BY n_name DESC) AS u, any_not_null(n_regionkey) AS a, array_to_string(array_agg(n_nationkey ORDER BY n_nationkey DESC), ',') AS g, round(sqrdiff(n_nationkey), 6) AS q, bool_and(n_nationkey >= 0) AS b FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, count(*) AS c, CAST(sum(n_nationkey) AS BIGINT) AS s, bit_xor(n_nationkey) AS x, string_agg(n_name, ';' ORDER BY n_name) AS t, string_agg(n_name, '' ORDER BY n_name DESC) AS u, n_regionkey AS a, string_agg(n_nationkey, ',' ORDER BY n_nationkey DESC) AS g, round(var_pop(n_nationkey) * count(*), 6) AS q, true AS b FROM nation GROUP BY n_regionkey"),
    # Arrays and set-returning functions.
    "sql_arrays": ("SELECT n_nationkey, array_length(ARRAY[n_nationkey, 1], 1) AS a, array_lower(ARRAY[n_nationkey], 1) AS b, array_upper(ARRAY[n_nationkey, 5, 6], 1) AS c, array_position(ARRAY[7, n_nationkey], n_nationkey) AS d, array_to_string(array_prepend(0, ARRAY[n_nationkey]), ',') AS e, array_to_string(array_append(ARRAY[n_nationkey], 0), ',') AS f, array_to_string(array_replace(ARRAY[n_nationkey, 3], 3, 9), ',') AS g, array_to_string(array_remove(ARRAY[n_nationkey, 3], 3), ',') AS h, array_to_string(array_cat(ARRAY[1], ARRAY[n_nationkey]), ',') AS i, array_to_string(string_to_array(n_name, '_'), '|') AS j, array_to_string(array_positions(ARRAY[n_nationkey, 3, 3], 3), ',') AS k FROM nation", "SELECT n_nationkey, 2 AS a, 1 AS b, 3 AS c, CASE WHEN n_nationkey = 7 THEN 1 ELSE 2 END AS d, '0,' || n_nationkey AS e, n_nationkey || ',0' AS f, CASE WHEN n_nationkey = 3 THEN '9' ELSE n_nationkey::VARCHAR END || ',9' AS g, CASE WHEN n_nationkey = 3 THEN '' ELSE n_nationkey::VARCHAR END AS h, '1,' || n_nationkey AS i, replace(n_name, '_', '|') AS j, CASE WHEN n_nationkey = 3 THEN '1,2,3' ELSE '2,3' END AS k FROM nation"),
    "sql_unnest": ("SELECT n_nationkey, unnest(ARRAY[n_nationkey, 100]) AS u FROM nation", "SELECT n_nationkey, unnest([n_nationkey, 100]) AS u FROM nation"),
    "sql_generate_series": ("SELECT x, y FROM generate_series(1, 9, 4) AS a(x) CROSS JOIN generate_series(3, 1, -1) AS b(y)", "SELECT x, y FROM (SELECT unnest(generate_series(1, 9, 4)) AS x) CROSS JOIN (SELECT unnest(generate_series(3, 1, -1)) AS y)"),
    "sql_generate_subscripts": ("SELECT n_nationkey, generate_subscripts(ARRAY['a', 'b', n_name], 1) AS s FROM nation", "SELECT n_nationkey, unnest([1, 2, 3]) AS s FROM nation"),
    "sql_expand_array": ("SELECT n_nationkey, _pg_expandarray(ARRAY[n_name, 'z']) FROM nation", "SELECT n_nationkey, unnest([n_name, 'z']) AS x, unnest([1, 2]) AS n FROM nation"),
    "sql_ids": ("SELECT count(*) AS n, count(DISTINCT a) AS a, count(DISTINCT b) AS b, min(length(a)) AS la, min(octet_length(c)) AS lc FROM (SELECT gen_random_uuid() AS a, unique_rowid() AS b, uuid_v4() AS c FROM orders)", "SELECT count(*) AS n, count(*) AS a, count(*) AS b, 36 AS la, 16 AS lc FROM orders"),
    "sql_hashes": ("SELECT n_nationkey, crc32ieee(n_name) = crc32(encode(n_name, 'UTF-8')) AS a, fnv32('') AS b, fnv32a('') AS c, fnv64a('') = fnv64('') AS d, fnv32a('a') AS e, crc32c('123456789') AS f, crc32ieee('123456789') AS g FROM nation", "SELECT n_nationkey, true AS a, 2166136261 AS b, 2166136261 AS c, true AS d, 3826002220 AS e, 3808858755 AS f, 3421780262 AS g FROM nation"),
}
