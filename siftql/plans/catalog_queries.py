"""The engine's registered queries: text in its language, and the same in SQL for DuckDB."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from siftql.engine import Engine
from siftql.sources import readers
from siftql.streaming.continuous import select_stream, windowed

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages")


def engine_over(spark: SparkSession, sf_dir: str, tables: tuple[str, ...] = TABLES) -> Engine:
    e = Engine(spark)
    for name in tables:
        e.register(name, spark.read.parquet(f"{sf_dir}/{name}.parquet"))
    return e


_SHIP = "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE "
#: name: (text of the engine, SQL or None if it is the same text)
TEXTS: dict[str, tuple[str, str | None]] = {
    "scan_project": ("SELECT n_nationkey, n_name FROM nation", None),
    "scan_star": ("SELECT * FROM supplier", None),
    "star_and_expression": ("SELECT *, s_acctbal * 2 AS twice FROM supplier", None),
    "filter_compare": (_SHIP + "l_quantity > 25 AND l_discount >= 0.05", None),
    "filter_not": (_SHIP + "NOT (l_quantity > 25) AND l_linenumber != 3", None),
    "arith_int_div": ("SELECT o_orderkey, o_orderkey / 7 AS q, o_orderkey % 7 AS r, o_orderkey + 3 AS p, o_orderkey * 2 - 1 AS m FROM orders", "SELECT o_orderkey, o_orderkey // 7 AS q, o_orderkey % 7 AS r, o_orderkey + 3 AS p, o_orderkey * 2 - 1 AS m FROM orders"),
    "arith_float": ("SELECT l_orderkey, l_linenumber, l_extendedprice / 4 AS quarter, -l_quantity AS less FROM lineitem", None),
    "string_to_number": ("SELECT c_custkey, split(c_name, \"#\") IN (\"x\") AS hit, toint(array.index(split(c_name, \"#\"), 1)) + 1 AS n FROM customer", "SELECT c_custkey, list_contains(string_split(c_name, '#'), 'x') AS hit, try_cast(string_split(c_name, '#')[2] AS BIGINT) + 1 AS n FROM customer"),
    "between_exclusive": ("SELECT p_partkey, p_size FROM part WHERE p_size BETWEEN 10 AND 20", "SELECT p_partkey, p_size FROM part WHERE p_size > 10 AND p_size < 20"),
    "not_between": ("SELECT p_partkey, p_size FROM part WHERE p_size NOT BETWEEN 10 AND 20", "SELECT p_partkey, p_size FROM part WHERE NOT (p_size > 10 AND p_size < 20)"),
    "like_glob": ('SELECT p_partkey, p_name FROM part WHERE p_name LIKE "*r*ing"', "SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%r%ing'"),
    "not_like": ('SELECT p_partkey, p_brand FROM part WHERE p_brand NOT LIKE "%1"', "SELECT p_partkey, p_brand FROM part WHERE p_brand NOT LIKE '%1'"),
    "in_list": ("SELECT event_id, event_type FROM events WHERE event_type IN (\"click\", \"error\")", "SELECT event_id, event_type FROM events WHERE event_type IN ('click', 'error')"),
    "not_in": ("SELECT event_id, event_type FROM events WHERE event_type NOT IN (\"click\", \"error\")", "SELECT event_id, event_type FROM events WHERE event_type NOT IN ('click', 'error')"),
    "in_subquery": ("SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2) AND c_acctbal > 0", None),
    "contains_op": ("SELECT doc_id FROM documents WHERE text CONTAINS \"eau\"", "SELECT doc_id FROM documents WHERE contains(text, 'eau')"),
    "intersects": ("SELECT event_id FROM events WHERE split(event_type, \"i\") INTERSECTS (\"cl\", \"v\")", "SELECT event_id FROM events WHERE list_has_any(string_split(event_type, 'i'), ['cl', 'v'])"),
    "exists_op": ('SELECT event_id FROM (SELECT event_id, event_type AS et IF value > 9, value AS v IF event_type != "click" FROM events) AS e WHERE EXISTS et', "SELECT event_id FROM (SELECT event_id, CASE WHEN value > 9 THEN event_type END AS et, CASE WHEN event_type <> 'click' THEN value END AS v FROM events) AS e WHERE et IS NOT NULL"),
    "null_compare": ('SELECT event_id, et = NULL AS a, et != NULL AS b, v = NULL AS c FROM (SELECT event_id, event_type AS et IF value > 9, value AS v IF event_type != "click" FROM events) AS e', "SELECT event_id, et IS NULL AS a, et IS NOT NULL AS b, v IS NULL AS c FROM (SELECT event_id, CASE WHEN value > 9 THEN event_type END AS et, CASE WHEN event_type <> 'click' THEN value END AS v FROM events) AS e"),
    "is_null": ('SELECT event_id FROM (SELECT event_id, event_type AS et IF value > 9, value AS v IF event_type != "click" FROM events) AS e WHERE et IS NOT NULL AND v IS NULL', "SELECT event_id FROM (SELECT event_id, CASE WHEN value > 9 THEN event_type END AS et, CASE WHEN event_type <> 'click' THEN value END AS v FROM events) AS e WHERE et IS NOT NULL AND v IS NULL"),
    "time_compare": ("SELECT o_orderkey FROM orders WHERE o_orderdate > \"1996-06-30\"", "SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1996-06-30 00:00:01'"),
    "bool_dsl": ("SELECT event_id FROM events FILTER AND (value > 5, OR (event_type == \"click\", event_type == \"error\"))", "SELECT event_id FROM events WHERE value > 5 AND (event_type = 'click' OR event_type = 'error')"),
    "filter_statement": ("FILTER AND ( value > 5, NOT OR ( event_type == \"click\", event_type LIKE \"e*\" ) ) FROM events", "SELECT * FROM events WHERE value > 5 AND NOT (event_type = 'click' OR event_type LIKE 'e%')"),
    "filter_missing_name": ("SELECT event_id FROM events FILTER OR ( nosuch > 3, value > 90 )", "SELECT event_id FROM events WHERE value > 90"),
    "column_guard": ("SELECT event_id, value AS v IF value > 10 FROM events", "SELECT event_id, CASE WHEN value > 10 THEN value END AS v FROM events"),
    "auto_alias": ("SELECT l_returnflag, count(l_orderkey), max(l_quantity), count(*) FROM lineitem GROUP BY l_returnflag", 'SELECT l_returnflag, count(l_orderkey) AS ct_l_orderkey, max(l_quantity) AS max_l_quantity, count(*) AS "count(*)" FROM lineitem GROUP BY l_returnflag'),
    "literal_select": ("SELECT 1 AS one, \"a\" AS a, @@wait_timeout AS w", "SELECT 1::BIGINT AS one, 'a' AS a, 28800::BIGINT AS w"),
    "join_inner": ("SELECT o.o_orderkey, c.c_name FROM orders AS o INNER JOIN customer AS c ON o.o_custkey = c.c_custkey", None),
    "join_multi": ("SELECT a.l_orderkey, a.l_linenumber, b.l_quantity FROM lineitem a INNER JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber WHERE a.l_quantity > 40", None),
    "join_expression_key": ("SELECT n.n_name, r.r_name FROM nation n INNER JOIN region r ON lower(r.r_name) = \"asia\" AND n.n_regionkey = r.r_regionkey", "SELECT n.n_name, r.r_name FROM nation n INNER JOIN region r ON lower(r.r_name) = 'asia' AND n.n_regionkey = r.r_regionkey"),
    "join_subquery": ("SELECT c.c_custkey, o.n FROM customer c INNER JOIN (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_totalprice > 1000 GROUP BY o_custkey) AS o ON c.c_custkey = o.k", None),
    "join_3way": ("SELECT c.c_custkey, n.n_name, r.r_name FROM customer c INNER JOIN nation n ON c.c_nationkey = n.n_nationkey INNER JOIN region r ON n.n_regionkey = r.r_regionkey", None),
    "join_left": ('SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT JOIN (SELECT o_orderkey, o_custkey FROM orders WHERE o_totalprice > 300000) AS o ON c.c_custkey = o.o_custkey', 'SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT JOIN (SELECT o_orderkey, o_custkey FROM orders WHERE o_totalprice > 300000) AS o ON c.c_custkey = o.o_custkey'),
    "join_right": ('SELECT c.c_custkey, o.o_orderkey FROM (SELECT c_custkey FROM customer WHERE c_nationkey < 12) AS c RIGHT JOIN (SELECT o_orderkey, o_custkey FROM orders WHERE o_totalprice > 300000) AS o ON c.c_custkey = o.o_custkey', 'SELECT c.c_custkey, o.o_orderkey FROM (SELECT c_custkey FROM customer WHERE c_nationkey < 12) AS c RIGHT JOIN (SELECT o_orderkey, o_custkey FROM orders WHERE o_totalprice > 300000) AS o ON c.c_custkey = o.o_custkey'),
    "join_full": ('SELECT c.c_custkey, o.o_orderkey FROM (SELECT c_custkey FROM customer WHERE c_nationkey < 12) AS c FULL JOIN (SELECT o_orderkey, o_custkey FROM orders WHERE o_totalprice > 300000) AS o ON c.c_custkey = o.o_custkey', 'SELECT c.c_custkey, o.o_orderkey FROM (SELECT c_custkey FROM customer WHERE c_nationkey < 12) AS c FULL JOIN (SELECT o_orderkey, o_custkey FROM orders WHERE o_totalprice > 300000) AS o ON c.c_custkey = o.o_custkey'),
    "join_theta": ("SELECT r.r_name, n.n_name FROM region r INNER JOIN nation n ON n.n_regionkey < r.r_regionkey", None),
    "join_cross": ("SELECT r.r_name, n.n_name FROM region r CROSS JOIN nation n", None),
    "join_semi": ("SELECT c.c_custkey FROM customer c LEFT SEMI JOIN orders o ON c.c_custkey = o.o_custkey", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)"),
    "from_subquery": ("SELECT k, n FROM (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY o_custkey) AS o WHERE n > 12", None),
    "agg_count": ("SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY l_returnflag", None),
    "agg_sum": ("SELECT l_returnflag, sum(l_linenumber) AS s FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, sum(l_linenumber)::BIGINT AS s FROM lineitem GROUP BY l_returnflag"),
    "agg_avg": ("SELECT l_returnflag, l_linestatus, avg(l_linenumber) AS a FROM lineitem GROUP BY l_returnflag, l_linestatus", None),
    "agg_having": ("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING n > 12", None),
    "agg_global": ("SELECT count(*) AS n, min(o_orderkey) AS a, max(o_orderkey) AS b FROM orders", None),
    "agg_literal_group": ("SELECT count(*) AS n FROM orders GROUP BY \"-\"", "SELECT count(*) AS n FROM orders"),
    "agg_count_distinct": ("SELECT o_orderstatus, count(DISTINCT o_custkey) AS n FROM orders GROUP BY o_orderstatus", None),
    "agg_expression": ("SELECT o_orderstatus, count(*) + 1 AS n, max(o_custkey) - min(o_custkey) AS span FROM orders GROUP BY o_orderstatus", None),
    "agg_nested_argument": ("SELECT AVG(CHAR_LENGTH(CAST(c_name AS CHAR))) AS a FROM customer", "SELECT avg(strlen(c_name)) AS a FROM customer"),
    "agg_by_function": ("SELECT yy(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY yy(o_orderdate)", "SELECT (year(o_orderdate) % 100)::BIGINT AS y, count(*) AS n FROM orders GROUP BY 1"),
    "order_limit": ("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey DESC LIMIT 20", None),
    "order_offset": ("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 10 OFFSET 30", None),
    "order_by_two": ("SELECT l_orderkey, l_linenumber FROM lineitem ORDER BY l_orderkey DESC, l_linenumber ASC LIMIT 50", None),
    "limit_of_aggregate": ("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey ORDER BY n DESC, o_custkey LIMIT 5", None),
    "distinct": ("SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem", None),
    "fn_math": ("SELECT p_partkey, pow(p_size, 2) AS p2, sqrt(p_size) AS r, sum(p_size, 2) AS s, avg(p_size, 4) AS a FROM part", "SELECT p_partkey, pow(p_size, 2) AS p2, sqrt(p_size) AS r, (p_size + 2)::DOUBLE AS s, (p_size + 4) / 2 AS a FROM part"),
    "fn_logic": ("SELECT p_partkey, eq(p_size, 3) AS a, ne(p_size, 3) AS b, gt(p_size, 9) AS c, le(p_size, 9) AS d, not(p_size > 9) AS e, any(p_name) AS f, oneof(p_name, p_brand) AS g, exists(p_type) AS h FROM part", "SELECT p_partkey, p_size = 3 AS a, p_size <> 3 AS b, p_size > 9 AS c, p_size <= 9 AS d, NOT p_size > 9 AS e, p_name IS NOT NULL AND p_name <> '' AS f, coalesce(nullif(p_name, ''), p_brand) AS g, p_type IS NOT NULL AND p_type <> '' AS h FROM part"),
    "fn_cast": ("SELECT o_orderkey, cast(o_orderkey AS string) AS s, toint(\"5.75\") AS i, tonumber(\"$22.5\") AS n, tobool(\"t\") AS b, tostring(o_custkey) AS t, toint(o_orderdate) AS ms FROM orders", "SELECT o_orderkey, o_orderkey::VARCHAR AS s, 5::BIGINT AS i, 22.5::DOUBLE AS n, true AS b, o_custkey::VARCHAR AS t, epoch_ms(o_orderdate) AS ms FROM orders"),
    "fn_time": ("SELECT event_id, yy(ts) AS y, mm(ts) AS m, yymm(ts) AS ym, dayofweek(ts) AS dw, hourofday(ts) AS h, hourofweek(ts) AS hw, totimestamp(ts) AS s FROM events", "SELECT event_id, (year(ts) % 100)::BIGINT AS y, month(ts) AS m, strftime(ts, '%y%m') AS ym, dayofweek(ts) AS dw, hour(ts) AS h, dayofweek(ts) * 24 + hour(ts) AS hw, floor(epoch(ts))::BIGINT AS s FROM events"),
    "fn_time_text": ("SELECT event_id, strftime(ts, \"%Y/%m/%d %H:%M\") AS f, unixtrunc(ts) AS u, todate(\"02/01/2006\", \"13/04/2014\") AS d FROM events", "SELECT event_id, strftime(ts, '%Y/%m/%d %H:%M') AS f, floor(epoch(ts))::BIGINT::VARCHAR AS u, TIMESTAMP '2014-04-13 00:00:00' AS d FROM events"),
    "fn_string": ("SELECT p_partkey, tolower(p_brand) AS a, string.uppercase(p_name) AS b, string.index(p_name, \" \") AS c, string.substr(p_brand, 1, 3) AS d, replace(p_name, \"a\", \"\") AS e, len(p_name) AS f, hasprefix(p_name, \"p\") AS g, hassuffix(p_name, \"1\") AS h, join(p_name, p_brand, \"-\") AS i, contains(p_name, \"1\") AS j, strip(p_name) AS k FROM part", "SELECT p_partkey, lower(p_brand) AS a, upper(p_name) AS b, CASE WHEN instr(p_name, ' ') > 0 THEN (instr(p_name, ' ') - 1)::BIGINT END AS c, substring(p_brand, 2, 2) AS d, replace(p_name, 'a', '') AS e, strlen(p_name) AS f, starts_with(p_name, 'p') AS g, ends_with(p_name, '1') AS h, p_name || '-' || p_brand AS i, contains(p_name, '1') AS j, trim(p_name) AS k FROM part"),
    "fn_string_bytes": ("SELECT doc_id, len(text) AS n FROM documents", "SELECT doc_id, strlen(text) AS n FROM documents"),
    "fn_hash": ("SELECT c_custkey, hash.md5(c_name) AS a, hash.sha1(c_name) AS b, hash.sha256(c_name) AS c FROM customer", "SELECT c_custkey, md5(c_name) AS a, sha1(c_name) AS b, sha256(c_name) AS c FROM customer"),
    "fn_base64": ("SELECT c_custkey, encoding.b64encode(c_name) AS a, encoding.b64decode(encoding.b64encode(c_name)) AS b FROM customer", "SELECT c_custkey, to_base64(c_name::BLOB) AS a, c_name AS b FROM customer"),
    "fn_url": ("SELECT page_id, host(url) AS h, path(url) AS p, domain(url) AS d, urlmain(url) AS m FROM pages", "SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)) AS h, lower(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1)) AS p, array_to_string(list_slice(string_split(lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)), '.'), -2, -1), '.') AS d, lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)) || regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS m FROM pages"),
    "fn_json": ("SELECT event_id, toint(json.jmespath(props, \"k\")) AS k FROM events", "SELECT event_id, json_extract(props, '$.k')::BIGINT AS k FROM events"),
    "fn_array": ("SELECT c_custkey, array.index(split(c_name, \"#\"), 0) AS a, array.index(split(c_name, \"#\"), -1) AS b, len(array.slice(split(c_name, \"0\"), 1)) AS c FROM customer", "SELECT c_custkey, string_split(c_name, '#')[1] AS a, string_split(c_name, '#')[-1] AS b, len(string_split(c_name, '0')) - 1 AS c FROM customer"),
    "fn_map": ("SELECT n_nationkey, array.index(mapkeys(map(n_name, n_regionkey)), 0) AS k, array.index(mapvalues(map(n_name, n_regionkey)), 0) AS v FROM nation", "SELECT n_nationkey, n_name AS k, n_regionkey::VARCHAR AS v FROM nation"),
    "fn_filter": ("SELECT c_custkey, filtermatch(c_mktsegment, \"B*\") AS a, filter(c_mktsegment, \"B\") AS b FROM customer", "SELECT c_custkey, CASE WHEN starts_with(c_mktsegment, 'B') THEN c_mktsegment END AS a, CASE WHEN NOT starts_with(c_mktsegment, 'B') THEN c_mktsegment END AS b FROM customer"),
    "tpch_q1": ("SELECT l_returnflag, l_linestatus, count(*) AS n, max(l_extendedprice) AS m, min(l_discount) AS d FROM lineitem WHERE l_shipdate < \"1998-09-02\" GROUP BY l_returnflag, l_linestatus ORDER BY l_returnflag, l_linestatus", "SELECT l_returnflag, l_linestatus, count(*) AS n, max(l_extendedprice) AS m, min(l_discount) AS d FROM lineitem WHERE l_shipdate < TIMESTAMP '1998-09-02' GROUP BY 1, 2"),
    "tpch_q5": ("SELECT n.n_name, count(*) AS lines, max(l.l_extendedprice) AS top FROM customer c INNER JOIN orders o ON c.c_custkey = o.o_custkey INNER JOIN lineitem l ON l.l_orderkey = o.o_orderkey INNER JOIN nation n ON c.c_nationkey = n.n_nationkey INNER JOIN region r ON n.n_regionkey = r.r_regionkey WHERE r.r_name = \"ASIA\" GROUP BY n.n_name ORDER BY lines DESC, n.n_name", "SELECT n.n_name, count(*) AS lines, max(l.l_extendedprice) AS top FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey JOIN lineitem l ON l.l_orderkey = o.o_orderkey JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey WHERE r.r_name = 'ASIA' GROUP BY n.n_name"),
    'where_not_null_rows': ('SELECT event_id FROM (SELECT event_id, event_type AS et IF value > 9, value AS v IF event_type != "click" FROM events) AS e WHERE NOT (v > 20) AND et NOT IN ("view")', "SELECT event_id FROM (SELECT event_id, CASE WHEN value > 9 THEN event_type END AS et, CASE WHEN event_type <> 'click' THEN value END AS v FROM events) AS e WHERE NOT coalesce(v > 20, false) AND NOT coalesce(et IN ('view'), false)"),
    'where_or_null_rows': ('SELECT event_id, v > 20 AS big FROM (SELECT event_id, event_type AS et IF value > 9, value AS v IF event_type != "click" FROM events) AS e WHERE v > 20 OR et = "error"', "SELECT event_id, coalesce(v > 20, false) AS big FROM (SELECT event_id, CASE WHEN value > 9 THEN event_type END AS et, CASE WHEN event_type <> 'click' THEN value END AS v FROM events) AS e WHERE v > 20 OR et = 'error'"),
    'number_as_condition': ('SELECT l_orderkey, l_linenumber FROM lineitem FILTER AND ( l_tax, l_quantity > 40 )', 'SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_tax <> 0 AND l_quantity > 40'),
    'array_literal': ('SELECT n_nationkey, len(["a", "b", n_name]) AS n, array.index(["a", n_name], 1) AS x FROM nation', 'SELECT n_nationkey, 3::BIGINT AS n, n_name AS x FROM nation'),
    'map_step_in': ('SELECT n_nationkey FROM (SELECT n_nationkey, map(n_name, n_regionkey) AS m FROM nation) AS n WHERE m.`NATION_7` = 2 OR m CONTAINS "NATION_9"', "SELECT n_nationkey FROM nation WHERE n_name = 'NATION_7' AND n_regionkey = 2 OR n_name = 'NATION_9'"),
    'match_all': ('FILTER * FROM region', 'SELECT * FROM region'),
    'time_between': ('SELECT o_orderkey FROM orders WHERE o_orderdate BETWEEN "1996-06-30" AND "1996-12-31"', "SELECT o_orderkey FROM orders WHERE o_orderdate > TIMESTAMP '1996-06-30 00:00:00' AND o_orderdate < TIMESTAMP '1996-12-31 00:00:00'"),
    'time_equal': ('SELECT event_id, ts = "2024-01-01T00:00:07" AS a, ts != "2024-01-01T00:00:07" AS b, "2024-01-02" >= ts AS c, ts <= "2024-01-01T00:03:52" AS d FROM events', "SELECT event_id, date_trunc('second', ts) = TIMESTAMP '2024-01-01 00:00:07' AS a, date_trunc('second', ts) <> TIMESTAMP '2024-01-01 00:00:07' AS b, date_trunc('second', ts) <= TIMESTAMP '2024-01-02' AS c, date_trunc('second', ts) <= TIMESTAMP '2024-01-01 00:03:52' AS d FROM events"),
    'time_math': ('SELECT o_orderkey FROM orders WHERE o_orderdate < "now-3y" AND o_orderdate < "now+2d"', 'SELECT o_orderkey FROM orders WHERE o_orderdate < now()::TIMESTAMP - INTERVAL 3 YEAR'),
    'join_or': ('SELECT a.n_nationkey AS x, b.n_nationkey AS y FROM nation a INNER JOIN nation b ON a.n_nationkey = b.n_regionkey OR a.n_name = b.n_name', None),
    'join_left_semi_text_key': ('SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT cast(c_custkey AS string) FROM customer WHERE c_nationkey = 3)', 'SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)'),
    'not_in_subquery': ('SELECT c_custkey FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)', None),
    'in_subquery_under_or': ('SELECT c_custkey FROM customer WHERE c_acctbal > 9000 OR NOT c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 4)', None),
    'agg_float': ('SELECT l_returnflag, toint(sum(l_extendedprice) * 100 + 0.5) AS cents, toint(avg(l_discount) * 1000000) AS a, toint(sum(l_extendedprice * l_discount) * 10000 + 0.5) AS d FROM lineitem GROUP BY l_returnflag', 'SELECT l_returnflag, floor(sum(l_extendedprice) * 100 + 0.5)::BIGINT AS cents, floor(avg(l_discount) * 1000000)::BIGINT AS a, floor(sum(l_extendedprice * l_discount) * 10000 + 0.5)::BIGINT AS d FROM lineitem GROUP BY l_returnflag'),
    'agg_sum_strings': ('SELECT n_regionkey, sum(s) AS t FROM (SELECT n_regionkey, cast(n_nationkey AS string) AS s FROM nation) AS n GROUP BY n_regionkey', 'SELECT n_regionkey, sum(n_nationkey)::DOUBLE AS t FROM nation GROUP BY n_regionkey'),
    'agg_empty': ('SELECT count(*) AS n, sum(o_totalprice) AS s, avg(o_totalprice) AS a FROM orders WHERE o_orderkey < 0', None),
    'agg_null_values': ('SELECT count(v) AS n, count(*) AS m, toint(avg(v) * 1000) AS a, min(et) AS x, count(DISTINCT et) AS d FROM (SELECT event_id, event_type AS et IF value > 9, value AS v IF event_type != "click" FROM events) AS e', "SELECT count(v) AS n, count(*) AS m, floor(avg(v) * 1000)::BIGINT AS a, min(et) AS x, count(DISTINCT et) AS d FROM (SELECT event_id, CASE WHEN value > 9 THEN event_type END AS et, CASE WHEN event_type <> 'click' THEN value END AS v FROM events) AS e"),
    'fn_compare': ('SELECT p_partkey, ge(p_size, 9) AS a, lt(p_size, "9") AS b, all(p_name, p_size > 9) AS c FROM part', 'SELECT p_partkey, p_size >= 9 AS a, p_size < 9 AS b, p_size > 9 AS c FROM part'),
    'fn_unsign': ('SELECT p_partkey, unsign(p_size) AS a, unsign(0 - p_partkey - 1) AS b FROM part', 'SELECT p_partkey, p_size::VARCHAR AS a, (18446744073709551615::HUGEINT - p_partkey)::VARCHAR AS b FROM part'),
    'fn_text_case': ('SELECT p_partkey, string.lowercase(p_brand) AS a, string.titlecase(p_name) AS b, join(string.split(p_name, " "), "-") AS c, string.strip(join(" ", p_name, " ")) AS d FROM part', "SELECT p_partkey, lower(p_brand) AS a, array_to_string(list_transform(string_split(p_name, ' '), lambda x: upper(x[1]) || x[2:]), ' ') AS b, replace(p_name, ' ', '-') AS c, p_name AS d FROM part"),
    'fn_maptime': ('SELECT o_orderkey, array.index(mapkeys(maptime(o_orderstatus, o_orderdate)), 0) AS k, array.index(mapkeys(mapinvert(map(o_orderstatus, o_orderpriority))), 0) AS i FROM orders', 'SELECT o_orderkey, lower(o_orderstatus) AS k, o_orderpriority AS i FROM orders'),
    'fn_match': ('SELECT n_nationkey, array.index(mapvalues(filter(match("n_"), "regionkey", "nationkey")), 0) AS name FROM nation', 'SELECT n_nationkey, n_name AS name FROM nation'),
    'fn_filter_list': ('SELECT p_partkey, join(filtermatch(split(p_name, " "), "r*"), "-") AS a, join(filter(split(p_name, " "), "r*"), "-") AS b, len(filter(split(p_name, " "), "r*")) AS c FROM part', "SELECT p_partkey, nullif(array_to_string(list_filter(string_split(p_name, ' '), lambda x: starts_with(x, 'r')), '-'), '') AS a, nullif(array_to_string(list_filter(string_split(p_name, ' '), lambda x: NOT starts_with(x, 'r')), '-'), '') AS b, nullif(len(list_filter(string_split(p_name, ' '), lambda x: NOT starts_with(x, 'r'))), 0)::BIGINT AS c FROM part"),
    'fn_now': ('SELECT n_nationkey, now() > "2020-01-01" AS a, len(uuid()) AS b FROM nation', 'SELECT n_nationkey, true AS a, 36::BIGINT AS b FROM nation'),
    'fn_month': ('SELECT o_orderkey, monthofyear(o_orderdate) AS m, extract(o_orderdate, "%Y-%m-%d") AS d, todatein("2009-05-08 17:57:51", "America/Los_Angeles") AS z FROM orders', "SELECT o_orderkey, month(o_orderdate) AS m, strftime(o_orderdate, '%Y-%m-%d') AS d, TIMESTAMP '2009-05-09 00:57:51' AS z FROM orders"),
    'fn_seconds': ('SELECT p_partkey, seconds(join("M", cast(p_size AS string), ":30", "")) AS a, seconds(cast(p_size AS string)) AS b, seconds(p_size) AS c FROM part', 'SELECT p_partkey, (p_size * 60 + 30)::DOUBLE AS a, p_size::DOUBLE AS b, p_size::DOUBLE AS c FROM part'),
    'fn_hosts': ('SELECT page_id, join(hosts(url, "www.Golang.org/x"), " ") AS h, join(domains(url), " ") AS d, len(hosts("a")) AS n FROM pages', "SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)) || ' www.golang.org' AS h, array_to_string(list_slice(string_split(lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)), '.'), -2, -1), '.') AS d, NULL::BIGINT AS n FROM pages"),
    'fn_query_string': ('SELECT page_id, qs(url, "page") AS a, qsl(url, "PAGE") AS b, qs2(url, "Page") AS c, urldecode("a%20b+c") AS d FROM pages', "SELECT page_id, nullif(regexp_extract(regexp_replace(lower(url), '#.*$', ''), '[?&]page=([^&]*)', 1), '') AS a, nullif(regexp_extract(regexp_replace(lower(url), '#.*$', ''), '[?&]page=([^&]*)', 1), '') AS b, NULL::VARCHAR AS c, 'a b c' AS d FROM pages"),
    'fn_query_rewrite': ('SELECT page_id, urlminusqs("http://A.com/x?b=2&a=1", "b") AS a, url.matchqs("http://www.google.com/blog?mc_eid=123&mc_id=1&pid=123", "mc_*") AS b, url.matchqs(join("http://h.com/", cast(page_id AS string), "?x=1", "")) AS c FROM pages', "SELECT page_id, 'http://A.com/x?a=1' AS a, 'www.google.com/blog?mc_eid=123&mc_id=1' AS b, 'h.com/' || page_id AS c FROM pages"),
    'fn_email': ('SELECT c_custkey, email(join(c_name, " <User@Site.com>", "")) AS a, emailname(join(c_mktsegment, " <u@s.com>", "")) AS b, emaildomain(join(cast(c_custkey AS string), "@S.org", "")) AS c, email(c_name) AS d FROM customer', "SELECT c_custkey, 'user@site.com' AS a, c_mktsegment AS b, 's.org' AS c, NULL::VARCHAR AS d FROM customer"),
    'fn_user_agent': ('SELECT n_nationkey, useragent("Mozilla/5.0 (X11; Linux x86_64) AppleWebKit/537.11 (KHTML, like Gecko) Chrome/23.0.1271.97 Safari/537.11", "browser") AS a, useragent("Mozilla/5.0 (X11; Linux x86_64) AppleWebKit/537.11 (KHTML, like Gecko) Chrome/23.0.1271.97 Safari/537.11", "os") AS b, len(useragent.map("Mozilla/5.0 (X11; Linux x86_64)")) AS c FROM nation', "SELECT n_nationkey, 'Chrome' AS a, 'Linux x86_64' AS b, 9::BIGINT AS c FROM nation"),
    'fn_sha512': ('SELECT c_custkey, len(hash.sha512(c_name)) AS a, hash.md5(string.substr(c_name, 0, 3)) AS b FROM customer', 'SELECT c_custkey, 128::BIGINT AS a, md5(c_name[1:3]) AS b FROM customer'),
    'fn_json_expression': ('SELECT event_id, toint(json.jmespath(props, "k")) AS a, json.jmespath(props, "nope.k") AS b FROM events', "SELECT event_id, json_extract(props, '$.k')::BIGINT AS a, NULL::VARCHAR AS b FROM events"),
    'fn_hash_known': ('SELECT n_nationkey, hash.sip("http://www.google.com?q=123") AS h, unsign(hash.sip("bananas234029348")) AS u FROM nation', "SELECT n_nationkey, 5673948842516703987::BIGINT AS h, '9314974731269371589' AS u FROM nation"),
    'tpch_q6': ('SELECT toint(sum(l_extendedprice * l_discount) * 10000 + 0.5) AS revenue FROM lineitem WHERE l_shipdate >= "1996-01-01" AND l_shipdate < "1997-01-01" AND l_quantity < 24 AND l_discount > 0.03', "SELECT floor(sum(l_extendedprice * l_discount) * 10000 + 0.5)::BIGINT AS revenue FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1997-01-01' AND l_quantity < 24 AND l_discount > 0.03"),
}


def _query(text: str) -> Callable[[SparkSession, str], DataFrame]:
    named = tuple(t for t in TABLES if t in text)
    return lambda spark, sf_dir: engine_over(spark, sf_dir, named).sql(text)


def filter_include(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine_over(spark, sf_dir, ("events",))
    e.define_filter('FILTER event_type IN ("click", "error") ALIAS loud').define_filter("FILTER AND ( value > 5, INCLUDE loud ) ALIAS busy")
    return e.sql("SELECT event_id FROM events FILTER AND ( INCLUDE busy, NOT event_id < 100 )")


def matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine_over(spark, sf_dir, ("events",))
    df = e.table("events")
    return df.select("event_id", e.matches(df, 'AND ( value > 50, event_type != "click" )').alias("hit"))


def parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = engine_over(spark, sf_dir, ("orders",))
    e.sql("PREPARE big FROM 'SELECT o_orderkey FROM orders WHERE o_totalprice > ? AND o_orderstatus = ?'")
    return e.execute("big", 1000.5, "O")


def session_variables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine_over(spark, sf_dir, ("nation",)).sql("SET @least = 3; SELECT n_nationkey, @least AS least FROM nation WHERE n_regionkey >= @least")


def _own_nation(spark: SparkSession, sf_dir: str) -> Engine:
    e = engine_over(spark, sf_dir, ("nation",))
    e.save("mine", e.table("nation"), "n_nationkey")
    return e


def dml_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _own_nation(spark, sf_dir)
    return e.sql('INSERT INTO mine (n_nationkey, n_name) VALUES (90, "X"), (91, "Y"); INSERT INTO mine SELECT n_nationkey + 100, n_name, n_regionkey FROM nation WHERE n_regionkey = 1; SELECT * FROM mine')


def dml_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _own_nation(spark, sf_dir).sql('UPSERT INTO mine (n_nationkey, n_name) VALUES (3, "NEW"), (77, "ALSO"); SELECT * FROM mine')


def dml_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _own_nation(spark, sf_dir).sql('UPDATE mine SET n_name = tolower(n_name), n_regionkey = n_regionkey + 10 WHERE n_nationkey > 20; SELECT * FROM mine')


def dml_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _own_nation(spark, sf_dir).sql("DELETE FROM mine WHERE n_regionkey = 2; SELECT * FROM mine")


def dml_insert_same_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last row of the statement stays, whatever the order of files."""
    values = ", ".join(f'({k % 40}, "r{k}", {k})' for k in range(200))
    return _own_nation(spark, sf_dir).sql(f"INSERT INTO mine (n_nationkey, n_name, n_regionkey) VALUES {values}; SELECT * FROM mine")


def dml_insert_select_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of one key: the last in the query's order stays."""
    return _own_nation(spark, sf_dir).sql("INSERT INTO mine SELECT n_nationkey % 7 AS n_nationkey, n_name, n_regionkey FROM nation ORDER BY n_name; SELECT * FROM mine")


def _written(spark: SparkSession, sf_dir: str, kind: str) -> str:
    """A folder of tables in files of the format, in the warehouse."""
    folder = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/siftql-files/{uuid.uuid4().hex}"
    for name in ("nation", "orders"):
        df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        out = df.write.option("header", "true") if kind == "csv" else df.write
        out.option("compression", "gzip").format(kind).save(f"{folder}/tables/{name}")
    return folder


def source_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zipped CSV files of a folder; every column is text and compared by the language's rules."""
    e = Engine(spark).register_folder(_written(spark, sf_dir, "csv"), "csv")
    return e.sql("SELECT toint(o_orderkey) AS k, o_orderstatus FROM orders WHERE o_totalprice > 300000")


def source_csv_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = Engine(spark).register_folder(_written(spark, sf_dir, "csv"), "csv", typed=True)
    return e.sql("SELECT o_orderstatus, count(*) AS n, max(o_totalprice) AS top, max(o_orderdate) AS last FROM orders GROUP BY o_orderstatus")


def source_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = Engine(spark).register_folder(_written(spark, sf_dir, "json"), "json")
    return e.sql("SELECT n.n_name, count(*) AS n FROM nation n INNER JOIN orders o ON n.n_nationkey = o.o_custkey GROUP BY n.n_name")


def source_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of a folder's files."""
    e = Engine(spark).register_folder(_written(spark, sf_dir, "json"), "json")
    return e.sql("SELECT table, count(*) > 0 AS there, min(size) > 0 AS filled FROM main_files GROUP BY table")


def source_path_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _written(spark, sf_dir, "json")
    df = readers.with_path_columns(spark.read.json(f"{folder}/tables/nation"), r"/tables/(?P<kind>\w+)/")
    return Engine(spark).register("n", df).sql("SELECT n_nationkey, kind FROM n")


def stream_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A SELECT over a stream that has read all there is."""
    table = spark.read.parquet(f"{sf_dir}/events.parquet")
    stream = spark.readStream.schema(table.schema).parquet(f"{sf_dir}/events.parquet*")
    return _drained(spark, select_stream(Engine(spark), stream, "SELECT event_id, value * 2 AS twice FROM events WHERE event_type = \"click\""), "append")


def stream_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tumbling windows of event time over a stream that has read all there is."""
    table = spark.read.parquet(f"{sf_dir}/events.parquet")
    stream = spark.readStream.schema(table.schema).parquet(f"{sf_dir}/events.parquet*")
    made = windowed(stream, "ts", "1 day", {"n": "count(*)", "top": "max(value)"}, keys=("event_type",))
    return _drained(spark, made, "complete").withColumnsRenamed({"start": "day"}).drop("end")


def _drained(spark: SparkSession, df: DataFrame, mode: str) -> DataFrame:
    base = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/siftql-streams/{uuid.uuid4().hex}"

    def keep(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{base}/rows")

    df.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
    return spark.read.parquet(f"{base}/rows")


def select_into(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine_over(spark, sf_dir, ("nation",)).sql("SELECT n_name, n_regionkey INTO kept FROM nation WHERE n_regionkey < 2; SELECT n_name FROM kept")


def show_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine_over(spark, sf_dir).sql('SHOW TABLES LIKE "%e%"')


def describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine_over(spark, sf_dir, ("nation",)).sql("DESCRIBE nation").select("Field", "Type")


def hash_sip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine_over(spark, sf_dir, ("nation",)).sql("SELECT n_nationkey, hash.sip(n_name) AS h FROM nation")


_FUNCTIONS = (filter_include, matches, parameters, session_variables, dml_insert, dml_insert_same_key, dml_insert_select_key, source_csv, source_csv_typed, source_json, source_files, source_path_columns, stream_select, stream_window, dml_upsert, dml_update, dml_delete, select_into, show_tables, describe, hash_sip)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: _query(v[0]) for k, v in TEXTS.items()} | {f.__name__: f for f in _FUNCTIONS}
ORACLE_SQL: dict[str, str] = {k: v[1] or v[0] for k, v in TEXTS.items()} | {
    "filter_include": "SELECT event_id FROM events WHERE value > 5 AND event_type IN ('click', 'error') AND NOT event_id < 100",
    "matches": "SELECT event_id, value > 50 AND event_type <> 'click' AS hit FROM events",
    "parameters": "SELECT o_orderkey FROM orders WHERE o_totalprice > 1000.5 AND o_orderstatus = 'O'",
    "session_variables": "SELECT n_nationkey, 3::BIGINT AS least FROM nation WHERE n_regionkey >= 3",
    "dml_insert": "SELECT * FROM nation UNION ALL VALUES (90, 'X', NULL), (91, 'Y', NULL) UNION ALL SELECT n_nationkey + 100, n_name, n_regionkey FROM nation WHERE n_regionkey = 1",
    "dml_insert_same_key": "SELECT * FROM nation WHERE n_nationkey NOT IN (SELECT range FROM range(40)) UNION ALL SELECT k, 'r' || (160 + k), 160 + k FROM (SELECT range AS k FROM range(40))",
    "dml_insert_select_key": "SELECT * FROM nation WHERE n_nationkey > 6 UNION ALL SELECT n_nationkey % 7, arg_max(n_name, n_name), arg_max(n_regionkey, n_name) FROM nation GROUP BY n_nationkey % 7",
    "source_csv": "SELECT o_orderkey AS k, o_orderstatus FROM orders WHERE o_totalprice > 300000",
    "source_csv_typed": "SELECT o_orderstatus, count(*) AS n, max(o_totalprice) AS top, max(o_orderdate) AS last FROM orders GROUP BY o_orderstatus",
    "source_json": "SELECT n.n_name, count(*) AS n FROM nation n JOIN orders o ON n.n_nationkey = o.o_custkey GROUP BY n.n_name",
    "source_files": "SELECT * FROM (VALUES ('nation', true, true), ('orders', true, true)) AS t(\"table\", there, filled)",
    "source_path_columns": "SELECT n_nationkey, 'nation' AS kind FROM nation",
    "stream_select": "SELECT event_id, value * 2 AS twice FROM events WHERE event_type = 'click'",
    "stream_window": "SELECT date_trunc('day', ts)::TIMESTAMP AS day, event_type, count(*) AS n, max(value) AS top FROM events GROUP BY 1, 2",
    "dml_upsert": "SELECT n_nationkey, CASE WHEN n_nationkey = 3 THEN 'NEW' ELSE n_name END AS n_name, n_regionkey FROM nation UNION ALL VALUES (77, 'ALSO', NULL)",
    "dml_update": "SELECT n_nationkey, CASE WHEN n_nationkey > 20 THEN lower(n_name) ELSE n_name END AS n_name, CASE WHEN n_nationkey > 20 THEN n_regionkey + 10 ELSE n_regionkey END AS n_regionkey FROM nation",
    "dml_delete": "SELECT * FROM nation WHERE n_regionkey <> 2",
    "select_into": "SELECT n_name FROM nation WHERE n_regionkey < 2",
    "show_tables": "SELECT * FROM (VALUES ('customer'), ('documents'), ('events'), ('lineitem'), ('orders'), ('pages'), ('region'), ('supplier')) AS t(\"Table\") WHERE \"Table\" LIKE '%e%'",
    "describe": "SELECT * FROM (VALUES ('n_nationkey', 'int(4)'), ('n_name', 'varchar(255)'), ('n_regionkey', 'int(4)')) AS t(\"Field\", \"Type\")",
}
