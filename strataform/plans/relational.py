"""Relational queries.  A text alone serves Spark and DuckDB; a pair gives each its own."""

PAIRS: dict[str, str | tuple[str, str]] = {
    # scan, filter, project
    "scan_star": "SELECT * FROM nation",
    "filter_project": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 100000 AND o_orderstatus = 'F'",
    "point_read": "SELECT * FROM customer WHERE c_custkey = 42",
    "range_scan": "SELECT c_custkey, c_name FROM customer WHERE c_custkey >= 100 AND c_custkey <= 140",
    "between": "SELECT p_partkey, p_size FROM part WHERE p_size BETWEEN 5 AND 9",
    "not_between": "SELECT p_partkey FROM part WHERE p_size NOT BETWEEN 5 AND 45",
    "in_list": "SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')",
    "not_in_list": "SELECT c_custkey FROM customer WHERE c_nationkey NOT IN (1, 2, 3)",
    "like": "SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%a%'",
    "not_like": "SELECT p_partkey FROM part WHERE p_brand NOT LIKE 'Brand#1_'",
    "ilike": "SELECT c_custkey FROM customer WHERE c_name ILIKE 'CUSTOMER%1'",
    "is_null": "SELECT c.c_custkey FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 300000 WHERE o.o_orderkey IS NULL",
    "is_not_null": "SELECT count(*) AS n FROM documents WHERE text IS NOT NULL",
    "bool_logic": "SELECT o_orderkey FROM orders WHERE NOT (o_orderstatus = 'F' OR o_totalprice < 50000) AND o_orderkey <> 7",
    "distinct": "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders",
    "scalar_select": "SELECT 1 + 2 AS three, 'a' AS letter, true AS yes",
    "values_relation": "SELECT k, v FROM (VALUES (1, 'a'), (2, 'b'), (3, NULL)) AS t(k, v)",
    "param_query": "SELECT p_partkey FROM part WHERE p_size > 40 AND p_brand = 'Brand#11'",
    # scalars
    "arith_null_safe": ("SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount) + l_tax, 4) AS net, round(try_divide(l_extendedprice, l_linenumber - 1), 4) AS per, try_mod(l_orderkey, CAST(l_linenumber - 1 AS BIGINT)) AS rest, -l_linenumber AS neg FROM lineitem", "SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount) + l_tax, 4) AS net, round(l_extendedprice / nullif(l_linenumber - 1, 0), 4) AS per, l_orderkey % nullif(CAST(l_linenumber - 1 AS BIGINT), 0) AS rest, -l_linenumber AS neg FROM lineitem"),
    "power_concat": "SELECT p_partkey, power(p_size, 2) AS sq, concat(p_brand, '/', p_type) AS label FROM part",
    "floor_div_negative": ("SELECT p_partkey, CAST(floor((p_size - 30) / 7) AS BIGINT) AS q FROM part", "SELECT p_partkey, CAST(floor((p_size - 30) / CAST(7 AS DOUBLE)) AS BIGINT) AS q FROM part"),
    "floor_div": ("SELECT p_partkey, CAST(floor(p_size / 7) AS BIGINT) AS q FROM part", "SELECT p_partkey, CAST(p_size // 7 AS BIGINT) AS q FROM part"),
    "case_searched": "SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE 'large' END AS class FROM part",
    "case_simple": "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 END AS code FROM orders",
    "cast_try": ("SELECT event_id, try_cast(event_type AS BIGINT) AS bad, CAST(event_id AS STRING) AS txt, CAST(value AS BIGINT) * 0 AS z FROM events", "SELECT event_id, try_cast(event_type AS BIGINT) AS bad, CAST(event_id AS VARCHAR) AS txt, CAST(trunc(value) AS BIGINT) * 0 AS z FROM events"),
    "coalesce_op": "SELECT d.doc_id, coalesce(l.quality, -1) AS q FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id",
    "string_fns": "SELECT c_custkey, lower(c_name) AS lo, upper(c_mktsegment) AS up, length(c_name) AS n, trim(concat('  ', c_name, ' ')) AS tr, substring(c_name, 3, 4) AS sub FROM customer",
    "math_fns": "SELECT s_suppkey, abs(s_acctbal) AS a, round(sqrt(abs(s_acctbal)), 6) AS r, round(power(s_acctbal, 2), 2) AS p FROM supplier",
    "strftime_unix": ("SELECT o_orderkey, unix_timestamp(o_orderdate) AS secs, date_format(o_orderdate, \"yyyy-MM-dd'T'HH:mm:ss'Z'\") AS iso FROM orders", "SELECT o_orderkey, CAST(epoch(o_orderdate) AS BIGINT) AS secs, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS iso FROM orders"),
    "array_contains_fn": ("SELECT p_partkey, array_contains(array(1, 2, 3), p_size) AS has FROM part", "SELECT p_partkey, list_contains([1, 2, 3], p_size) AS has FROM part"),
    # joins
    "join_inner": "SELECT o.o_orderkey, c.c_name FROM orders o INNER JOIN customer c ON o.o_custkey = c.c_custkey",
    "join_left": "SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 200000",
    "join_right": "SELECT o.o_orderkey, c.c_custkey FROM orders o RIGHT JOIN customer c ON c.c_custkey = o.o_custkey",
    "join_full": "SELECT s.s_suppkey, c.c_custkey FROM supplier s FULL OUTER JOIN customer c ON s.s_suppkey = c.c_custkey + 5",
    "join_cross": "SELECT r.r_name, n.n_name FROM region r CROSS JOIN nation n",
    "join_comma": "SELECT n.n_name, r.r_name FROM nation n, region r WHERE n.n_regionkey = r.r_regionkey",
    "join_theta_pure": "SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey",
    "join_derived": "SELECT c.c_custkey, o.total FROM customer c JOIN (SELECT o_custkey, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey) o ON o.o_custkey = c.c_custkey",
    # Spark loses the order of a lateral subquery whose sort columns aren't selected, and keeps any rows: its own texts number them.
    "lateral_cross": ("SELECT n.n_nationkey, t.c_custkey FROM nation n JOIN (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC NULLS LAST, c_custkey NULLS LAST) AS r FROM customer) t ON t.c_nationkey = n.n_nationkey AND t.r <= 2", "SELECT n.n_nationkey, t.c_custkey FROM nation n CROSS JOIN LATERAL (SELECT c.c_custkey FROM customer c WHERE c.c_nationkey = n.n_nationkey ORDER BY c.c_acctbal DESC, c.c_custkey LIMIT 2) t"),
    "set_precedence": "SELECT n_nationkey AS k FROM nation WHERE n_nationkey < 4 UNION SELECT n_nationkey FROM nation WHERE n_nationkey > 10 INTERSECT SELECT n_nationkey FROM nation WHERE n_nationkey < 15",
    "star_join": "SELECT * FROM nation JOIN region ON n_regionkey = r_regionkey",
    "join_theta": "SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey AND a.n_regionkey = b.n_regionkey",
    "join_multi": "SELECT c.c_custkey, n.n_name, r.r_name, count(*) AS n_orders FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey GROUP BY c.c_custkey, n.n_name, r.r_name",
    "join_self": "SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey",
    "lateral_inner_limit": ("SELECT c.c_custkey, t.o_orderkey FROM customer c JOIN (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC NULLS LAST, o_orderkey NULLS LAST) AS r FROM orders) t ON t.o_custkey = c.c_custkey AND t.r <= 2", "SELECT c.c_custkey, t.o_orderkey FROM customer c JOIN LATERAL (SELECT o.o_orderkey FROM orders o WHERE o.o_custkey = c.c_custkey ORDER BY o.o_totalprice DESC, o.o_orderkey LIMIT 2) t ON true"),
    "lateral_left": ("SELECT c.c_custkey, t.o_orderkey FROM customer c LEFT JOIN (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice NULLS LAST, o_orderkey NULLS LAST) AS r FROM orders) t ON t.o_custkey = c.c_custkey AND t.r <= 1", "SELECT c.c_custkey, t.o_orderkey FROM customer c LEFT JOIN LATERAL (SELECT o.o_orderkey FROM orders o WHERE o.o_custkey = c.c_custkey ORDER BY o.o_totalprice, o.o_orderkey LIMIT 1) t ON true"),
    "semi_in": "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 150000)",
    "anti_not_in": "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 150000)",
    "semi_exists": "SELECT s_suppkey FROM supplier s WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_suppkey = s.s_suppkey AND l.l_quantity > 49)",
    "anti_not_exists": "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 300000)",
    "scalar_subquery": "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.5 FROM orders)",
    "correlated_scalar": "SELECT c.c_custkey, (SELECT max(o.o_totalprice) FROM orders o WHERE o.o_custkey = c.c_custkey) AS top FROM customer c",
    "derived_table": "SELECT seg, n FROM (SELECT c_mktsegment AS seg, count(*) AS n FROM customer GROUP BY c_mktsegment) t WHERE n > 1",
    # aggregates
    "group_basic": "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(avg(l_extendedprice), 4) AS avg_price, min(l_discount) AS low, max(l_tax) AS high, count(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus",
    "group_having": "SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey HAVING sum(o_totalprice) > 500000",
    "group_distinct_aggs": "SELECT l_returnflag, count(DISTINCT l_suppkey) AS sup, CAST(sum(DISTINCT l_linenumber) AS BIGINT) AS lines, avg(DISTINCT l_linenumber) AS mean FROM lineitem GROUP BY l_returnflag",
    "agg_filter": "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, round(sum(o_totalprice) FILTER (WHERE o_orderstatus = 'O'), 2) AS o FROM orders GROUP BY o_orderpriority",
    "array_agg_distinct": ("SELECT c_mktsegment, array_join(array_sort(collect_set(c_nationkey)), ',') AS nations FROM customer GROUP BY c_mktsegment", "SELECT c_mktsegment, array_to_string(list_sort(array_agg(DISTINCT c_nationkey)), ',') AS nations FROM customer GROUP BY c_mktsegment"),
    "array_agg": ("SELECT n_regionkey, array_join(array_sort(collect_list(n_name)), ',') AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, array_to_string(list_sort(array_agg(n_name)), ',') AS names FROM nation GROUP BY n_regionkey"),
    "string_agg": ("SELECT n_regionkey, listagg(n_name, '; ') WITHIN GROUP (ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, '; ' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey"),
    "global_agg": "SELECT count(*) AS n, round(sum(o_totalprice), 2) AS total, min(o_orderkey) AS lo, max(o_orderkey) AS hi FROM orders",
    "empty_agg": "SELECT count(*) AS n, sum(o_totalprice) AS total, max(o_orderkey) AS hi FROM orders WHERE o_orderkey < 0",
    "first_value_group": ("SELECT o_custkey, min_by(o_orderkey, struct(o_orderdate, o_orderkey)) AS first_order FROM orders GROUP BY o_custkey", "SELECT o_custkey, min_by(o_orderkey, row(o_orderdate, o_orderkey)) AS first_order FROM orders GROUP BY o_custkey"),
    "grouping_sets": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus, o_orderpriority), (o_orderstatus), ())",
    "rollup": "SELECT n.n_regionkey AS r, c.c_mktsegment AS s, count(*) AS n FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey GROUP BY ROLLUP (n.n_regionkey, c.c_mktsegment)",
    "cube": "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS q FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)",
    "stddev_variance": "SELECT l_returnflag, round(stddev_samp(l_quantity), 6) AS sd, round(var_samp(l_quantity), 5) AS va FROM lineitem GROUP BY l_returnflag",
    "pivot": ("SELECT * FROM (SELECT o_orderpriority, o_orderstatus, o_totalprice FROM orders) PIVOT (round(sum(o_totalprice), 2) FOR o_orderstatus IN ('F' AS f, 'O' AS o, 'P' AS p))", "SELECT o_orderpriority, round(sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END), 2) AS f, round(sum(CASE WHEN o_orderstatus = 'O' THEN o_totalprice END), 2) AS o, round(sum(CASE WHEN o_orderstatus = 'P' THEN o_totalprice END), 2) AS p FROM orders GROUP BY o_orderpriority"),
    "unpivot": ("SELECT * FROM (SELECT s_suppkey, CAST(s_nationkey AS DOUBLE) AS nation, s_acctbal AS balance FROM supplier) UNPIVOT INCLUDE NULLS (val FOR name IN (nation, balance))", "SELECT s_suppkey, 'nation' AS name, CAST(s_nationkey AS DOUBLE) AS val FROM supplier UNION ALL SELECT s_suppkey, 'balance', s_acctbal FROM supplier"),
    # windows
    "row_number": "SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS BIGINT) AS rn FROM orders",
    "rank_dense_rank": "SELECT p_partkey, CAST(rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS BIGINT) AS rk, CAST(dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS BIGINT) AS dr FROM part",
    "ntile": "SELECT c_custkey, CAST(ntile(4) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) AS BIGINT) AS q FROM customer",
    "lead_lag_default": "SELECT event_id, lead(event_id, 1, CAST(-1 AS BIGINT)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt, lag(event_id, 2) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prv FROM events",
    "first_last_frame": "SELECT o_orderkey, first_value(o_orderkey) OVER w AS f, last_value(o_orderkey) OVER w AS l FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)",
    "sum_over_rows": "SELECT l_orderkey, l_linenumber, round(sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2) AS run FROM lineitem",
    "sum_over_range": "SELECT p_partkey, CAST(sum(p_size) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN 5 PRECEDING AND CURRENT ROW) AS BIGINT) AS near FROM part",
    # order, sets, CTE
    "topk": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10",
    "limit_offset": "SELECT c_custkey FROM customer ORDER BY c_acctbal, c_custkey LIMIT 10 OFFSET 5",
    "union_all": "SELECT s_nationkey AS k FROM supplier UNION ALL SELECT c_nationkey FROM customer",
    "union_distinct": "SELECT s_nationkey AS k FROM supplier UNION SELECT c_nationkey FROM customer",
    "intersect": "SELECT s_nationkey AS k FROM supplier INTERSECT SELECT c_nationkey FROM customer",
    "intersect_all": "SELECT s_nationkey AS k FROM supplier INTERSECT ALL SELECT c_nationkey FROM customer",
    "except": "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000",
    "except_all": "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier",
    "cte_multi": "WITH big AS (SELECT * FROM orders WHERE o_totalprice > 100000), per AS (SELECT o_custkey, count(*) AS n FROM big GROUP BY o_custkey) SELECT c.c_name, p.n FROM per p JOIN customer c ON c.c_custkey = p.o_custkey",
    "cte_recursive_all": "WITH RECURSIVE t(n) AS (SELECT CAST(1 AS BIGINT) UNION ALL SELECT n + 1 FROM t WHERE n < 50) SELECT n FROM t",
    # JSON
    "json_path": ("SELECT event_id, get_json_object(props, '$.k') AS k FROM events", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events"),
    "tumbling_sql": ("SELECT date_trunc('HOUR', ts) AS hour, event_type, count(*) AS n FROM events GROUP BY date_trunc('HOUR', ts), event_type", "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2"),
    "tpch_q1": "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus",
    "tpch_q5": "SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem, orders, customer, supplier, nation, region WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND l_suppkey = s_suppkey AND c_nationkey = s_nationkey AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey GROUP BY n_name",
    # changes, as the rows they leave
}
