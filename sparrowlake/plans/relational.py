"""Relational operators as declarative plans, by family. Each entry is Spark SQL and, where the dialects differ, the SQL of the oracle.

Sums of doubles go through DECIMAL so that results do not depend on the order of addition.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@dataclass(frozen=True)
class Plan:
    spark: str
    oracle: str

    def __call__(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        register(spark, sf_dir, self.spark)
        return spark.sql(self.spark)


def register(spark: SparkSession, sf_dir: str, sql: str) -> None:
    """Make views of the tables that the statement names."""
    for name in TABLES:
        if re.search(rf"\b{name}\b", sql):
            spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)


PLANS: dict[str, Plan] = {}


def plan(name: str, spark: str, oracle: str | None = None) -> None:
    PLANS[name] = Plan(spark.strip(), (oracle or spark).strip())


def money(x: str) -> str:
    return f"CAST(sum(CAST({x} AS DECIMAL(18,4))) AS DOUBLE)"


# -- scans, projections, filters ------------------------------------------------------------------------------------
plan("scan_all", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
plan("project_cols", "SELECT o_orderkey, o_orderpriority FROM orders")
plan("computed_cols", "SELECT o_orderkey, o_totalprice * 2 AS double_price, -o_orderkey AS neg_key, o_orderkey % 7 AS key_mod, o_orderkey + 1 AS next_key FROM orders")
plan("filter_cmp", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity >= 45 AND l_discount < 0.03 AND 5 <> l_linenumber")
plan("filter_and_or", "SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'F' AND o_totalprice > 200000) OR (o_orderpriority = '1-URGENT' AND o_orderkey < 500)")
plan("filter_not", "SELECT o_orderkey FROM orders WHERE NOT (o_orderstatus = 'F' OR o_totalprice > 100000)")
plan("filter_in", "SELECT p_partkey, p_size FROM part WHERE p_size IN (1, 3, 5, 7, 9, 11, 13, 15, 17, 19, 21, 23)")
plan("filter_not_in", "SELECT n_name FROM nation WHERE n_regionkey NOT IN (0, 2)")
plan(
    "filter_null",
    "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 400000 WHERE o_orderkey IS NULL OR o_orderkey IS NOT NULL AND c_custkey < 100",
)
plan("filter_like_prefix", "SELECT p_partkey, p_type FROM part WHERE p_type LIKE 'S%' AND p_name NOT LIKE 'part-1%'")
plan("filter_ilike", "SELECT c_custkey FROM customer WHERE c_mktsegment ILIKE '%build%'")
plan("filter_between", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity BETWEEN 10 AND 12 AND l_shipdate NOT BETWEEN TIMESTAMP '1996-01-01 00:00:00' AND TIMESTAMP '1999-12-31 00:00:00'".replace("TIMESTAMP '", "TIMESTAMP_NTZ '"), "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity BETWEEN 10 AND 12 AND l_shipdate NOT BETWEEN TIMESTAMP '1996-01-01 00:00:00' AND TIMESTAMP '1999-12-31 00:00:00'")
plan("filter_boolean_column", "SELECT o_orderkey FROM (SELECT o_orderkey, o_totalprice > 250000 AS dear FROM orders) t WHERE dear")
plan("filter_isnan", "SELECT id FROM (VALUES (1, CAST('NaN' AS DOUBLE)), (2, 1.5D), (3, CAST(NULL AS DOUBLE))) t(id, x) WHERE isnan(x)", "SELECT id FROM (VALUES (1, CAST('NaN' AS DOUBLE)), (2, 1.5::DOUBLE), (3, CAST(NULL AS DOUBLE))) t(id, x) WHERE isnan(x)")
plan("filter_null_logic", "SELECT a, b, a = b AS eq, a IS NOT DISTINCT FROM b AS same, a AND b AS both, a OR b AS some, NOT a AS neg FROM (VALUES (true, NULL), (false, NULL), (NULL, NULL), (true, false), (true, true)) t(a, b)")
plan("case_when", "SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE NULL END AS band, CASE o_orderstatus WHEN 'F' THEN 1 ELSE 0 END AS is_f FROM orders")
plan(
    "nested_field",
    "SELECT id, profile.address.street AS street, profile.contact.email AS email FROM (SELECT c_custkey AS id, named_struct('address', named_struct('street', c_name, 'zip', c_nationkey), 'contact', named_struct('email', c_mktsegment)) AS profile FROM customer) t",
    "SELECT id, profile.address.street AS street, profile.contact.email AS email FROM (SELECT c_custkey AS id, {'address': {'street': c_name, 'zip': c_nationkey}, 'contact': {'email': c_mktsegment}} AS profile FROM customer) t",
)
plan("values_rows", "SELECT * FROM (VALUES (1, 'alan'), (2, 'turing'), (3, NULL)) t(foo1, foo2)")
plan("casts", "SELECT o_orderkey, CAST(o_orderkey AS STRING) AS s, CAST(o_totalprice AS DECIMAL(12,1)) AS d, CAST(o_orderdate AS DATE) AS day, CAST('12' AS INT) AS n FROM orders", "SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS s, CAST(o_totalprice AS DECIMAL(12,1)) AS d, CAST(o_orderdate AS DATE) AS day, CAST('12' AS INT) AS n FROM orders")

# -- joins ----------------------------------------------------------------------------------------------------------
plan("join_inner", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
plan("join_star3", f"SELECT p_brand, o_orderstatus, {money('l_extendedprice')} AS total FROM lineitem, orders, part WHERE l_orderkey = o_orderkey AND l_partkey = p_partkey AND p_size < 10 GROUP BY p_brand, o_orderstatus")
plan(
    "join_star5",
    f"""SELECT r_name, s.n_name AS supplier_nation, {money('l_extendedprice * (1 - l_discount)')} AS revenue
FROM lineitem, orders, customer, supplier, nation s, region
WHERE l_orderkey = o_orderkey AND o_custkey = c_custkey AND l_suppkey = s_suppkey AND s_nationkey = s.n_nationkey AND s.n_regionkey = r_regionkey AND c_mktsegment = 'BUILDING'
GROUP BY r_name, s.n_name""",
)
plan("join_broadcast", "SELECT /*+ BROADCAST(nation) */ n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name", "SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
plan("join_shuffle_hash", "SELECT /*+ SHUFFLE_HASH(orders) */ count(*) AS n, sum(l_linenumber) AS s FROM lineitem JOIN orders ON l_orderkey = o_orderkey", "SELECT count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS s FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
plan("join_merge", "SELECT /*+ MERGE(orders) */ o_orderstatus, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_orderstatus", "SELECT o_orderstatus, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_orderstatus")
plan("join_expr_key", "SELECT a.o_orderkey AS k1, b.o_orderkey AS k2 FROM orders a JOIN orders b ON a.o_orderkey = b.o_orderkey - 53 WHERE a.o_orderstatus = 'P'")
plan("join_left", "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'P' GROUP BY c_custkey")
plan("join_right", "SELECT s_suppkey, l_orderkey FROM (SELECT * FROM lineitem WHERE l_quantity > 49) l RIGHT JOIN supplier ON l_suppkey = s_suppkey")
plan("join_full", "SELECT a.k AS ak, b.k AS bk FROM (SELECT p_partkey AS k FROM part WHERE p_size < 10) a FULL JOIN (SELECT p_partkey AS k FROM part WHERE p_size > 5 AND p_size < 15) b ON a.k = b.k")
plan("join_using", "SELECT k, x, y FROM (SELECT n_nationkey AS k, n_name AS x FROM nation) a JOIN (SELECT r_regionkey AS k, r_name AS y FROM region) b USING (k)")
plan("join_natural", "SELECT k, x, y FROM (SELECT n_nationkey AS k, n_name AS x FROM nation) a NATURAL JOIN (SELECT r_regionkey AS k, r_name AS y FROM region) b")
plan("join_semi_exists", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
plan("join_semi_in", "SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 48)")
plan("join_anti", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
plan("not_in", "SELECT s_suppkey FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_quantity > 49.5)")
plan("not_in_null", "SELECT n_nationkey FROM nation WHERE n_nationkey NOT IN (SELECT x FROM (VALUES (1), (NULL)) t(x))")
plan("join_cross", "SELECT a.r_name AS a, b.r_name AS b FROM region a CROSS JOIN region b")
plan("join_theta", "SELECT a.n_nationkey AS x, b.n_nationkey AS y FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey AND a.n_regionkey = b.n_regionkey")
plan("join_range", "SELECT lo, count(*) AS n FROM (VALUES (0, 100), (100, 200), (200, 500)) b(lo, hi) JOIN events ON value >= lo AND value < hi GROUP BY lo")
plan("join_null_safe", "SELECT a.k AS ak, b.k AS bk FROM (VALUES (1), (NULL)) a(k) JOIN (VALUES (1), (NULL)) b(k) ON a.k <=> b.k", "SELECT a.k AS ak, b.k AS bk FROM (VALUES (1), (NULL)) a(k) JOIN (VALUES (1), (NULL)) b(k) ON a.k IS NOT DISTINCT FROM b.k")
plan("lateral_agg", "SELECT n_name, t.n FROM nation, LATERAL (SELECT count(*) AS n FROM customer WHERE c_nationkey = n_nationkey) t")
plan("scalar_subq_corr", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem l WHERE l_quantity > (SELECT 1.8 * avg(l_quantity) FROM lineitem i WHERE i.l_partkey = l.l_partkey)")
plan("scalar_subq", "SELECT o_orderkey FROM orders WHERE o_totalprice = (SELECT max(o_totalprice) FROM orders)")

# -- aggregation ----------------------------------------------------------------------------------------------------
plan("agg_sum_avg_minmax", f"SELECT l_returnflag, l_linestatus, {money('l_quantity')} AS sum_qty, round(avg(l_discount), 6) AS avg_disc, min(l_shipdate) AS first_ship, max(l_extendedprice) AS max_price, count(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus")
plan("agg_global", f"SELECT count(*) AS n, {money('o_totalprice')} AS total, min(o_orderdate) AS lo, max(o_orderdate) AS hi FROM orders")
plan("agg_count_distinct", "SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS supps, CAST(sum(DISTINCT l_linenumber) AS BIGINT) AS lines FROM lineitem GROUP BY l_returnflag")
plan("agg_filter", "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, count(*) FILTER (WHERE o_orderstatus = 'O') AS o FROM orders GROUP BY o_orderpriority")
plan("agg_null_groups", "SELECT k, count(*) AS n, count(v) AS nv, CAST(sum(v) AS BIGINT) AS s FROM (VALUES (1, 2), (1, NULL), (NULL, 4), (NULL, NULL)) t(k, v) GROUP BY k")
plan("having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12")
plan("rollup", f"SELECT o_orderstatus, o_orderpriority, CAST(grouping(o_orderpriority) AS INT) AS g, {money('o_totalprice')} AS total FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
plan("cube", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
plan("grouping_sets", "SELECT l_returnflag, l_linestatus, l_linenumber, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_linenumber), ())")
plan("stats_agg", "SELECT l_returnflag, round(stddev_samp(l_quantity), 6) AS sd, round(var_pop(l_quantity), 6) AS vp, round(corr(l_quantity, l_extendedprice), 6) AS c, round(covar_samp(l_quantity, l_discount), 6) AS cv FROM lineitem GROUP BY l_returnflag")
plan("regr_agg", "SELECT round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 3) AS icept, CAST(regr_count(l_extendedprice, l_quantity) AS BIGINT) AS n, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2 FROM lineitem")
plan("median", "SELECT l_returnflag, median(l_quantity) AS med, percentile_cont(0.25) WITHIN GROUP (ORDER BY l_quantity) AS q1 FROM lineitem GROUP BY l_returnflag")
plan("bool_agg", "SELECT o_custkey, bool_and(o_totalprice > 1000) AS all_big, bool_or(o_orderstatus = 'P') AS any_p FROM orders GROUP BY o_custkey")
plan("bit_agg", "SELECT o_orderstatus, bit_and(o_orderkey) AS a, bit_or(o_orderkey) AS o, bit_xor(o_orderkey) AS x FROM orders GROUP BY o_orderstatus")
plan("pivot_case", f"SELECT o_orderpriority, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN CAST(o_totalprice AS DECIMAL(18,4)) ELSE NULL END) AS DOUBLE) AS f, CAST(sum(CASE WHEN o_orderstatus = 'O' THEN CAST(o_totalprice AS DECIMAL(18,4)) ELSE NULL END) AS DOUBLE) AS o FROM orders GROUP BY o_orderpriority")
plan("pivot_clause", "SELECT * FROM (SELECT o_orderpriority, o_orderstatus, o_orderkey FROM orders) PIVOT (count(o_orderkey) FOR o_orderstatus IN ('F' AS f, 'O' AS o, 'P' AS p))", "SELECT o_orderpriority, nullif(count(*) FILTER (WHERE o_orderstatus = 'F'), 0) AS f, nullif(count(*) FILTER (WHERE o_orderstatus = 'O'), 0) AS o, nullif(count(*) FILTER (WHERE o_orderstatus = 'P'), 0) AS p FROM orders GROUP BY o_orderpriority")
# within four standard errors of the default 5 percent, and within a hundredth of the ranks
plan("approx_distinct", "SELECT abs(approx_count_distinct(l_partkey) - count(DISTINCT l_partkey)) <= 0.2 * count(DISTINCT l_partkey) AS close FROM lineitem", "SELECT true AS close")
plan("approx_percentile", "SELECT l_returnflag, approx_percentile(l_quantity, 0.5, 10000) BETWEEN percentile(l_quantity, 0.49) AND percentile(l_quantity, 0.51) AS close FROM lineitem GROUP BY l_returnflag", "SELECT DISTINCT l_returnflag, true AS close FROM lineitem")
plan("array_agg", "SELECT n_regionkey, array_join(array_sort(array_agg(n_name)), '|') AS names, array_size(array_agg(n_name)) AS n FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, array_to_string(list_sort(array_agg(n_name)), '|') AS names, CAST(len(array_agg(n_name)) AS INT) AS n FROM nation GROUP BY n_regionkey")
plan("string_agg", "SELECT n_regionkey, listagg(n_name, ',') WITHIN GROUP (ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
plan("min_max_by", "SELECT o_orderstatus, max_by(o_orderkey, o_totalprice) AS dearest, min_by(o_orderkey, o_totalprice) AS cheapest FROM orders GROUP BY o_orderstatus", "SELECT o_orderstatus, arg_max(o_orderkey, o_totalprice) AS dearest, arg_min(o_orderkey, o_totalprice) AS cheapest FROM orders GROUP BY o_orderstatus")
plan("agg_first_last_nth", "SELECT o_orderstatus, first_value(o_orderkey) FILTER (WHERE r = 1) AS lo, last_value(o_orderkey) FILTER (WHERE back = 1) AS hi, first_value(o_orderkey) FILTER (WHERE r = 3) AS third FROM (SELECT o_orderstatus, o_orderkey, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS r, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey DESC) AS back FROM orders) t GROUP BY o_orderstatus", "SELECT o_orderstatus, first(o_orderkey) FILTER (WHERE r = 1) AS lo, last(o_orderkey) FILTER (WHERE back = 1) AS hi, first(o_orderkey) FILTER (WHERE r = 3) AS third FROM (SELECT o_orderstatus, o_orderkey, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS r, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey DESC) AS back FROM orders) t GROUP BY o_orderstatus")
plan("distinct_rows", "SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem")
plan("group_by_all_expr", "SELECT year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY year(o_orderdate)", "SELECT CAST(year(o_orderdate) AS INT) AS y, count(*) AS n FROM orders GROUP BY year(o_orderdate)")

# -- windows --------------------------------------------------------------------------------------------------------
plan("win_rank", "SELECT o_orderkey, CAST(row_number() OVER w AS BIGINT) AS rn, CAST(rank() OVER v AS BIGINT) AS rk, CAST(dense_rank() OVER v AS BIGINT) AS dr FROM orders WINDOW w AS (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC, o_orderkey), v AS (PARTITION BY o_orderstatus ORDER BY o_orderpriority)")
plan("win_ntile_dist", "SELECT o_orderkey, CAST(ntile(4) OVER w AS BIGINT) AS q, round(percent_rank() OVER w, 9) AS pr, round(cume_dist() OVER w, 9) AS cd FROM orders WINDOW w AS (PARTITION BY o_orderpriority ORDER BY o_totalprice, o_orderkey)")
plan("win_lag_lead", "SELECT o_orderkey, lag(o_orderkey, 1) OVER w AS prev, lead(o_orderkey, 2, -1) OVER w AS nxt FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)", "SELECT o_orderkey, lag(o_orderkey, 1) OVER w AS prev, lead(o_orderkey, 2, -1::BIGINT) OVER w AS nxt FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
plan("win_first_nth", "SELECT o_orderkey, first_value(o_orderkey) OVER w AS f, last_value(o_orderkey) OVER w AS l, nth_value(o_orderkey, 2) OVER w AS n2 FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)")
plan("win_rows_frame", "SELECT o_orderkey, CAST(sum(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS BIGINT) AS s FROM orders")
plan("win_range_frame", "SELECT event_id, count(*) OVER (PARTITION BY event_type ORDER BY user_id RANGE BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS n FROM events")
plan("win_groups_frame", "SELECT event_id, CAST(count(*) OVER (PARTITION BY event_type ORDER BY g RANGE BETWEEN 1 PRECEDING AND CURRENT ROW) AS BIGINT) AS n FROM (SELECT event_id, event_type, dense_rank() OVER (PARTITION BY event_type ORDER BY user_id) AS g FROM events) t", "SELECT event_id, count(*) OVER (PARTITION BY event_type ORDER BY user_id GROUPS BETWEEN 1 PRECEDING AND CURRENT ROW) AS n FROM events")
plan("win_agg", "SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey) AS n, max(o_totalprice) OVER (PARTITION BY o_custkey) AS m, min(o_orderdate) OVER (PARTITION BY o_custkey) AS d FROM orders")
plan("qualify_rewrite", "SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) t WHERE rn <= 2", "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 2")
plan("distinct_on_rewrite", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders) t WHERE rn = 1", "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey FROM orders ORDER BY o_custkey, o_orderdate, o_orderkey")

# -- sort, limit ----------------------------------------------------------------------------------------------------
plan("order_nulls", "SELECT x FROM (VALUES (3), (NULL), (1)) t(x) ORDER BY x DESC NULLS LAST")
plan("order_multi", "SELECT n_regionkey, n_name FROM nation ORDER BY n_regionkey DESC, n_name ASC NULLS FIRST")
plan("topk", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
plan("limit_offset", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 20 OFFSET 30")

# -- sets and CTEs --------------------------------------------------------------------------------------------------
A, B = "SELECT p_size AS k FROM part WHERE p_size < 30", "SELECT p_size AS k FROM part WHERE p_size > 20"
for name, word in (("union_all", "UNION ALL"), ("union_distinct", "UNION"), ("intersect", "INTERSECT"), ("intersect_all", "INTERSECT ALL"), ("except_q", "EXCEPT"), ("except_all", "EXCEPT ALL")):
    plan(name, f"({A}) {word} ({B})")
plan("cte", "WITH big AS (SELECT * FROM orders WHERE o_totalprice > 300000) SELECT o_orderstatus, count(*) AS n FROM big GROUP BY o_orderstatus")
plan("cte_reused", "WITH c AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) SELECT a.o_custkey AS x, b.o_custkey AS y FROM c a JOIN c b ON a.n = b.n AND a.o_custkey < b.o_custkey WHERE a.n > 15")
plan("recursive_cte", "WITH RECURSIVE t(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM t WHERE n < 20) SELECT n FROM t")

# -- scalar functions -----------------------------------------------------------------------------------------------
plan(
    "fn_string",
    "SELECT c_custkey, concat(c_name, '-', c_mktsegment) AS c1, concat_ws('|', c_name, c_mktsegment) AS c2, lower(c_name) AS lo, upper(c_name) AS up, trim('  x ') AS tr, ltrim('  x') AS lt, rtrim('x  ') AS rt, replace(c_name, '0', 'o') AS rep, repeat('ab', 3) AS rp, split_part(c_name, '#', 2) AS sp, startswith(c_name, 'Cust') AS sw, endswith(c_name, '1') AS ew, contains(c_name, '00') AS ct, ascii(c_name) AS ac, char(65) AS ch, CAST(bit_length(c_name) AS BIGINT) AS bl, CAST(octet_length(c_name) AS BIGINT) AS ol, CAST(levenshtein(c_name, c_mktsegment) AS BIGINT) AS lev FROM customer",
    "SELECT c_custkey, concat(c_name, '-', c_mktsegment) AS c1, concat_ws('|', c_name, c_mktsegment) AS c2, lower(c_name) AS lo, upper(c_name) AS up, trim('  x ') AS tr, ltrim('  x') AS lt, rtrim('x  ') AS rt, replace(c_name, '0', 'o') AS rep, repeat('ab', 3) AS rp, split_part(c_name, '#', 2) AS sp, starts_with(c_name, 'Cust') AS sw, ends_with(c_name, '1') AS ew, contains(c_name, '00') AS ct, ascii(c_name) AS ac, chr(65) AS ch, CAST(bit_length(c_name) AS BIGINT) AS bl, CAST(strlen(c_name) AS BIGINT) AS ol, CAST(levenshtein(c_name, c_mktsegment) AS BIGINT) AS lev FROM customer",
)
plan(
    "fn_unicode",
    "SELECT c_custkey, CAST(length(c_name) AS BIGINT) AS n, left(c_name, 3) AS l, right(c_name, 3) AS r, lpad(c_name, 25, '*') AS lp, rpad(c_name, 25, '*') AS rp, reverse(c_name) AS rev, substr(c_name, 2, 4) AS s, CAST(instr(c_name, '0') AS BIGINT) AS p, translate(c_name, '012', 'abc') AS t, substring_index(c_name, '0', 1) AS si FROM customer",
    "SELECT c_custkey, CAST(length(c_name) AS BIGINT) AS n, left(c_name, 3) AS l, right(c_name, 3) AS r, lpad(c_name, 25, '*') AS lp, rpad(c_name, 25, '*') AS rp, reverse(c_name) AS rev, substr(c_name, 2, 4) AS s, CAST(strpos(c_name, '0') AS BIGINT) AS p, translate(c_name, '012', 'abc') AS t, split_part(c_name, '0', 1) AS si FROM customer",
)
plan("fn_initcap", "SELECT n_nationkey, initcap(lower(n_name)) AS x, CAST(find_in_set('b', 'a,b,c') AS BIGINT) AS f FROM nation", "SELECT n_nationkey, array_to_string(list_transform(string_split(lower(n_name), ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS x, CAST(list_position(string_split('a,b,c', ','), 'b') AS BIGINT) AS f FROM nation")
plan(
    "fn_regex",
    "SELECT c_custkey, c_name RLIKE '[0-9]+1$' AS m, regexp_extract(c_name, '([0-9]+)', 1) AS d, regexp_replace(c_name, '[0-9]', 'x') AS r, CAST(regexp_count(c_name, '0') AS BIGINT) AS n FROM customer",
    "SELECT c_custkey, regexp_matches(c_name, '[0-9]+1$') AS m, regexp_extract(c_name, '([0-9]+)', 1) AS d, regexp_replace(c_name, '[0-9]', 'x', 'g') AS r, CAST(len(regexp_extract_all(c_name, '0')) AS BIGINT) AS n FROM customer",
)
plan(
    "fn_datetime",
    "SELECT event_id, CAST(extract(HOUR FROM ts) AS BIGINT) AS h, CAST(date_part('DAY', ts) AS BIGINT) AS d, CAST(date_trunc('MONTH', ts) AS TIMESTAMP_NTZ) AS m, CAST(ts AS DATE) AS day, make_date(2024, 2, 29) AS md, last_day(CAST(ts AS DATE)) AS ld, ts + INTERVAL 3 HOURS AS later, datediff(CAST(ts AS DATE), DATE '2024-01-01') AS dd, dayofweek(ts) - 1 AS dow, date_format(ts, 'yyyy-MM-dd HH:mm') AS f, CAST(quarter(ts) AS BIGINT) AS q, to_date('2024-03-01') AS td FROM events",
    "SELECT event_id, CAST(extract(HOUR FROM ts) AS BIGINT) AS h, CAST(date_part('day', ts) AS BIGINT) AS d, CAST(date_trunc('month', ts) AS TIMESTAMP) AS m, CAST(ts AS DATE) AS day, make_date(2024, 2, 29) AS md, last_day(CAST(ts AS DATE)) AS ld, ts + INTERVAL 3 HOURS AS later, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INT) AS dd, CAST(dayofweek(ts) AS INT) AS dow, strftime(ts, '%Y-%m-%d %H:%M') AS f, CAST(quarter(ts) AS BIGINT) AS q, DATE '2024-03-01' AS td FROM events",
)
plan(
    "fn_date_bin",
    "SELECT CAST(timestamp_micros((unix_micros(CAST(ts AS TIMESTAMP)) div 900000000) * 900000000) AS TIMESTAMP_NTZ) AS bin, count(*) AS n FROM events GROUP BY 1",
    "SELECT time_bucket(INTERVAL 15 MINUTES, ts, TIMESTAMP '1970-01-01 00:00:00') AS bin, count(*) AS n FROM events GROUP BY 1",
)
plan(
    "fn_math",
    "SELECT l_orderkey, l_linenumber, abs(-l_quantity) AS a, CAST(ceil(l_discount * 10) AS DOUBLE) AS c, CAST(floor(l_tax * 100) AS DOUBLE) AS f, round(l_extendedprice, 1) AS r, round(sqrt(l_quantity), 6) AS sq, round(cbrt(l_quantity), 6) AS cb, power(l_linenumber, 2) AS pw, round(exp(l_discount), 6) AS ex, round(ln(l_quantity), 6) AS ln, round(log2(l_quantity), 6) AS l2, round(log10(l_quantity), 6) AS l10, round(sin(l_quantity) + cos(l_quantity) + tan(l_discount) + atan2(l_tax, l_quantity), 6) AS tg, round(degrees(l_discount), 6) AS dg, round(radians(l_quantity), 6) AS rd, CAST(factorial(l_linenumber) AS BIGINT) AS fa, CAST(signum(l_discount) AS DOUBLE) AS sg, round(pi(), 9) AS pi, l_linenumber % 3 AS m FROM lineitem",
    "SELECT l_orderkey, l_linenumber, abs(-l_quantity) AS a, CAST(ceil(l_discount * 10) AS DOUBLE) AS c, CAST(floor(l_tax * 100) AS DOUBLE) AS f, round(l_extendedprice, 1) AS r, round(sqrt(l_quantity), 6) AS sq, round(cbrt(l_quantity), 6) AS cb, power(l_linenumber, 2) AS pw, round(exp(l_discount), 6) AS ex, round(ln(l_quantity), 6) AS ln, round(log2(l_quantity), 6) AS l2, round(log10(l_quantity), 6) AS l10, round(sin(l_quantity) + cos(l_quantity) + tan(l_discount) + atan2(l_tax, l_quantity), 6) AS tg, round(degrees(l_discount), 6) AS dg, round(radians(l_quantity), 6) AS rd, CAST(factorial(l_linenumber) AS BIGINT) AS fa, CAST(sign(l_discount) AS DOUBLE) AS sg, round(pi(), 9) AS pi, l_linenumber % 3 AS m FROM lineitem",
)
plan(
    "fn_array",
    "SELECT n_nationkey, size(a) AS n, element_at(a, 1) AS e, array_contains(a, 2) AS c, CAST(array_position(a, 2) AS BIGINT) AS p, array_join(array_distinct(concat(a, a)), ',') AS d, array_join(array_remove(a, 1), ',') AS rm, array_join(slice(a, 2, 2), ',') AS sl, array_join(flatten(array(a, array(9))), ',') AS fl, array_join(sort_array(a, false), ',') AS so, array_join(array_append(a, 7), ',') AS ap, array_max(a) AS mx, array_join(sequence(1, 4), ',') AS sq FROM (SELECT n_nationkey, array(1, 2, n_nationkey, n_regionkey) AS a FROM nation) t",
    "SELECT n_nationkey, CAST(len(a) AS INT) AS n, a[1] AS e, list_contains(a, 2) AS c, CAST(coalesce(list_position(a, 2), 0) AS BIGINT) AS p, (SELECT string_agg(x, ',' ORDER BY i) FROM (SELECT x, min(i) AS i FROM (SELECT unnest(a) AS x, generate_subscripts(a, 1) AS i) GROUP BY x)) AS d, array_to_string(list_filter(a, lambda x: x <> 1), ',') AS rm, array_to_string(a[2:3], ',') AS sl, array_to_string(flatten([a, [9]]), ',') AS fl, array_to_string(list_reverse_sort(a), ',') AS so, array_to_string(list_append(a, 7), ',') AS ap, list_max(a) AS mx, array_to_string(range(1, 5), ',') AS sq FROM (SELECT n_nationkey, [1, 2, n_nationkey, n_regionkey] AS a FROM nation) t",
)
plan("fn_unnest", "SELECT n_nationkey, explode(sequence(1, n_regionkey + 1)) AS i FROM nation", "SELECT n_nationkey, CAST(unnest(range(1, n_regionkey + 2)) AS INT) AS i FROM nation")
plan(
    "fn_map_struct",
    "SELECT n_nationkey, array_join(map_keys(m), ',') AS ks, array_join(map_values(m), ',') AS vs, element_at(m, 'a') AS a, named_struct('x', n_name).x AS x FROM (SELECT n_nationkey, n_name, map('a', n_nationkey, 'b', n_regionkey) AS m FROM nation) t",
    "SELECT n_nationkey, array_to_string(map_keys(m), ',') AS ks, array_to_string(map_values(m), ',') AS vs, m['a'] AS a, {'x': n_name}.x AS x FROM (SELECT n_nationkey, n_name, MAP {'a': n_nationkey, 'b': n_regionkey} AS m FROM nation) t",
)
plan("fn_encoding", "SELECT c_custkey, md5(c_name) AS m, sha2(c_name, 256) AS s, base64(CAST(c_name AS BINARY)) AS b, hex(CAST(c_name AS BINARY)) AS h, decode(unbase64(base64(CAST(c_name AS BINARY))), 'UTF-8') AS rt FROM customer", "SELECT c_custkey, md5(c_name) AS m, sha256(c_name) AS s, base64(c_name::BLOB) AS b, hex(c_name::BLOB) AS h, c_name AS rt FROM customer")
plan("fn_conditional", "SELECT n_nationkey, coalesce(nullif(n_regionkey, 0), -1) AS c, nvl(nullif(n_regionkey, 1), 9) AS v, nvl2(nullif(n_regionkey, 2), 'y', 'n') AS v2, greatest(n_nationkey, n_regionkey, 3) AS g, least(n_nationkey, n_regionkey, 3) AS l, n_regionkey IS DISTINCT FROM 2 AS d FROM nation", "SELECT n_nationkey, coalesce(nullif(n_regionkey, 0), -1) AS c, coalesce(nullif(n_regionkey, 1), 9) AS v, CASE WHEN n_regionkey <> 2 THEN 'y' ELSE 'n' END AS v2, greatest(n_nationkey, n_regionkey, 3) AS g, least(n_nationkey, n_regionkey, 3) AS l, n_regionkey IS DISTINCT FROM 2 AS d FROM nation")
plan("fn_json", "SELECT event_id, CAST(get_json_object(props, '$.k') AS INT) AS k FROM events", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events")

# -- benchmark shapes -----------------------------------------------------------------------------------------------
plan(
    "q01_like",
    f"""WITH returns AS (SELECT o_custkey AS cust, c_nationkey AS store, {money('l_extendedprice')} AS total FROM lineitem, orders, customer
  WHERE l_orderkey = o_orderkey AND o_custkey = c_custkey AND l_returnflag = 'R' AND year(o_orderdate) = 1998 GROUP BY o_custkey, c_nationkey)
SELECT c_name FROM returns r1, nation, customer
WHERE r1.total > (SELECT avg(total) * 1.2 FROM returns r2 WHERE r1.store = r2.store) AND n_nationkey = r1.store AND n_regionkey = 1 AND r1.cust = c_custkey
ORDER BY c_name LIMIT 100""",
)
plan(
    "q02_like",
    """WITH sales AS (SELECT l_shipdate AS d, CAST(l_extendedprice AS DECIMAL(18,4)) AS price FROM lineitem WHERE l_linestatus = 'O' UNION ALL SELECT l_shipdate AS d, CAST(l_extendedprice AS DECIMAL(18,4)) AS price FROM lineitem WHERE l_linestatus = 'F'),
weekly AS (SELECT CAST(datediff(CAST(d AS DATE), DATE '1995-01-01') AS BIGINT) div 7 AS wk, year(d) AS y, sum(CASE WHEN dayofweek(d) = 1 THEN price ELSE NULL END) AS sun, sum(CASE WHEN dayofweek(d) = 2 THEN price ELSE NULL END) AS mon FROM sales GROUP BY 1, 2)
SELECT a.wk AS wk, round(CAST(a.sun AS DOUBLE) / CAST(b.sun AS DOUBLE), 2) AS sun_ratio, round(CAST(a.mon AS DOUBLE) / CAST(b.mon AS DOUBLE), 2) AS mon_ratio
FROM (SELECT * FROM weekly WHERE y = 1997) a, (SELECT * FROM weekly WHERE y = 1998) b WHERE a.wk = b.wk - 53 ORDER BY wk""",
    """WITH sales AS (SELECT l_shipdate AS d, CAST(l_extendedprice AS DECIMAL(18,4)) AS price FROM lineitem WHERE l_linestatus = 'O' UNION ALL SELECT l_shipdate AS d, CAST(l_extendedprice AS DECIMAL(18,4)) AS price FROM lineitem WHERE l_linestatus = 'F'),
weekly AS (SELECT CAST(date_diff('day', DATE '1995-01-01', CAST(d AS DATE)) AS BIGINT) // 7 AS wk, year(d) AS y, sum(CASE WHEN dayofweek(d) = 0 THEN price ELSE NULL END) AS sun, sum(CASE WHEN dayofweek(d) = 1 THEN price ELSE NULL END) AS mon FROM sales GROUP BY 1, 2)
SELECT a.wk AS wk, round(CAST(a.sun AS DOUBLE) / CAST(b.sun AS DOUBLE), 2) AS sun_ratio, round(CAST(a.mon AS DOUBLE) / CAST(b.mon AS DOUBLE), 2) AS mon_ratio
FROM (SELECT * FROM weekly WHERE y = 1997) a, (SELECT * FROM weekly WHERE y = 1998) b WHERE a.wk = b.wk - 53 ORDER BY wk""",
)
_Q3 = """SELECT CAST(year(o_orderdate) AS INT) AS o_year, p_brand AS brand, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,4))) AS DOUBLE) AS sum_agg
FROM orders, lineitem, part
WHERE o_orderkey = l_orderkey AND l_partkey = p_partkey AND p_size = 15 AND month(o_orderdate) = 11
GROUP BY year(o_orderdate), p_brand ORDER BY o_year, sum_agg DESC, brand LIMIT 100"""
plan("q03_like", _Q3)
plan(
    "q07_like",
    f"""SELECT p_type, round(avg(l_quantity), 4) AS agg1, round(avg(l_extendedprice), 2) AS agg2, round(avg(l_discount), 6) AS agg3, round(avg(l_tax), 6) AS agg4
FROM lineitem, orders, customer, part, supplier
WHERE l_orderkey = o_orderkey AND o_custkey = c_custkey AND l_partkey = p_partkey AND l_suppkey = s_suppkey AND c_mktsegment = 'MACHINERY' AND (o_orderpriority = '2-HIGH' OR o_orderpriority = '1-URGENT') AND year(o_orderdate) = 1998
GROUP BY p_type ORDER BY p_type LIMIT 100""",
)

FLAGSHIP = "q03_like"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(PLANS)


def oracle_sql() -> dict[str, str]:
    return {k: p.oracle for k, p in PLANS.items()}
