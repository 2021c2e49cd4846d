"""The relational families: the same text in Spark SQL and DuckDB where the dialects
agree, else one text for each. Views carry the tables' names with a private prefix."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import sqlgate

TABLES = "region nation customer supplier part orders lineitem events embeddings".split()

#: Exact money sums: doubles become decimals before they are added.
MONEY = "CAST(SUM(CAST({0} AS DECIMAL(18,2))) AS DOUBLE)"

#: Name: text for both, or (Spark text, DuckDB text). ``{table}`` names a table.
TEXTS: dict[str, str | tuple[str, str]] = {
    "proj_case": "SELECT o_orderkey, o_totalprice * 2 AS twice, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS band, CAST(o_orderkey AS VARCHAR(20)) AS key_text FROM {orders}",
    "filter_between_in_like": "SELECT p_partkey, p_brand, p_size FROM {part} WHERE p_size BETWEEN 5 AND 15 AND p_brand IN ('Brand#11', 'Brand#12', 'Brand#23', 'Brand#34') AND p_name LIKE '%a%' AND p_type ILIKE '%e%' AND p_retailprice IS NOT NULL",
    "join_inner": "SELECT c.c_custkey, o.o_orderkey, o.o_totalprice FROM {customer} c JOIN {orders} o ON c.c_custkey = o.o_custkey WHERE c.c_mktsegment = 'BUILDING'",
    "join_left": "SELECT c.c_custkey, COUNT(o.o_orderkey) AS n FROM {customer} c LEFT JOIN {orders} o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 300000 GROUP BY c.c_custkey",
    "join_right": "SELECT n.n_name, s.s_suppkey FROM {supplier} s RIGHT JOIN {nation} n ON s.s_nationkey = n.n_nationkey AND s.s_acctbal > 0",
    "join_full": "SELECT c.c_custkey, o.o_orderkey, o.o_totalprice FROM {customer} c FULL JOIN {orders} o ON c.c_custkey = o.o_custkey AND c.c_acctbal > 0",
    "join_semi": "SELECT c_custkey, c_name FROM {customer} c WHERE EXISTS (SELECT 1 FROM {orders} o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 250000)",
    "join_anti": "SELECT c_custkey, c_name FROM {customer} c WHERE NOT EXISTS (SELECT 1 FROM {orders} o WHERE o.o_custkey = c.c_custkey)",
    "join_theta": "SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM {nation} a JOIN {nation} b ON a.n_nationkey < b.n_nationkey AND a.n_regionkey <> b.n_regionkey",
    "join_cross": "SELECT r.r_name, n.n_name FROM {region} r CROSS JOIN {nation} n",
    "join_using": "SELECT n_regionkey, n_name, total FROM {nation} JOIN (SELECT n_regionkey, COUNT(*) AS total FROM {nation} GROUP BY n_regionkey) t USING (n_regionkey)",
    "join_sort_merge": ("SELECT /*+ MERGE(o, l) */ o.o_orderkey, l.l_linenumber FROM {orders} o JOIN {lineitem} l ON o.o_orderkey = l.l_orderkey WHERE l.l_quantity > 45", "SELECT o.o_orderkey, l.l_linenumber FROM {orders} o JOIN {lineitem} l ON o.o_orderkey = l.l_orderkey WHERE l.l_quantity > 45"),
    "join_lateral": "SELECT r.r_name, t.n FROM {region} r, LATERAL (SELECT COUNT(*) AS n FROM {nation} n WHERE n.n_regionkey = r.r_regionkey) t",
    "agg_q1": f"SELECT l_returnflag, l_linestatus, {MONEY.format('l_quantity')} AS sum_qty, {MONEY.format('l_extendedprice')} AS sum_price, ROUND(AVG(l_discount), 6) AS avg_disc, COUNT(*) AS n FROM {{lineitem}} WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus",
    "agg_distinct": "SELECT o_orderpriority, COUNT(DISTINCT o_custkey) AS customers, COUNT(DISTINCT o_orderstatus) AS statuses FROM {orders} GROUP BY o_orderpriority",
    "distinct_rows": "SELECT DISTINCT c_mktsegment, c_nationkey FROM {customer}",
    "agg_having_filter": "SELECT o_custkey, COUNT(*) AS n, COUNT(*) FILTER (WHERE o_totalprice > 150000) AS high FROM {orders} GROUP BY o_custkey HAVING COUNT(*) > 12",
    "agg_cube": "SELECT l_returnflag, l_linestatus, COUNT(*) AS n, CAST(GROUPING(l_returnflag) AS BIGINT) AS g FROM {lineitem} GROUP BY CUBE (l_returnflag, l_linestatus)",
    "agg_rollup": "SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n FROM {orders} GROUP BY ROLLUP (o_orderstatus, o_orderpriority)",
    "agg_grouping_sets": "SELECT p_brand, p_size, COUNT(*) AS n FROM {part} GROUP BY GROUPING SETS ((p_brand), (p_size), ())",
    "agg_stats": "SELECT c_mktsegment, ROUND(STDDEV_SAMP(c_acctbal), 4) AS s, ROUND(VAR_POP(c_acctbal), 2) AS v, ROUND(CORR(c_acctbal, c_custkey), 8) AS r, ROUND(COVAR_POP(c_acctbal, c_custkey), 2) AS c, ROUND(MEDIAN(c_acctbal), 4) AS m, ROUND(REGR_SLOPE(c_acctbal, c_custkey), 8) AS slope FROM {customer} GROUP BY c_mktsegment",
    "agg_percentile": "SELECT o_orderstatus, ROUND(PERCENTILE_CONT(0.9) WITHIN GROUP (ORDER BY o_totalprice), 4) AS p90 FROM {orders} GROUP BY o_orderstatus",
    "agg_approx": ("SELECT ABS(approx_count_distinct(o_custkey) - COUNT(DISTINCT o_custkey)) < 0.2 * COUNT(DISTINCT o_custkey) AS near, ABS(approx_percentile(o_totalprice, 0.5) - MEDIAN(o_totalprice)) < 0.05 * MEDIAN(o_totalprice) AS near_median FROM {orders}", "SELECT ABS(approx_count_distinct(o_custkey) - COUNT(DISTINCT o_custkey)) < 0.2 * COUNT(DISTINCT o_custkey) AS near, ABS(approx_quantile(o_totalprice, 0.5) - MEDIAN(o_totalprice)) < 0.05 * MEDIAN(o_totalprice) AS near_median FROM {orders}"),
    "agg_bool_bit": "SELECT p_brand, BOOL_AND(p_size > 0) AS all_big, BOOL_OR(p_size > 49) AS any_big, BIT_AND(p_size) AS band, BIT_OR(p_size) AS bor, BIT_XOR(p_size) AS bxor FROM {part} GROUP BY p_brand",
    "agg_collect": ("SELECT n_regionkey, array_join(sort_array(array_agg(n_name)), ',') AS names, listagg(n_name, '|') WITHIN GROUP (ORDER BY n_name) AS listed, min(n_name) AS first_name FROM {nation} GROUP BY n_regionkey", "SELECT n_regionkey, array_to_string(list_sort(array_agg(n_name)), ',') AS names, string_agg(n_name, '|' ORDER BY n_name) AS listed, min(n_name) AS first_name FROM {nation} GROUP BY n_regionkey"),
    "win_rank": "SELECT o_orderkey, RANK() OVER (PARTITION BY o_orderstatus ORDER BY o_orderpriority) AS r, DENSE_RANK() OVER (PARTITION BY o_orderstatus ORDER BY o_orderpriority) AS d, ROW_NUMBER() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC, o_orderkey) AS n, ROUND(PERCENT_RANK() OVER (PARTITION BY o_orderstatus ORDER BY o_orderpriority), 8) AS p, ROUND(CUME_DIST() OVER (PARTITION BY o_orderstatus ORDER BY o_orderpriority), 8) AS c FROM {orders}",
    "win_lag_lead": "SELECT o_orderkey, LAG(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS before, LEAD(o_totalprice, 2, 0.0) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS after, FIRST_VALUE(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS f, NTH_VALUE(o_orderkey, 2) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS second FROM {orders}",
    "win_rows_frame": "SELECT event_id, MAX(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS m, COUNT(*) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n FROM {events}",
    "win_range_frame": "SELECT l_orderkey, l_linenumber, COUNT(*) OVER (PARTITION BY l_suppkey ORDER BY l_quantity RANGE BETWEEN 2.0 PRECEDING AND 2.0 FOLLOWING) AS near FROM {lineitem}",
    "win_groups_rewrite": ("SELECT event_id, SUM(c) OVER (PARTITION BY user_id ORDER BY day_no RANGE BETWEEN 1 PRECEDING AND CURRENT ROW) AS n FROM (SELECT event_id, user_id, DENSE_RANK() OVER (PARTITION BY user_id ORDER BY event_type) AS day_no, 1 AS c FROM {events})", "SELECT event_id, CAST(COUNT(*) OVER (PARTITION BY user_id ORDER BY event_type GROUPS BETWEEN 1 PRECEDING AND CURRENT ROW) AS BIGINT) AS n FROM {events}"),
    "win_ntile": "SELECT s_suppkey, NTILE(7) OVER (ORDER BY s_acctbal, s_suppkey) AS t FROM {supplier}",
    "qualify_rewrite": ("SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM {orders}) WHERE n = 1", "SELECT o_custkey, o_orderkey FROM {orders} QUALIFY ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1"),
    "qualify": "SELECT o_custkey, o_orderkey FROM {orders} QUALIFY ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1",
    "qualify_alias": "SELECT o_custkey, o_orderkey, RANK() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC, o_orderkey) AS place FROM {orders} WHERE o_totalprice > 1000 QUALIFY place <= 20 ORDER BY o_totalprice DESC, 2 LIMIT 50",
    "qualify_groups": "SELECT c.c_nationkey, COUNT(*) AS n FROM {customer} c JOIN {orders} o ON c.c_custkey = o.o_custkey GROUP BY c.c_nationkey QUALIFY RANK() OVER (ORDER BY COUNT(*) DESC) <= 5",
    "distinct_on": "SELECT DISTINCT ON (c_nationkey) c_nationkey, c_custkey FROM {customer} ORDER BY c_nationkey, c_acctbal DESC, c_custkey",
    "distinct_on_cte": "WITH t AS (SELECT DISTINCT ON (o_custkey, o_orderstatus) o_custkey, o_orderstatus, o_orderkey FROM {orders} ORDER BY o_custkey, o_orderstatus, o_totalprice, o_orderkey) SELECT o_orderstatus, COUNT(*) AS n, MAX(o_orderkey) AS top FROM t GROUP BY o_orderstatus",
    "join_natural": "SELECT n_name, n_regionkey, total FROM {nation} NATURAL JOIN (SELECT s_nationkey AS n_nationkey, COUNT(*) AS total FROM {supplier} GROUP BY s_nationkey) t",
    "join_anti_rows": "SELECT c_custkey, c_name FROM {customer} c WHERE NOT EXISTS (SELECT 1 FROM {orders} o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 250000)",
    "set_except_rows": "SELECT c_custkey AS k FROM {customer} EXCEPT SELECT o_custkey FROM {orders} WHERE o_totalprice > 250000",
    "set_intersect_all": "SELECT o_orderpriority AS k FROM {orders} WHERE o_totalprice > 100000 INTERSECT ALL SELECT o_orderpriority FROM {orders} WHERE o_totalprice <= 150000",
    "distinct_on_rewrite": ("SELECT c_nationkey, MIN_BY(c_custkey, STRUCT(-c_acctbal, c_custkey)) AS c_custkey FROM {customer} GROUP BY c_nationkey", "SELECT DISTINCT ON (c_nationkey) c_nationkey, c_custkey FROM {customer} ORDER BY c_nationkey, c_acctbal DESC, c_custkey"),
    "sort_nulls_last": "SELECT place, k FROM (SELECT ROW_NUMBER() OVER (ORDER BY NULLIF(n_regionkey, 2) ASC NULLS LAST, n_nationkey) AS place, NULLIF(n_regionkey, 2) AS k FROM {nation}) t ORDER BY k DESC NULLS LAST, place",
    "topk_orders": "SELECT o_orderkey, o_totalprice FROM {orders} ORDER BY o_totalprice DESC, o_orderkey LIMIT 25",
    "limit_offset": "SELECT c_custkey FROM {customer} ORDER BY c_custkey LIMIT 10 OFFSET 40",
    "set_union": "SELECT c_nationkey AS k FROM {customer} UNION SELECT s_nationkey FROM {supplier}",
    "set_union_all": "SELECT c_nationkey AS k FROM {customer} UNION ALL SELECT s_nationkey FROM {supplier}",
    "set_intersect": "SELECT o_custkey AS k FROM {orders} WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM {orders} WHERE o_orderstatus = 'P'",
    "set_except": "SELECT c_custkey AS k FROM {customer} EXCEPT SELECT o_custkey FROM {orders}",
    "set_except_all": "SELECT o_orderpriority AS k FROM {orders} EXCEPT ALL SELECT o_orderpriority FROM {orders} WHERE o_totalprice > 150000",
    "subq_scalar": "SELECT o_orderkey FROM {orders} WHERE o_totalprice > (SELECT 1.8 * AVG(o_totalprice) FROM {orders})",
    "subq_correlated": "SELECT o_orderkey FROM {orders} o WHERE o_totalprice = (SELECT MAX(i.o_totalprice) FROM {orders} i WHERE i.o_custkey = o.o_custkey)",
    "subq_exists": "SELECT s_suppkey FROM {supplier} s WHERE EXISTS (SELECT 1 FROM {lineitem} l WHERE l.l_suppkey = s.s_suppkey AND l.l_quantity = 50)",
    "subq_in": "SELECT c_custkey FROM {customer} WHERE c_nationkey IN (SELECT n_nationkey FROM {nation} WHERE n_regionkey = 1) AND c_custkey NOT IN (SELECT o_custkey FROM {orders} WHERE o_totalprice > 200000)",
    "cte_recursive": "WITH RECURSIVE t(n, f) AS (SELECT 1, 1 UNION ALL SELECT n + 1, f * 2 FROM t WHERE n < 20) SELECT n, f FROM t",
    "values_series": ("SELECT v.a, s.b FROM VALUES (1), (2), (3) AS v(a), LATERAL explode(sequence(1, 4)) AS s(b)", "SELECT v.a, s.b FROM (VALUES (1), (2), (3)) v(a), (SELECT unnest(generate_series(1, 4))::int AS b) s"),
    "fn_string": ("SELECT c_custkey, lower(c_name) AS lo, upper(c_mktsegment) AS up, substr(c_name, 3, 5) AS sub, replace(c_name, '0', 'o') AS rep, split_part(c_name, '#', 2) AS part, lpad(CAST(c_nationkey AS STRING), 4, '0') AS pad, instr(c_name, '#') AS pos, regexp_replace(c_name, '[0-9]+', 'N') AS re, startswith(c_name, 'Cust') AS st, levenshtein(c_mktsegment, 'BUILDING') AS lev, md5(c_name) AS m, sha2(c_name, 256) AS sha FROM {customer}", "SELECT c_custkey, lower(c_name) AS lo, upper(c_mktsegment) AS up, substr(c_name, 3, 5) AS sub, replace(c_name, '0', 'o') AS rep, split_part(c_name, '#', 2) AS part, lpad(c_nationkey::varchar, 4, '0') AS pad, strpos(c_name, '#')::int AS pos, regexp_replace(c_name, '[0-9]+', 'N', 'g') AS re, starts_with(c_name, 'Cust') AS st, levenshtein(c_mktsegment, 'BUILDING')::int AS lev, md5(c_name) AS m, sha256(c_name) AS sha FROM {customer}"),
    "fn_math": "SELECT c_custkey, abs(c_acctbal) AS a, CAST(ceil(c_acctbal) AS BIGINT) AS ce, CAST(floor(c_acctbal) AS BIGINT) AS fl, round(power(c_nationkey, 2), 3) AS p, round(sqrt(abs(c_acctbal)), 6) AS s, round(ln(c_custkey + 1), 8) AS l, round(sin(c_custkey), 8) AS si, greatest(c_nationkey, 10) AS g, least(c_nationkey, 10) AS le, c_custkey % 7 AS m FROM {customer}",
    "fn_date": ("SELECT event_id, date_trunc('HOUR', ts) AS h, CAST(extract(YEAR FROM ts) AS BIGINT) AS y, CAST(extract(DOY FROM ts) AS BIGINT) AS d, ts + INTERVAL '90' MINUTE AS later, date_format(ts, 'yyyy/MM/dd') AS f, CAST(datediff(CAST(ts AS DATE), DATE '2020-01-01') AS BIGINT) AS days FROM {events}", "SELECT event_id, date_trunc('hour', ts) AS h, extract(year FROM ts) AS y, extract(doy FROM ts) AS d, ts + INTERVAL 90 MINUTE AS later, strftime(ts, '%Y/%m/%d') AS f, date_diff('day', DATE '2020-01-01', ts::date) AS days FROM {events}"),
    "fn_date_bin": ("SELECT date_bin_minutes(15, ts) AS bin, COUNT(*) AS n FROM {events} GROUP BY 1", "SELECT time_bucket(INTERVAL 15 MINUTE, ts, TIMESTAMP '1970-01-01') AS bin, COUNT(*) AS n FROM {events} GROUP BY 1"),
    "fn_conditional": "SELECT event_id, COALESCE(NULLIF(event_type, 'click'), 'none') AS a, NULLIF(user_id % 4, 0) AS b, CASE event_type WHEN 'view' THEN 1 ELSE 0 END AS c, (user_id % 4 = 0) IS TRUE AS d FROM {events}",
    "fn_array": ("SELECT vec_id, size(embedding) AS n, round(CAST(element_at(embedding, 3) AS DOUBLE), 6) AS third, round(CAST(array_max(embedding) AS DOUBLE), 6) AS top, size(filter(embedding, x -> x > 0)) AS positive, array_contains(transform(embedding, x -> CAST(x > 0.3 AS INT)), 1) AS some, slice(sequence(1, 5), 2, 2) AS part FROM {embeddings}", "SELECT vec_id, len(embedding)::int AS n, round(embedding[3]::double, 6) AS third, round(list_max(embedding)::double, 6) AS top, len(list_filter(embedding, lambda x: x > 0))::int AS positive, list_contains(list_transform(embedding, lambda x: (x > 0.3)::int), 1) AS some, [2, 3]::int[] AS part FROM {embeddings}"),
    "fn_struct_map": ("SELECT n_nationkey, named_struct('a', n_name, 'b', n_regionkey).b AS b, map('k', n_name)['k'] AS v FROM {nation}", "SELECT n_nationkey, struct_pack(a := n_name, b := n_regionkey).b AS b, map {{'k': n_name}}['k'] AS v FROM {nation}"),
    "fn_json": ("SELECT event_id, CAST(get_json_object(props, '$.k') AS BIGINT) AS k, from_json(props, 'k BIGINT').k + 1 AS k1 FROM {events}", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(json_extract_string(props, '$.k') AS BIGINT) + 1 AS k1 FROM {events}"),
    "int_division": ("SELECT n_nationkey, n_nationkey div 4 AS q FROM {nation}", "SELECT n_nationkey, (n_nationkey // 4)::bigint AS q FROM {nation}"),
    "events_session": ("SELECT user_id, COUNT(*) AS sessions FROM (SELECT user_id, CASE WHEN ts - LAG(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL '30' MINUTE THEN 0 ELSE 1 END AS fresh FROM {events}) WHERE fresh = 1 GROUP BY user_id", "SELECT user_id, COUNT(*) AS sessions FROM (SELECT user_id, CASE WHEN ts - LAG(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM {events}) WHERE fresh = 1 GROUP BY user_id"),
    "q3_shipping": f"SELECT o_orderkey, {MONEY.format('l_extendedprice * (1 - l_discount)')} AS revenue, o_orderdate FROM {{customer}} JOIN {{orders}} ON c_custkey = o_custkey JOIN {{lineitem}} ON l_orderkey = o_orderkey WHERE c_mktsegment = 'BUILDING' GROUP BY o_orderkey, o_orderdate ORDER BY revenue DESC, o_orderkey LIMIT 10",
    "q5_local_supplier": f"SELECT n_name, {MONEY.format('l_extendedprice * (1 - l_discount)')} AS revenue FROM {{customer}}, {{orders}}, {{lineitem}}, {{supplier}}, {{nation}}, {{region}} WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND l_suppkey = s_suppkey AND c_nationkey = s_nationkey AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey AND r_name = 'ASIA' GROUP BY n_name",
}


def _query(text: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        paths = {t: f"'{sf_dir}/{t}.parquet'" for t in TABLES if "{" + t + "}" in text}
        return sqlgate.query(spark, text.format(**paths))

    return run


def register(query: Callable) -> None:
    """Registers every text."""
    for name, both in TEXTS.items():
        spark_text, duck_text = both if isinstance(both, tuple) else (both, both)
        f = _query(spark_text)
        f.__name__ = name
        query(duck_text.format(**{t: t for t in TABLES}))(f)
