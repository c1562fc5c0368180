"""One query for each relational feature of the analysts' dialect, run through the dialect on Spark.

The text is the oracle's text: what is tested is that the translation means the same. Names follow the feature groups
of the survey (f projections and filters, g joins, h aggregates, i windows, j order, k sets and CTEs, l functions).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cairnlake.plans.engine import Engine
from cairnlake.sources.tables import register

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "capture", "html_element", "html_jsonld", "link", "frontier_delivery", "capture_work", "domain_activity", "common_word",
)

SQL: dict[str, str] = {
    "f1_projection": "SELECT c.c_custkey, upper(c.c_name) AS name, c_acctbal * 2 AS twice FROM customer c",
    "f2_string_range": "SELECT content_id, node_index, tag FROM html_element WHERE content_id >= '2' AND content_id < '3' AND tag = 'a'",
    "f3_like": "SELECT s_suppkey, s_name FROM supplier WHERE s_name LIKE '%1%' AND s_name NOT LIKE '%0'",
    "f4_ilike": "SELECT content_id, node_index FROM html_element WHERE tag = 'h1' AND text ILIKE '%MAP%'",
    "f5_in": "SELECT n_name FROM nation WHERE n_regionkey IN (1, 2) AND n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 5000)",
    "f6_exists": "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 200000) AND NOT EXISTS (SELECT 1 FROM orders p WHERE p.o_custkey = c.c_custkey AND p.o_orderstatus = 'P')",
    "f7_null_case": "SELECT capture_id, coalesce(effective_url, page_url) AS url, CASE WHEN http_status_code IS NULL THEN 'none' WHEN http_status_code >= 400 THEN 'bad' ELSE 'fine' END AS state FROM capture WHERE encoding IS NOT NULL",
    "f8_between": "SELECT o_orderkey FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1995-01-01 00:00:00' AND TIMESTAMP '1995-06-30 00:00:00'",
    "f9_row_comparison": "SELECT o_orderkey, o_custkey FROM orders WHERE (o_custkey, o_orderkey) < (20, 300)",
    "f10_alias_in_where": "SELECT domain, queued + dispatched AS busy FROM domain_activity WHERE busy > 100 AND domain IS NOT NULL",
    "f11_qualify": "SELECT capture_id, page_url, captured_at FROM capture QUALIFY row_number() OVER (PARTITION BY page_url ORDER BY captured_at DESC, capture_id DESC) = 1",
    "f11b_qualify_alias": "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS place FROM events QUALIFY place <= 2 ORDER BY user_id, place",
    "f12_casts": "SELECT l_orderkey, l_quantity::BIGINT AS q, CAST(l_linenumber AS VARCHAR) AS n, l_extendedprice::DECIMAL(18,2)::VARCHAR AS price FROM lineitem",
    "f13_regex": "SELECT p_partkey FROM part WHERE regexp_matches(p_name, '[0-9]*[02468]$')",
    "f15_not_in": "SELECT n_nationkey FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_nationkey IS NOT NULL)",
    "g1_inner_using": "SELECT DISTINCT capture_id, j.node_index FROM capture JOIN html_jsonld j USING (content_id) WHERE j.parse_error IS NULL",
    "g2_left_outer": "SELECT c.c_custkey, count(o.o_orderkey) AS n FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey AND o.o_orderstatus = 'F' GROUP BY c.c_custkey",
    "g3_left_on_true": "SELECT r.r_name, v.lo FROM region r LEFT JOIN (SELECT min(n_nationkey) AS lo FROM nation) v ON TRUE",
    "g4_comma_one_row": "WITH clock AS (SELECT max(ts) AS now FROM events) SELECT event_id FROM events e, clock WHERE e.ts >= clock.now - INTERVAL '1 day'",
    "g5_semi": "SELECT c_custkey FROM customer SEMI JOIN orders ON o_custkey = c_custkey AND o_totalprice > 250000",
    "g6_anti": "SELECT c_custkey FROM customer ANTI JOIN orders ON o_custkey = c_custkey",
    "g7_subtree": "SELECT DISTINCT b.content_id, d.node_index FROM html_element b JOIN html_element d ON d.content_id = b.content_id AND d.node_index BETWEEN b.node_index AND b.subtree_end_index - 1 WHERE b.tag = 'nav' AND d.tag = 'a'",
    "g8_time_range": "SELECT w.as_of, w.domain, count(v.as_of) AS n FROM domain_activity w LEFT JOIN domain_activity v ON v.domain = w.domain AND v.as_of > w.as_of - INTERVAL '6 hours' AND v.as_of < w.as_of WHERE w.dispatched > 10 GROUP BY w.as_of, w.domain",
    "g9_siblings": "SELECT DISTINCT a.content_id, a.node_index AS h, b.node_index AS p FROM html_element a JOIN html_element b ON a.content_id = b.content_id AND a.parent_index = b.parent_index AND b.sibling_index = a.sibling_index + 1 WHERE a.tag = 'h1' AND b.tag = 'time'",
    "g10_lateral_unnest": "SELECT d.doc_id, t.w FROM (SELECT doc_id, string_split(lang, '-') AS parts FROM documents WHERE lang IS NOT NULL) d, unnest(d.parts) AS t(w)",
    "g12_full_outer": "SELECT s.s_nationkey AS a, c.c_nationkey AS b, s.n AS n, c.m AS m FROM (SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY 1) s FULL OUTER JOIN (SELECT c_nationkey, count(*) AS m FROM customer GROUP BY 1) c ON s.s_nationkey = c.c_nationkey",
    "g12b_right_outer": "SELECT n.n_name AS name, s.s_suppkey AS k FROM supplier s RIGHT JOIN nation n ON s.s_nationkey = n.n_nationkey",
    "h1_counts": "SELECT o_orderstatus, count(*) AS n, count(o_custkey) AS k, count(DISTINCT o_custkey) AS d FROM orders GROUP BY o_orderstatus",
    "h2_count_tuple": "SELECT count(DISTINCT (content_id, node_index)) AS n FROM html_element",
    "h3_extremes": "SELECT c_nationkey, coalesce(sum(c_custkey), 0)::BIGINT AS s, min(c_name) AS a, max(c_name) AS z FROM customer GROUP BY c_nationkey",
    "h4_filter": "SELECT event_type, count(*) FILTER (WHERE value > 50) AS high, count(*) AS n FROM events GROUP BY event_type",
    "h5_count_if": "SELECT tag, count_if(map_contains(attributes, 'class'))::BIGINT AS n FROM html_element GROUP BY tag",
    "h6_arg_max": "SELECT page_url, arg_max(content_id, (captured_at, capture_id)) AS last, arg_min(content_id, (captured_at, capture_id)) AS first FROM capture GROUP BY page_url",
    "h7_bool_and": "SELECT o_custkey, bool_and(o_totalprice > 1000) AS all_big, bool_or(o_orderstatus = 'P') AS some FROM orders GROUP BY o_custkey",
    "h8_quantiles": "SELECT l_returnflag, round(median(l_quantity), 4) AS med, round(quantile_cont(l_quantity, 0.95), 4) AS p95 FROM lineitem GROUP BY l_returnflag",
    "h9_percentile_cont": "SELECT round(percentile_cont(0.9) WITHIN GROUP (ORDER BY queued), 4) AS p90 FROM domain_activity",
    "h10_lists": "SELECT o_custkey, list_sort(list_distinct(list(o_orderstatus))) AS states FROM orders GROUP BY o_custkey",
    "h11_array_agg": "SELECT o_custkey, (array_agg(o_orderkey ORDER BY o_orderdate DESC, o_orderkey DESC))[1] AS last FROM orders GROUP BY o_custkey",
    "h12_string_agg": "SELECT n_regionkey, string_agg(n_name, ', ' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey",
    "h13_ordinals": "SELECT date_trunc('month', o_orderdate) AS m, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2",
    "h14_having": "SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY l_suppkey HAVING count(*) > 20 AND max(l_linenumber) > 3",
    "h15_grouping_sets": "SELECT o_orderstatus, o_orderpriority, grouping(o_orderstatus)::BIGINT AS gs, grouping(o_orderpriority)::BIGINT AS gp, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus, o_orderpriority), (o_orderstatus), ())",
    "h16_cube": "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)",
    "h16b_rollup": "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)",
    "h17_scalar_subqueries": "SELECT (SELECT count(*) FROM orders) AS orders, (SELECT count(*) FROM lineitem) AS items, (SELECT max(c_custkey) FROM customer) AS last",
    "h18_distinct": "SELECT DISTINCT lower(trim(encoding)) AS encoding, http_status_code FROM capture",
    "h19_distinct_on": "SELECT DISTINCT ON (page_url) page_url, capture_id, captured_at FROM capture ORDER BY page_url, captured_at DESC, capture_id",
    "i1_latest": "SELECT capture_id, rn FROM (SELECT capture_id, row_number() OVER (PARTITION BY page_url ORDER BY captured_at DESC NULLS LAST, capture_id DESC) AS rn FROM (SELECT DISTINCT capture_id, page_url, captured_at FROM capture)) WHERE rn = 1",
    "i2_sampled_by_hash": "SELECT capture_id FROM (SELECT capture_id, row_number() OVER (PARTITION BY http_status_code ORDER BY md5(capture_id), capture_id) AS rn, http_status_code FROM (SELECT DISTINCT capture_id, http_status_code FROM capture)) WHERE rn <= 5",
    "i3_partition_expression": "SELECT domain, as_of, queued, row_number() OVER (PARTITION BY domain IS NULL ORDER BY as_of DESC, domain, queued, dispatched, started, unique_queued_urls, request_queued_urls, oldest_wait_at) AS rn FROM domain_activity",
    "i4_over_all": "SELECT o_orderpriority, count(*) AS n, sum(count(*)) OVER ()::BIGINT AS total FROM orders GROUP BY o_orderpriority",
    "i5_running_max": "SELECT user_id, event_id, max(CASE WHEN event_type = 'click' THEN event_id END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_click FROM events",
    "i6_running_before": "SELECT l_orderkey, l_linenumber, coalesce(sum(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM lineitem",
    "i7_lead_lag": "SELECT event_id, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt, lag(event_id, 2) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events",
    "i9_ranks": "SELECT p_partkey, rank() OVER (ORDER BY p_size DESC) AS r, dense_rank() OVER (ORDER BY p_size DESC) AS d, ntile(4) OVER (ORDER BY p_size, p_partkey) AS q, first_value(p_partkey) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS f FROM part",
    "i9b_range_frame": "SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderdate RANGE BETWEEN INTERVAL '30 days' PRECEDING AND CURRENT ROW) AS n FROM orders",
    "j1_order_nulls": "SELECT capture_id, effective_url FROM (SELECT DISTINCT capture_id, effective_url FROM capture) ORDER BY effective_url DESC NULLS FIRST, capture_id LIMIT 50",
    "j2_default_nulls": "SELECT capture_id, effective_url FROM (SELECT DISTINCT capture_id, effective_url FROM capture) ORDER BY effective_url, capture_id",
    "j3_limit_offset": "SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 40",
    "j5_keyset": "SELECT o_orderkey, o_orderdate FROM orders WHERE (o_orderdate, o_orderkey) < (TIMESTAMP '1996-01-01 00:00:00', 1000) ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 25",
    "j6_top_n": "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 100",
    "k1_union": "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier UNION ALL SELECT n_nationkey FROM nation",
    "k2_except_all": "SELECT o_custkey FROM orders EXCEPT ALL SELECT c_custkey FROM customer",
    "k3_intersect": "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier",
    "k3b_intersect_all": "SELECT l_suppkey AS k FROM lineitem INTERSECT ALL SELECT s_suppkey FROM supplier",
    "k4_materialized": "WITH big AS MATERIALIZED (SELECT o_custkey, sum(o_totalprice) AS s FROM orders GROUP BY 1), small AS NOT MATERIALIZED (SELECT c_custkey FROM customer WHERE c_acctbal < 0) SELECT b.o_custkey, round(b.s, 2) AS s FROM big b JOIN small ON c_custkey = o_custkey",
    "k5_correlated": "SELECT o_orderkey FROM orders o WHERE o_totalprice > (SELECT avg(p.o_totalprice) * 1.5 FROM orders p WHERE p.o_custkey = o.o_custkey)",
    "k10_recursive": "WITH RECURSIVE n(x, y) AS (SELECT 1::BIGINT, 1::BIGINT UNION ALL SELECT x + 1, y * 2 FROM n WHERE x < 30) SELECT x, y FROM n",
    "l1_strings": "SELECT p_partkey, lower(p_name) AS a, substr(p_name, 2, 3) AS b, replace(p_type, 'A', '-') AS c, length(p_name) AS d, left(p_brand, 3) AS e, contains(p_type, 'E') AS f, split_part(p_brand, '#', 2) AS g, nullif(p_brand, 'x') AS h, concat(p_brand, '/', p_type) AS i, trim('[' || p_brand || ']', '[]') AS j, starts_with(p_name, 'p') AS k FROM part",
    "l2_regex": "SELECT page_url, regexp_extract(page_url, '^https?://([^/]+)', 1) AS host, regexp_extract(page_url, '[a-z]+$') AS tail, regexp_replace(page_url, '([0-9]+)', '<\\1>', 'g') AS marked, regexp_extract_all(page_url, '[0-9]+') AS numbers FROM (SELECT DISTINCT page_url FROM capture)",
    "l3_maps": "SELECT DISTINCT content_id, node_index, attributes['href'] AS href, map_contains(attributes, 'class') AS styled, map_extract_value(attributes, 'class') AS class FROM html_element WHERE tag = 'a'",
    "l4_lists": "SELECT doc_id, len(string_split(url, '/')) AS n, list_filter(string_split(url, '/'), lambda x: length(x) > 3) AS longer, list_contains(string_split(url, '/'), 'https:') AS safe, (string_split(url, '/'))[3] AS host, list_max(string_split(url, '/')) AS top FROM documents WHERE url IS NOT NULL",
    "l5_json": "SELECT event_id, props->>'k' AS k, json_extract_string(props, '$.k') AS k2, try_cast(props->>'k' AS BIGINT) AS n FROM events",
    "l6_literals": "SELECT n_nationkey, ['a', n_name] AS l, list_contains([1, 2, 3], n_regionkey) AS m, MAP {'k': n_name}['k'] AS v FROM nation",
    "l7_dates": "SELECT o_orderkey, date_trunc('year', o_orderdate) AS y, o_orderdate + INTERVAL '2 days' AS later, date_diff('day', o_orderdate, TIMESTAMP '1999-01-01 00:00:00')::BIGINT AS age, extract(month FROM o_orderdate)::BIGINT AS m FROM orders",
    "l8_sizes_hashes": "SELECT n_name, octet_length(encode(n_name)) AS bytes, md5(n_name) AS h FROM nation",
    "l9_generator": "SELECT t.i * 3 AS x FROM range(100) AS t(i) WHERE t.i % 2 = 0",
}

TEXTS = {f"sql_{name}": text for name, text in SQL.items()}


def _runner(text: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        register(spark, sf, *TABLES)
        return Engine(spark, TABLES).frame(text)[1]

    return run


QUERIES = {name: _runner(text) for name, text in TEXTS.items()}
ORACLES = dict(TEXTS)
