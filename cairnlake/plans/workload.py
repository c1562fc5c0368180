"""Analysts' workload over the public views, written in the dialect; the text is the oracle's text too."""

from __future__ import annotations

from cairnlake.plans.relational import _runner

_NEWEST = "newest AS (SELECT DISTINCT capture_id, page_url, content_id, captured_at FROM capture QUALIFY row_number() OVER (PARTITION BY page_url ORDER BY captured_at DESC, capture_id DESC) = 1)"

SQL: dict[str, str] = {
    "domain_inventory": "SELECT regexp_extract(page_url, '^https?://([^/:]+)', 1) AS hostname, count(*) AS n, count(DISTINCT content_id) AS contents, min(captured_at) AS first_at, max(captured_at) AS last_at FROM capture WHERE hostname <> '' AND hostname NOT LIKE 'm.%' GROUP BY hostname",
    "recent_ingestion": "WITH edge AS (SELECT max(captured_at) AS at FROM capture) SELECT date_trunc('hour', c.captured_at) AS hour, count(*) AS n FROM capture c, edge WHERE c.captured_at > edge.at - INTERVAL '7 days' AND c.page_url LIKE '%example%' GROUP BY 1",
    "latest_products": f"WITH {_NEWEST}, product AS (SELECT DISTINCT content_id, node_index, json_extract_string(value, '$.name') AS name, value->>'sku' AS sku, try_cast(json_extract_string(value, '$.offers.price') AS DECIMAL(18,2)) AS price FROM html_jsonld WHERE parse_error IS NULL AND json_extract_string(value, '$.sku') IS NOT NULL) SELECT page_url, node_index, name, sku, price::VARCHAR AS price FROM newest JOIN product USING (content_id)",
    "metadata_cohort": "SELECT DISTINCT content_id, node_index, attributes['name'] AS name, attributes['content'] AS value FROM html_element WHERE tag = 'meta' AND content_id >= '0' AND content_id < '8'",
    "heading_search": "SELECT DISTINCT c.page_url, h.node_index, h.tag, trim(h.text) AS heading FROM html_element h JOIN capture c USING (content_id) WHERE h.tag IN ('h1', 'h2', 'h3') AND h.text ILIKE '%the MARKET%' OR h.tag = 'h1' AND h.text ILIKE '%garden%'",
    "selected_headings": f"WITH {_NEWEST}, picked AS (SELECT content_id, page_url FROM newest ORDER BY captured_at DESC, capture_id LIMIT 100) SELECT DISTINCT p.page_url, h.node_index, h.tag, h.text FROM picked p JOIN html_element h ON h.content_id = p.content_id AND h.tag IN ('h1', 'h2', 'h3', 'h4')",
    "subtree_text": "WITH e AS (SELECT DISTINCT content_id, node_index, subtree_end_index, tag, text_direct FROM html_element) SELECT m.content_id, m.node_index, string_agg(trim(d.text_direct), '|' ORDER BY d.node_index) AS text FROM e m JOIN e d ON d.content_id = m.content_id AND d.node_index >= m.node_index AND d.node_index < m.subtree_end_index WHERE m.tag IN ('ul', 'table', 'blockquote') AND d.text_direct <> '' GROUP BY m.content_id, m.node_index",
    "exact_text": "SELECT DISTINCT content_id, node_index FROM html_element WHERE text = 'Home'",
    "image_accessibility": "WITH e AS (SELECT DISTINCT content_id, node_index, tag, attributes['alt'] AS alt, map_contains(attributes, 'href') AS linked FROM html_element) SELECT tag, count(*) AS n, count(alt) AS described, count_if(linked)::BIGINT AS linked FROM e WHERE tag IN ('img', 'figure', 'a') GROUP BY tag",
    "external_destinations": "WITH c AS (SELECT DISTINCT capture_id, regexp_extract(page_url, '^https?://([^/:]+)', 1) AS site FROM capture), l AS (SELECT DISTINCT capture_id, node_index, regexp_extract(target_url, '^https?://([^/:]+)', 1) AS target FROM link) SELECT target, count(DISTINCT site) AS sites, count(*) AS links FROM l JOIN c USING (capture_id) WHERE target <> site GROUP BY target HAVING count(DISTINCT site) > 1",
    "page_history": "SELECT page_url, capture_id, captured_at, lag(content_id) OVER (PARTITION BY page_url ORDER BY captured_at, capture_id) IS DISTINCT FROM content_id AS changed FROM (SELECT DISTINCT page_url, capture_id, captured_at, content_id FROM capture)",
    "word_search": "WITH hits AS (SELECT content_id, count(DISTINCT node_index) AS nodes FROM html_element WHERE regexp_matches(lower(text_direct), '\\bharbour\\b|\\bgarden\\b') GROUP BY content_id) SELECT min(c.page_url) AS page_url, h.content_id, h.nodes FROM hits h JOIN capture c USING (content_id) GROUP BY h.content_id, h.nodes ORDER BY h.nodes DESC, h.content_id LIMIT 25",
    "orphans": "SELECT DISTINCT l.target_url FROM link l WHERE NOT EXISTS (SELECT 1 FROM capture c WHERE c.page_url = l.target_url) AND l.target_url LIKE 'https://www.%'",
    "jsonld_kinds": "SELECT json_type(value) AS kind, json_extract_string(value, '$.\"@type\"') AS type, count(*) AS n FROM (SELECT DISTINCT content_id, node_index, value FROM html_jsonld WHERE parse_error IS NULL AND value LIKE '{%') GROUP BY 1, 2",
}

TEXTS = {f"case_{name}": text for name, text in SQL.items()}
QUERIES = {name: _runner(text) for name, text in TEXTS.items()}
ORACLES = dict(TEXTS)
