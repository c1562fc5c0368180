"""Queries of the subpackage by name, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnlake.llm import boilerplate, maintext, packing, quality, residue, spam, tokens
from cairnlake.llm.bodies import bodies
from cairnlake.sources.tables import table


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    found = boilerplate.repeated(table(spark, sf, "html_element"), table(spark, sf, "capture"))
    return found.select("content_id", "node_index").distinct()


def p2_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """The occurrences of boilerplate blocks: each line with the first line of its run and the size of its block."""
    found = boilerplate.repeated(table(spark, sf, "html_element"), table(spark, sf, "capture"))
    return found.select("content_id", "node_index", "site", "first_node", "block_lines").distinct()


def p2_texts(spark: SparkSession, sf: str) -> DataFrame:
    return boilerplate.cleaned(table(spark, sf, "html_element"), table(spark, sf, "capture"))


def _bodies(spark: SparkSession, sf: str) -> DataFrame:
    return bodies(table(spark, sf, "html_element"), table(spark, sf, "capture"))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return maintext.found(_bodies(spark, sf))


def p3_texts(spark: SparkSession, sf: str) -> DataFrame:
    """``content_id, node_index, tag, text`` of every page's own lines, residue and spam included."""
    return maintext.own_lines(bodies(table(spark, sf, "html_element"), table(spark, sf, "capture"), texts=True))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return residue.found(_bodies(spark, sf))


def p4_slots(spark: SparkSession, sf: str) -> DataFrame:
    return residue.slots(_bodies(spark, sf))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return spam.found(_bodies(spark, sf), table(spark, sf, "capture"))


def p6_scores(spark: SparkSession, sf: str) -> DataFrame:
    return spam.scores(_bodies(spark, sf))


def p8_ids(spark: SparkSession, sf: str) -> DataFrame:
    return tokens.encode(table(spark, sf, "documents"))


def p9_containers(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(table(spark, sf, "documents"))


def p9_fill(spark: SparkSession, sf: str) -> DataFrame:
    return packing.container_fill(packing.pack(table(spark, sf, "documents")))


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    return quality.junk(table(spark, sf, "documents"), table(spark, sf, "common_word"))


def p10_statistics(spark: SparkSession, sf: str) -> DataFrame:
    return quality.score(table(spark, sf, "documents"), table(spark, sf, "common_word"))


def p10_held_out(spark: SparkSession, sf: str) -> DataFrame:
    return quality.held_out(table(spark, sf, "documents"), table(spark, sf, "common_word"))


def p10_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Those statistics of each document that SQL can say too, rounded."""
    c = quality.counts(table(spark, sf, "documents"), table(spark, sf, "common_word"))
    names = ("n_chars", "n_words", "mean_word_length", "words_per_line", "separator_ratio", "longest_word", "common_share", "distinct_share", "repeated_line_share")
    return c.select("doc_id", *[F.round(n, 5).alias(n) for n in names])


QUERIES = {f.__name__: f for f in (p2_found, p2_blocks, p2_texts, p3_found, p3_texts, p4_found, p4_slots, p6_found, p6_scores, p8_ids, p9_containers, p9_fill, p10_found, p10_statistics, p10_counts, p10_held_out)}
#: White space of any kind, for DuckDB's regular expressions.
_SPACE = r"[\s\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{85}\x{1c}-\x{1f}]"

_LINES = rf"""
WITH el AS (
  SELECT DISTINCT content_id, node_index, subtree_end_index AS stop, lower(tag) AS tag, text_direct, text FROM html_element
), body AS (SELECT content_id, node_index AS b0, stop AS b1 FROM el WHERE tag = 'body'),
own AS (
  SELECT el.content_id, node_index, stop, text,
    max(stop) OVER (PARTITION BY el.content_id ORDER BY node_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen
  FROM el JOIN body ON el.content_id = body.content_id AND node_index > b0 AND node_index < b1
  WHERE tag NOT IN ('script', 'style') AND regexp_replace(text_direct, '{_SPACE}', '', 'g') <> ''
), lines AS (
  SELECT content_id, node_index, lower(trim(regexp_replace(text, '{_SPACE}+', ' ', 'g'))) AS wording
  FROM own WHERE seen IS NULL OR node_index >= seen
), site AS (
  SELECT DISTINCT content_id, lower(regexp_extract(page_url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)', 1)) AS site FROM capture
  WHERE content_id IN (SELECT content_id FROM html_element)
), total AS (SELECT site, count(DISTINCT content_id) AS n FROM site GROUP BY site),
repeated AS (
  SELECT site, wording FROM lines JOIN site USING (content_id) JOIN total USING (site)
  GROUP BY site, wording, n HAVING count(DISTINCT content_id) >= 4 AND 4 * count(DISTINCT content_id) >= n
)"""

_BLOCKS = """, kept AS (SELECT site, wording FROM repeated),
steps AS (SELECT content_id, wording AS a, lead(wording) OVER (PARTITION BY content_id ORDER BY node_index) AS b FROM lines),
edges AS (
  SELECT site, a, b FROM steps JOIN site USING (content_id) JOIN total USING (site) WHERE b IS NOT NULL
  GROUP BY site, a, b, n HAVING count(DISTINCT content_id) >= 4 AND 4 * count(DISTINCT content_id) >= n
), linked AS (SELECT site, a, b FROM edges UNION SELECT site, b, a FROM edges),
reach(site, w, r) AS (SELECT site, wording, wording FROM kept UNION SELECT reach.site, linked.b, reach.r FROM reach JOIN linked ON linked.site = reach.site AND linked.a = reach.w),
block AS (SELECT site, w AS wording, min(r) AS block FROM reach GROUP BY ALL),
sized AS (SELECT site, block, count(*)::INT AS block_lines FROM block GROUP BY ALL),
marked AS (
  SELECT content_id, site, node_index, block, block IS DISTINCT FROM lag(block) OVER w OR lag(block) OVER w IS NULL AS opens
  FROM lines JOIN site USING (content_id) LEFT JOIN block USING (site, wording) WINDOW w AS (PARTITION BY content_id, site ORDER BY node_index)
), runs AS (SELECT *, max(CASE WHEN opens THEN node_index END) OVER (PARTITION BY content_id, site ORDER BY node_index) AS first_node FROM marked)"""

# Of each document: its words (runs without white space), its lines that are not blank, and its runs of letters.
_COUNTS = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '{_SPACE}+'), lambda x: x <> '') AS words,
    list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '\r\n|\r|\n'), lambda x: regexp_replace(x, '^{_SPACE}+|{_SPACE}+$', '', 'g')), lambda x: x <> '') AS lines
  FROM documents
), k AS (SELECT list(DISTINCT lower(word)) AS known FROM common_word), w AS (SELECT d.*, known, list_sum(list_transform(words, lambda x: length(x))) AS solid, flatten(list_transform(lines, lambda x: regexp_extract_all(lower(x), '{{LETTERS}}+(?:[''’-]{{LETTERS}}+)*'))) AS runs FROM d, k)
SELECT doc_id, length(t)::DOUBLE AS n_chars, len(words)::DOUBLE AS n_words,
  CASE WHEN len(words) = 0 THEN 0 ELSE round(solid / len(words), 5) END::DOUBLE AS mean_word_length,
  CASE WHEN len(words) = 0 THEN 0 ELSE round(len(words) / len(lines), 5) END::DOUBLE AS words_per_line,
  CASE WHEN len(words) = 0 THEN 0 ELSE round(length(regexp_replace(t, '[^,;|\t/·=]', '', 'g')) / solid, 5) END::DOUBLE AS separator_ratio,
  CASE WHEN len(words) = 0 THEN 0 ELSE list_max(list_transform(words, lambda x: length(x))) END::DOUBLE AS longest_word,
  CASE WHEN len(words) = 0 THEN 0 ELSE round(len(list_filter(runs, lambda x: list_contains(known, x))) / greatest(1, len(runs)), 5) END::DOUBLE AS common_share,
  CASE WHEN len(words) = 0 THEN 0 ELSE round(len(list_distinct(runs)) / greatest(1, len(runs)), 5) END::DOUBLE AS distinct_share,
  CASE WHEN len(words) = 0 THEN 0 ELSE round(1 - len(list_distinct(lines)) / len(lines), 5) END::DOUBLE AS repeated_line_share
FROM w"""

ORACLES = {
    "p2_found": _LINES
    + """
SELECT DISTINCT content_id, node_index FROM lines JOIN site USING (content_id) JOIN repeated USING (site, wording)""",
    "p2_blocks": _LINES.replace("WITH el", "WITH RECURSIVE el", 1)
    + _BLOCKS
    + """
SELECT DISTINCT content_id, node_index, site, first_node, block_lines FROM runs JOIN sized USING (site, block)""",
    "p2_texts": _LINES.replace("AS wording", "AS wording, trim(regexp_replace(text, '" + _SPACE + "+', ' ', 'g')) AS plain", 1)
    + """, every AS (SELECT DISTINCT content_id FROM el), sited AS (SELECT content_id, site FROM every LEFT JOIN site USING (content_id))
SELECT content_id, s.site, coalesce(string_agg(plain, chr(10) ORDER BY node_index) FILTER (WHERE r.wording IS NULL AND l.wording IS NOT NULL), '') AS text
FROM sited s LEFT JOIN lines l USING (content_id) LEFT JOIN repeated r ON r.site = s.site AND r.wording = l.wording GROUP BY content_id, s.site""",
    "p10_counts": _COUNTS.replace("{LETTERS}", r"[\p{L}\p{Nl}\p{No}]"),
}
