"""The page's own piece: the lines of its main body without what the site adds to it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnlake.llm import residue, spam
from cairnlake.llm.kinds import OWN


def own_lines(bodies: DataFrame) -> DataFrame:
    """``content_id, node_index, tag, text`` of the lines that are the page's own, whatever the page says; of ``bodies`` with texts."""
    zipped = F.expr(f"inline(filter(arrays_zip(node, tag, text, kind), x -> x.kind = {OWN}))")
    return bodies.select("content_id", zipped).select("content_id", F.col("node").alias("node_index"), "tag", "text")


def excluded(bodies: DataFrame) -> DataFrame:
    """``content_id`` of the contents that say nothing or are spam."""
    return residue.found(bodies).unionByName(spam.stuffed_contents(bodies)).distinct()


def found(bodies: DataFrame) -> DataFrame:
    """``content_id, node_index`` of the own lines of the pages that have something to say."""
    kept = bodies.join(excluded(bodies), "content_id", "left_anti")
    zipped = F.expr(f"inline(filter(arrays_zip(node, kind), x -> x.kind = {OWN}))")
    return kept.select("content_id", zipped).select("content_id", F.col("node").alias("node_index"))
