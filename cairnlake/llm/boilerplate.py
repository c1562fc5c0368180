"""Lines repeated within one site's pages.

A content is a row of its lines in document order, each with the hash of its wording. Over all contents of a site the
lines are the nodes and consecutive lines the edges of a weighted graph; the weight is the number of contents. Nodes
and edges of high support stay, their connected components are the site's boilerplate blocks. A page is matched against
the blocks as sequences: an occurrence is a run of consecutive lines of one block, and occurrences are deleted. A line
that is repeated without steady neighbours is a block of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnlake.llm import pages
from cairnlake.llm.words import mixed
from cairnlake.session import cut, written

#: A wording is repeated excessively from so many contents of its site ...
LEAST_CONTENTS = 4
#: ... and this share of the site's contents.
LEAST_SHARE = 0.25
#: A site is hot from this part of all contents; there are at most so many, and each is spread over as many salts at most.
HOT_PARTS = 200
#: Wordings a process remembers before the memo is emptied.
MEMO = 200_000

def wording(text: str) -> str:
    """Runs of white space as one space, ends trimmed, lower case: equal wordings are equal texts."""
    return " ".join(text.split()).lower()


class Wordings(dict):
    """Text of a line to the hash of its wording."""

    def __missing__(self, text: str) -> int:
        if len(self) >= MEMO:
            self.clear()
        h = self[text] = xxhash.xxh64_intdigest(wording(text)) - (1 << 63)
        return h


LINES = "content_id string, node array<int>, h array<bigint>"


def _lists(offsets: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), values)


def lines(elements: DataFrame) -> DataFrame:
    """``content_id, node, h``: the lines of each content in document order and the hashes of their wordings.

    A content without lines has empty arrays. One shuffle by content, combined before it; what is sent to Python are
    whole pages in Arrow batches.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Wordings()
        for big in batches:
            for at in range(0, len(big), pages.PAGES_PER_BATCH):
                b = big.slice(at, pages.PAGES_PER_BATCH)
                f, flat = pages.forest(b.column(1))
                rows = pages.line_rows(f)
                text = flat.field("w").take(pa.array(f.take[rows])).to_pylist()
                h = np.fromiter((memo[t] for t in text), np.int64, len(text))
                offsets = np.searchsorted(f.page[rows], np.arange(f.pages + 1))
                node = pa.array(f.node[rows].astype(np.int32))
                yield pa.RecordBatch.from_arrays([b.column(0), _lists(offsets, node), _lists(offsets, pa.array(h))], names=["content_id", "node", "h"])

    return pages.whole_pages(elements).mapInArrow(run, LINES)


def sited(per_content: DataFrame, capture: DataFrame) -> DataFrame:
    """The contents with their site; a content that was captured nowhere has none and is left out."""
    return per_content.join(pages.content_sites(capture), "content_id")


def supports(contents: DataFrame) -> DataFrame:
    """``site, a, b, n``: in how many contents a wording (``b`` null) or a pair of consecutive wordings stands.

    Each content counts once for a node or an edge. The count combines before the shuffle, so a site with a third of
    all pages, or a wording on each of them, sends few rows.
    """
    units = F.expr(
        """array_union(
             transform(h, x -> named_struct('a', x, 'b', cast(null AS bigint))),
             if(size(h) < 2, array(), transform(slice(h, 2, size(h) - 1), (y, k) -> named_struct('a', h[k], 'b', y))))"""
    )
    return contents.select("site", F.inline(units)).groupBy("site", "a", "b").agg(F.count(F.lit(1)).alias("n"))


def totals(contents: DataFrame) -> DataFrame:
    """``site, total``: the site's contents."""
    return contents.groupBy("site").agg(F.count(F.lit(1)).alias("total"))


def with_site(contents: DataFrame, words: DataFrame, how: str) -> DataFrame:
    """Contents joined to the one row of their site, hot sites salted.

    A site with a part of 1 / ``HOT_PARTS`` of all contents is spread over salts in proportion to its size, and its row
    is repeated for each: no task meets more than about that part, whatever the site holds. The hot sites (at most
    ``HOT_PARTS`` rows) are broadcast.
    """
    total = cut(totals(contents.where("site IS NOT NULL")))
    n = total.agg(F.sum("total")).first()[0] or 0
    hot = total.where(F.col("total") * HOT_PARTS >= n).select("site", F.ceil(F.col("total") * HOT_PARTS / F.lit(max(n, 1))).cast("int").alias("_salts"))
    left = contents.join(F.broadcast(hot), "site", "left").withColumn("_salt", F.pmod(F.xxhash64("content_id"), F.coalesce("_salts", F.lit(1)))).drop("_salts")
    spread = words.join(F.broadcast(hot), "site", "left").withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), (F.coalesce("_salts", F.lit(1)) - 1).cast("bigint")))).drop("_salts")
    return left.join(spread, ["site", "_salt"], how).drop("_salt")


def _components(site: tuple, g: pd.DataFrame) -> pd.DataFrame:
    """Connected components of a site's kept graph by union-find; a block is named by its least wording hash."""
    nodes = g.loc[g.b.isna(), "a"].tolist()
    up = {x: x for x in nodes}

    def find(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in g.loc[g.b.notna(), ["a", "b"]].astype("int64").itertuples(index=False):
        if a in up and b in up:
            r, s = find(a), find(b)
            up[max(r, s)] = min(r, s)
    return pd.DataFrame({"site": [site[0]], "words": [nodes], "block": [[find(x) for x in nodes]]})


def blocks(contents: DataFrame) -> DataFrame:
    """``site, words, block``: the wordings of each site's boilerplate blocks, one row per site that has any.

    A kept node stands in a quarter of the site's contents, so a site keeps at most four times as many nodes as a
    page has lines on average (edges likewise), however large the site is: the rows of a site that meet in one task
    are bounded by the size of a page.
    """
    kept = (
        supports(contents).where(F.col("n") >= LEAST_CONTENTS)
        .join(totals(contents), "site")
        .where(F.col("n") >= F.col("total") * LEAST_SHARE)
        .select("site", "a", F.col("b").cast("decimal(20,0)").cast("string").alias("b"))
    )
    return kept.groupBy("site").applyInPandas(_components, "site string, words array<bigint>, block array<bigint>")


def _look(values: np.ndarray, of: np.ndarray, keys: pa.ListArray, found: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """What ``found`` has beside each value in the list ``keys`` of its page, and whether it is there."""
    sizes = pc.fill_null(pc.list_value_length(keys), 0).to_numpy(zero_copy_only=False)
    page = np.repeat(np.arange(len(keys)), sizes).astype(np.uint64)
    k, v = (x.flatten().to_numpy(zero_copy_only=False).astype(np.int64) for x in (keys, found))
    there = mixed(page, k.view(np.uint64))
    order = np.argsort(there)
    there, v = there[order], v[order]
    want = mixed(of.astype(np.uint64), values.view(np.uint64))
    if not len(there):
        return np.zeros(len(want), np.int64), np.zeros(len(want), bool)
    at = np.minimum(np.searchsorted(there, want), len(there) - 1)
    return v[at], there[at] == want


def _occurrences(b: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """Of each line of a batch of contents (``node, h, words, block`` in columns 2 to 5): its content, node, hash, the
    block it belongs to, whether it belongs to any, and the first node of its run."""
    sizes = pc.list_value_length(b.column(2)).to_numpy(zero_copy_only=False)
    of = np.repeat(np.arange(len(b)), sizes)
    node, h = (b.column(i).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for i in (2, 3))
    block, there = _look(h, of, b.column(4), b.column(5))
    goes_on = np.concatenate([[False], there[1:] & there[:-1] & (block[1:] == block[:-1]) & (of[1:] == of[:-1])]) if len(of) else np.zeros(0, bool)
    start = np.maximum.accumulate(np.where(goes_on, 0, np.arange(len(of)))) if len(of) else np.zeros(0, np.int64)
    return of, node, h, block, there, node[start]


def repeated(elements: DataFrame, capture: DataFrame) -> DataFrame:
    """``content_id, node_index, site, block, block_lines, first_node``: the lines repeated excessively within their site.

    ``block`` names the block among the site's, ``block_lines`` is its number of wordings, and ``first_node`` the first
    line of the occurrence, a run of consecutive lines of one block. Lines, wordings and sites are those of the data's
    terms; a content stored or captured several times counts once. Contents without a capture belong to no site and
    give no rows; a null text is no line. Empty tables give none.
    """
    contents = written(sited(lines(elements), capture), "site-lines")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            of, node, _, block, there, first = _occurrences(b)
            of, node, block, first = of[there], node[there], block[there], first[there]
            # The wordings of a site's block, counted in its list.
            sizes = pc.list_value_length(b.column(5)).to_numpy(zero_copy_only=False)
            key = mixed(np.repeat(np.arange(len(b)), sizes).astype(np.uint64), b.column(5).flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
            names, n = np.unique(key, return_counts=True)
            many = n[np.searchsorted(names, mixed(of.astype(np.uint64), block.view(np.uint64)))] if len(names) else np.zeros(0, np.int64)
            take = pa.array(of)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(take), pa.array(node.astype(np.int32)), b.column(1).take(take), pa.array(block), pa.array(many.astype(np.int32)), pa.array(first.astype(np.int32))],
                names=["content_id", "node_index", "site", "block", "block_lines", "first_node"],
            )

    met = with_site(contents, blocks(contents), "inner").select("content_id", "site", "node", "h", "words", "block")
    return met.mapInArrow(run, "content_id string, node_index int, site string, block bigint, block_lines int, first_node int")


def cleaned(elements: DataFrame, capture: DataFrame) -> DataFrame:
    """``content_id, site, text``: each content's lines without the occurrences of its site's blocks, joined by line feeds.

    A content of which nothing is left has an empty text; contents without a capture keep all their lines.
    """
    sites = pages.content_sites(capture)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Wordings()
        for big in batches:
            for at in range(0, len(big), pages.PAGES_PER_BATCH):
                b = big.slice(at, pages.PAGES_PER_BATCH)
                f, flat = pages.forest(b.column(1))
                rows = pages.line_rows(f)
                text = flat.field("w").take(pa.array(f.take[rows])).to_pylist()
                h = np.fromiter((memo[t] for t in text), np.int64, len(text))
                offsets = np.searchsorted(f.page[rows], np.arange(f.pages + 1))
                plain = pa.array([" ".join(t.split()) for t in text], pa.string())
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), _lists(offsets, pa.array(h)), _lists(offsets, plain)], names=["content_id", "site", "h", "t"])

    def left(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            of, _, _, _, there, _ = _occurrences(b)
            texts: list[list[str]] = [[] for _ in range(len(b))]
            at = np.flatnonzero(~there)
            for p, t in zip(of[at].tolist(), b.column(6).flatten().take(pa.array(at)).to_pylist()):
                texts[p].append(t)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(["\n".join(t) for t in texts], pa.string())], names=["content_id", "site", "text"])

    gathered = pages.whole_pages(elements).join(sites, "content_id", "left").select("content_id", "e", "site")
    contents = written(gathered.mapInArrow(run, "content_id string, site string, h array<bigint>, t array<string>"), "site-texts")
    met = with_site(contents, blocks(contents.where("site IS NOT NULL")), "left").select("content_id", "site", F.col("h").alias("node"), "h", "words", "block", "t")
    return met.mapInArrow(left, "content_id string, site string, text string")
