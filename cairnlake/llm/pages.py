"""Captured pages as one row per content, and the vectorised analysis of their element trees.

``whole_pages`` brings the elements of each content together with a combining aggregate: copies of a content that was
stored many times are dropped before the shuffle, so what meets in a task is one page, whose size the capture bounds.
The analysis then runs over Arrow batches of pages; every step is a prefix sum or a search over flat arrays, none is
a loop over elements.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Pages in one Arrow batch.
PAGES_PER_BATCH = 400
#: A character other than white space, the no-break kinds included.
SOLID = r"[^\s\p{Z}\u001c-\u001f\u0085]"


def site_of(url: Column) -> Column:
    """The host of a URL in lower case, without credentials and port; null where there is none."""
    host = F.lower(F.regexp_extract(url, r"^\s*[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^:/?#]+)", 1))
    return F.when(host != "", host)


def content_sites(capture: DataFrame) -> DataFrame:
    """``content_id, site`` of each content and host it was captured at; one row per pair."""
    pairs = capture.select("content_id", site_of(F.col("page_url")).alias("site"))
    return pairs.where("content_id IS NOT NULL AND site IS NOT NULL").distinct()


def content_pages(capture: DataFrame) -> DataFrame:
    """``content_id, site, page`` of each content and host: ``page`` is a hash of its address without query and
    fragment, the least where it has several. Contents of one address are one page that was captured again."""
    address = F.xxhash64(F.lower(F.regexp_replace(F.regexp_replace("page_url", r"[?#].*$", ""), r"/+\s*$", "")))
    pairs = capture.select("content_id", site_of(F.col("page_url")).alias("site"), address.alias("page"))
    return pairs.where("content_id IS NOT NULL AND site IS NOT NULL").groupBy("content_id", "site").agg(F.min("page").alias("page"))


def whole_pages(elements: DataFrame) -> DataFrame:
    """``content_id`` and ``e``, the array of the distinct elements of each content, in no order.

    An element carries ``i`` (node_index), ``p`` (parent or -1), ``x`` (end of the subtree), ``t`` (tag), ``o``
    (length of its own text, 0 where that is blank or the tag is script or style) and ``w``, the text of its subtree,
    where ``o`` is not 0. Rows without content_id, node_index or subtree end are left out; a null text counts as
    empty. Other columns, whatever their names, are not read.
    """
    tag = F.lower(F.coalesce(F.col("tag"), F.lit("")))
    direct = F.coalesce(F.col("text_direct"), F.lit(""))
    own = F.when(tag.isin("script", "style") | ~direct.rlike(SOLID), 0).otherwise(F.length(F.trim(direct)))
    rows = elements.where("content_id IS NOT NULL AND node_index IS NOT NULL AND subtree_end_index IS NOT NULL").select(
        "content_id", "node_index", "parent_index", "subtree_end_index", tag.alias("t"), own.alias("o"), F.col("text").alias("w")
    )
    element = F.struct(
        F.col("node_index").alias("i"), F.coalesce("parent_index", F.lit(-1)).alias("p"), F.col("subtree_end_index").alias("x"),
        "t", "o", F.when((F.col("o") > 0) | (F.col("t") == "title"), F.coalesce("w", F.lit(""))).alias("w"),
    )
    return rows.groupBy("content_id").agg(F.collect_set(element).alias("e"))


@dataclass
class Forest:
    """The elements of a batch of pages in document order, page after page, as flat arrays."""

    page: np.ndarray
    node: np.ndarray
    up: np.ndarray  # row of the parent, -1 at a root
    stop: np.ndarray  # row after the last one of the subtree
    tag: np.ndarray
    tags: list[str]
    own: np.ndarray
    take: np.ndarray  # place of each row in the Arrow columns
    pages: int

    def inside(self, marks: np.ndarray) -> np.ndarray:
        """Rows that lie in the subtree of a marked row, the marked row itself included."""
        d = np.zeros(len(self.page) + 1, np.int64)
        at = np.flatnonzero(marks)
        np.add.at(d, at, 1)
        np.add.at(d, self.stop[at], -1)
        return d[:-1].cumsum() > 0

    def sums(self, values: np.ndarray) -> np.ndarray:
        """The sum of ``values`` over each row's subtree."""
        c = np.concatenate([[0], np.cumsum(values)])
        return c[self.stop] - c[np.arange(len(values))]

    def is_tag(self, *names: str) -> np.ndarray:
        return np.isin(self.tag, [k for k, t in enumerate(self.tags) if t in names])


def forest(lists: pa.ListArray) -> tuple[Forest, pa.StructArray]:
    """Sorts the elements of each page and links parents and subtree ends; of a repeated node one row stays."""
    flat = lists.flatten()
    sizes = np.diff(lists.offsets.to_numpy())
    page = np.repeat(np.arange(len(lists)), sizes)
    node, parent, end = (flat.field(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in "ipx")
    key = (page << 33) + node
    order = np.argsort(key, kind="stable")
    first = np.concatenate([[True], np.diff(key[order]) > 0]) if len(order) else np.zeros(0, bool)
    order = order[first]
    key, page, node = key[order], page[order], node[order]
    stop = np.searchsorted(key, (page << 33) + np.maximum(end[order], node + 1))
    wanted = (page << 33) + parent[order]
    up = np.searchsorted(key, wanted)
    known = (parent[order] >= 0) & (up < len(key))
    known[known] = key[up[known]] == wanted[known]
    up = np.where(known & (up < np.arange(len(key))), up, -1)
    tag = pc.dictionary_encode(flat.field("t").take(pa.array(order)))
    codes = tag.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    own = flat.field("o").to_numpy(zero_copy_only=False)[order].astype(np.int64)
    return Forest(page, node, up, stop, codes, tag.dictionary.to_pylist(), own, order, len(lists)), flat


def line_rows(f: Forest) -> np.ndarray:
    """Rows that are lines: below body, with text of their own, inside no other such row."""
    body = f.inside(f.is_tag("body")) & ~f.is_tag("body")
    texts = body & (f.own > 0)
    d = np.zeros(len(f.page) + 1, np.int64)
    at = np.flatnonzero(texts)
    np.add.at(d, at, 1)
    np.add.at(d, f.stop[at], -1)
    depth = d[:-1].cumsum()
    return np.flatnonzero(texts & (depth == 1))


#: Tags whose text is a heading.
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
#: Characters a first-level heading counts for besides its own.
HEADLINE_WEIGHT = 300.0
#: Characters besides the headline by which its container speaks for itself.
OPENED_CHARACTERS = 40


def main_body(f: Forest, noise: np.ndarray, title: np.ndarray) -> np.ndarray:
    """The row of each page's main body, -1 for a page without one.

    Composite text density: every node has the characters of its subtree that stand in lines which are no noise,
    divided by its tags and adjusted by the share of links among both; a node's density sum is that of its children.
    The largest sum below body marks the body of the text. The least density on the path from there up to the page's
    body is the threshold; the subtree is widened to the nearest ancestor with the headline as long as the ancestor's
    density stays at or above it. ``noise`` marks line rows to be counted as links, ``title`` rows that repeat the
    page's title.
    """
    n = len(f.page)
    best = np.full(f.pages, -1)
    if not n:
        return best
    quiet = f.inside(noise)
    link = f.inside(f.is_tag("a", "button", "nav"))
    body_rows = f.is_tag("body")
    under = f.inside(body_rows) & ~body_rows
    head = f.inside(f.is_tag("h1")) | f.inside(title)
    clean = np.where(under & ~quiet, f.own, 0).astype(float)
    chars, linked = f.sums(clean), f.sums(np.where(link, clean, 0))
    # A headline outside of links speaks for the container it opens.
    lead = np.where((f.is_tag("h1") | title) & under & ~link & ~quiet, HEADLINE_WEIGHT, 0.0)
    tags = (f.stop - np.arange(n)).astype(float)
    linktags = f.sums((f.is_tag("a", "button") & under).astype(float))
    plain = np.maximum(chars - linked, 0)
    with np.errstate(divide="ignore", invalid="ignore"):
        adjust = np.where(chars > 0, plain / np.maximum(chars, 1), 0) * (1 - linktags / (tags + 1)) ** 0.5
    density = np.where(chars > 0, chars / tags * adjust, 0) + lead
    kids = f.up >= 0
    total = np.bincount(f.up[kids], density[kids], n)
    total[~(under | body_rows)] = -1
    # The last of the rows with a page's greatest sum: the deepest where they are equal on a path.
    rank = np.lexsort((np.arange(n), total, f.page))
    last = np.flatnonzero(np.concatenate([np.diff(f.page[rank]) > 0, [True]]))
    best[f.page[rank[last]]] = rank[last]
    best[total[np.maximum(best, 0)] <= 0] = -1
    # Threshold on the path, and the first headline of each page.
    path, least = best.copy(), np.full(f.pages, np.inf)
    while (path >= 0).any():
        ok = path >= 0
        least[ok] = np.minimum(least[ok], density[path[ok]])
        path = np.where(ok, f.up[np.maximum(path, 0)], -1)
        path[(path >= 0) & body_rows[np.maximum(path, 0)]] = -1
    heads = np.flatnonzero(head & under & ~link & (lead > 0))
    first = np.full(f.pages, -1)
    first[f.page[heads][::-1]] = heads[::-1]
    wide, out = best.copy(), best.copy()
    while True:  # one level each, up to the depth of the page
        w = np.maximum(wide, 0)
        lacks = (wide >= 0) & (first >= 0) & ~((first >= w) & (first < f.stop[w]))
        if not lacks.any():
            break
        wide = np.where(lacks, f.up[w], wide)
        good = lacks & (wide >= 0)
        good[good] = ~body_rows[wide[good]] & (density[wide[good]] >= least[good])
        wide = np.where(lacks & ~good, -1, wide)
    # Where the headline opens a container with more to it than itself, that container is the body.
    opened = np.where(first >= 0, f.up[np.maximum(first, 0)], -1)
    o, w = np.maximum(opened, 0), np.maximum(best, 0)
    apart = (opened >= 0) & (best >= 0) & ~((first >= w) & (first < f.stop[w])) & ~body_rows[o]
    apart &= chars[o] - f.own[np.maximum(first, 0)] >= np.minimum(0.5 * chars[w], OPENED_CHARACTERS)
    wide = np.where(apart, opened, wide)
    has = (wide >= 0) & (first >= 0)
    out[has] = wide[has]
    return out
