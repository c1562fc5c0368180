"""Pages of keywords, links or tags in place of sentences.

Words and neighbouring pairs are counted over all main bodies. The pointwise mutual information of neighbouring words is
taken from what the rest of the corpus says of them: the page's own occurrences are left out. Its mean over a line tells
sentences from word salad. Among lines whose pairs the page repeats again and again it tells prose with a refrain from
stuffed collocations; there the occurrences in bodies that repeat the pair are left out too, so that no campaign can
raise them. A page is a case if most of
its body is salad, stuffed or bare links.

Frequent words and pairs are broadcast, up to a number that does not grow with the corpus; the counts of all others reach
the pages that hold them by a shuffle join. No count is dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnlake.llm import residue
from cairnlake.llm.kinds import CELLS, LINKS
from cairnlake.llm.pages import HEADINGS, PAGES_PER_BATCH
from cairnlake.llm.words import OF_SITE, REPEATS, SKIPPED, Counts, mixed, neighbours, ranges
from cairnlake.session import written

#: Words and pairs from this share of all words are broadcast: at most its inverse of each, whatever the corpus.
BROADCAST_SHARE = 1e-6
#: A line of so many pairs whose mean PMI is lower is word salad.
SALAD_PAIRS, SALAD_PMI = 8, 1.0
#: Salad counts where, with all else that is bad, it makes up so much of the body: a list among sentences is no case.
SALAD_SHARE = 0.8
#: A pair that stands so many times as often in a page as in bodies that do not repeat it is repeated; one found nowhere else counts as two.
LIFT, LEAST_ELSEWHERE = 200.0, 2
#: A line with this share of repeated pairs may be stuffed ...
STUFFED_SHARE = 0.25
#: ... and is if the mean PMI of such lines is below that of prose.
PROSE_PMI = 2.6
#: Lines of fewer words are judged together with those next to them.
SHORT_WORDS = 4
#: Share of the body's characters from which the page is a case.
SPAM_SHARE = 0.5


def counted(bodies: DataFrame) -> DataFrame:
    """``k, n, quiet, is_word``: the counts of words and neighbouring pairs over all main bodies, combined before the
    shuffle; ``quiet`` are the occurrences of a pair in bodies that do not repeat it."""
    return bodies.select(F.inline("tally")).groupBy("k").agg(F.sum("n").alias("n"), F.sum("quiet").alias("quiet"), F.bool_or("is_word").alias("is_word"))


class Table:
    """Counts by key, as sorted arrays."""

    def __init__(self, k: np.ndarray, n: np.ndarray, quiet: np.ndarray):
        self.k, at = np.unique(k, return_index=True)
        self.n, self.quiet = n[at], quiet[at]

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place of each key, and whether it is there."""
        if not len(self.k):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(self.k, keys), len(self.k) - 1)
        return at, self.k[at] == keys


class Association:
    """What the rest of the corpus has of the words and pairs of a batch of pages: ``frequent`` is the broadcast table,
    ``rare`` holds the other keys of the batch that stand elsewhere, ``own`` what each page has itself."""

    def __init__(self, frequent: Table, rare: Table, own: Counts, total: float):
        self.tables, self.total = (frequent, rare), max(total, 1.0)
        key = mixed(own.page.astype(np.uint64), own.k)
        self.own = Table(key, own.n, own.quiet)

    def elsewhere(self, page: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How often each key stands on other pages, and how often where it is not repeated."""
        n, quiet = np.zeros(len(keys)), np.zeros(len(keys))
        for t in self.tables:
            at, there = t.find(keys)
            if there.any():
                n[there], quiet[there] = t.n[at[there]], t.quiet[at[there]]
        at, there = self.own.find(mixed(page.astype(np.uint64), keys))
        if there.any():
            n[there] -= self.own.n[at[there]]
            quiet[there] -= self.own.quiet[at[there]]
        return np.maximum(n, 0), np.maximum(quiet, 0)

    def pmi(self, page: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The PMI of each pair, discounted where few occurrences speak for it and 0 where none does: from all other
        occurrences, and from those in bodies that do not repeat the pair."""
        ca, cb = self.elsewhere(page, a)[0], self.elsewhere(page, b)[0]
        out = []
        for both in self.elsewhere(page, mixed(a, b)):
            with np.errstate(divide="ignore", invalid="ignore"):
                value = np.log(both * self.total / (np.maximum(ca, 1) * np.maximum(cb, 1))) * both / (both + 1)
            out.append(np.where(both > 0, np.maximum(value, 0), 0.0))
        return out[0], out[1]


def _measured(n_pages: int, rows: np.ndarray, page: np.ndarray, tag: np.ndarray, kind: np.ndarray, lines: dict[str, np.ndarray], used: np.ndarray, model: Association) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each page: the share of the characters of ``rows`` in bad lines, the mean PMI, and the share of repeated pairs."""
    page, tag, size = page[rows], tag[rows], lines["size"][rows].astype(float)
    count, h = lines["n_words"][rows], lines["h"][rows]
    start = (np.cumsum(lines["n_words"]) - lines["n_words"])[rows]
    link = np.isin(tag, LINKS)
    short = ~link & (count < SHORT_WORDS)
    # Neighbouring short lines are one unit, every other line is one by itself.
    joined = np.concatenate([[False], short[1:] & short[:-1] & (page[1:] == page[:-1])]) if len(rows) else np.zeros(0, bool)
    unit = np.cumsum(~joined) - 1
    n_units = int(unit[-1]) + 1 if len(unit) else 0
    text = np.flatnonzero(~link)
    w = used[ranges(start[text], count[text])]
    of = np.repeat(text, count[text])
    a, b, at = neighbours(unit[of], w)
    pair_page, pair_unit, pair_line = page[of[at]], unit[of[at]], of[at]
    key = mixed(a, b)
    # How often the page has each pair in different lines.
    first = np.zeros(len(rows), bool)
    first[np.unique(mixed(page.astype(np.uint64), h.view(np.uint64)), return_index=True)[1]] = True
    local = mixed(pair_page.astype(np.uint64), key)
    names, back = np.unique(local, return_inverse=True)
    once = first[pair_line]
    n = np.bincount(back[once], minlength=len(names))[back]
    pairs = np.bincount(pair_page[once], minlength=n_pages)
    quiet = model.elsewhere(pair_page, key)[1]
    often = (n >= REPEATS) & (n * model.total >= LIFT * pairs[pair_page] * np.maximum(quiet, LEAST_ELSEWHERE))
    pmi, quiet_pmi = model.pmi(pair_page, a, b)
    in_unit = np.bincount(pair_unit, minlength=n_units)
    with np.errstate(divide="ignore", invalid="ignore"):
        rep = np.where(in_unit >= 3, np.bincount(pair_unit, often, n_units) / in_unit, 0.0)
        mean = np.where(in_unit > 0, np.bincount(pair_unit, pmi, n_units) / in_unit, 0.0)
    unit_page = np.zeros(n_units, np.int64)
    unit_page[unit] = page
    # Lines with many repeated pairs are stuffed unless they read like prose, all of the page's taken together.
    may = rep >= STUFFED_SHARE
    of_may = may[pair_unit]
    weight = np.bincount(pair_page[of_may], minlength=n_pages)
    stuffed_pmi = np.bincount(pair_page[of_may], quiet_pmi[of_may], n_pages) / np.maximum(weight, 1)
    bad = may & (stuffed_pmi[unit_page] < PROSE_PMI)
    # What the site repeats is not counted, and cells are no sentences: neither can be salad.
    other = np.zeros(n_units, bool)
    other[unit[np.isin(kind[rows], OF_SITE) | np.isin(tag, CELLS)]] = True
    salad = bad | ~other & (in_unit >= SALAD_PAIRS) & (mean < SALAD_PMI)
    total = np.maximum(np.bincount(page, size, n_pages), 1)
    share, with_salad = (np.bincount(page, np.where(link | x[unit], size, 0.0), n_pages) / total for x in (bad, salad))
    share = np.where(with_salad >= SALAD_SHARE, with_salad, share)
    every = np.maximum(np.bincount(pair_page, minlength=n_pages), 1)
    return share, np.bincount(pair_page, pmi, n_pages) / every, np.bincount(pair_page, often, n_pages) / every


def spam_shares(n_pages: int, page: np.ndarray, tag: np.ndarray, kind: np.ndarray, lines: dict[str, np.ndarray], used: np.ndarray, model: Association) -> list[np.ndarray]:
    """Of each page the share of its body in salad, stuffed lines and bare links, the mean PMI and the repeated share.

    They are those of the page's own lines or, if the share is larger, of all lines but the links the site repeats.
    """
    said = (lines["size"] > 0) & ~np.isin(tag, HEADINGS) & ~np.isin(kind, SKIPPED)
    of_site = np.isin(kind, OF_SITE)
    found = [_measured(n_pages, np.flatnonzero(m), page, tag, kind, lines, used, model) for m in (said & ~of_site, said & (~of_site | ~np.isin(tag, LINKS)))]
    larger = found[1][0] > found[0][0]
    return [np.where(larger, y, x) for x, y in zip(*found)]


def _flat(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, dict[str, np.ndarray], np.ndarray]:
    """Page, tag and kind of each line of a batch of bodies, its columns, and all words."""
    col = {n: b.column(i) for i, n in enumerate(b.schema.names)}
    sizes = np.diff(col["kind"].offsets.to_numpy())
    page = np.repeat(np.arange(len(b)), sizes)
    flat = {n: col[n].flatten().to_numpy(zero_copy_only=False) for n in ("kind", "h", "size", "n_words")}
    tag = np.array(col["tag"].flatten().to_pylist(), str) if len(page) else np.zeros(0, str)
    return page, tag, flat.pop("kind"), flat, col["words"].flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)


def _pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for big in batches:
        for at in range(0, len(big), PAGES_PER_BATCH):
            yield big.slice(at, PAGES_PER_BATCH)


_COLUMNS = ("content_id", "tag", "kind", "h", "size", "n_words", "words")


def scores(bodies: DataFrame) -> DataFrame:
    """``content_id, spam, mean_pmi, repeated`` of each main body; contents without lines have zeros."""
    sc = bodies.sparkSession.sparkContext
    counts = written(counted(bodies), "pair-counts")
    total = float(counts.where("is_word").agg(F.sum("n")).first()[0] or 0)
    floor = total * BROADCAST_SHARE
    # Their number is bounded: all words together have the count ``total``, all pairs less.
    t = counts.where(F.col("n") >= floor).select("k", "n", "quiet").toArrow()
    frequent = sc.broadcast(Table(t.column(0).to_numpy().view(np.uint64), t.column(1).to_numpy(), t.column(2).to_numpy()))
    slim = bodies.select(*_COLUMNS)

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _pages(batches):
            page, _, kind, lines, used = _flat(b)
            own = Counts(len(b), page, kind, lines, used)
            other = ~frequent.value.find(own.k)[1]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(own.page[other])), pa.array(own.k[other].view(np.int64))], names=["content_id", "k"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _pages(batches):
            page, tag, kind, lines, used = _flat(b)
            rare = b.column(len(_COLUMNS)).flatten()
            table = Table(rare.field(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64), *(rare.field(i).to_numpy(zero_copy_only=False) for i in (1, 2)))
            model = Association(frequent.value, table, Counts(len(b), page, kind, lines, used), total)
            columns = [pa.array(x) for x in spam_shares(len(b), page, tag, kind, lines, used, model)]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], names=["content_id", "spam", "mean_pmi", "repeated"])

    # A key found once in the corpus is the page's own, so the rest of the corpus has nothing of it.
    rare = counts.where((F.col("n") > 1) & (F.col("n") < floor)).select("k", "n", "quiet")
    keys = slim.mapInArrow(asked, "content_id string, k bigint")
    looked = keys.join(rare, "k").groupBy("content_id").agg(F.collect_list(F.struct("k", "n", "quiet")).alias("rare"))
    none = F.array().cast("array<struct<k:bigint,n:bigint,quiet:bigint>>")
    if floor > 2:
        slim = slim.join(looked, "content_id", "left").withColumn("rare", F.coalesce("rare", none))
    else:  # every key found twice is frequent
        slim = slim.withColumn("rare", none)
    return slim.mapInArrow(run, "content_id string, spam double, mean_pmi double, repeated double")


def stuffed_contents(bodies: DataFrame) -> DataFrame:
    """``content_id`` of the contents whose main body is mostly keywords, links or tags, residue among them."""
    return scores(bodies).where(F.col("spam") >= SPAM_SHARE).select("content_id").distinct()


def found_contents(bodies: DataFrame) -> DataFrame:
    """``stuffed_contents`` without the pages that are template residue, filler or notices: those repeat words too."""
    return stuffed_contents(bodies).join(residue.found(bodies), "content_id", "left_anti")


def found(bodies: DataFrame, capture: DataFrame) -> DataFrame:
    """``capture_id`` of the captures of such contents; null ids are left out, repeated captures come once."""
    captures = capture.where("capture_id IS NOT NULL").select("capture_id", "content_id")
    return captures.join(found_contents(bodies), "content_id", "left_semi").select("capture_id").distinct()
