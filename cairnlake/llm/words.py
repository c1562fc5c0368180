"""Words and neighbouring pairs of bodies as hashes, over flat arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from cairnlake.llm.kinds import BEFORE, DATE, NOTICE, REPEATED, SHARE

#: A pair that stands so often in a body is repeated there ...
REPEATS = 3
#: ... and for the comparison with other bodies only if it is also this share of the body's pairs.
DENSE_SHARE = 0.02
#: Kinds of lines that are no text of the page, and those that its site repeats.
SKIPPED, OF_SITE = (DATE, SHARE, BEFORE), (REPEATED, NOTICE)

COUNT = "struct<k:bigint,n:bigint,quiet:bigint,is_word:boolean>"


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One 64-bit hash of two."""
    with np.errstate(over="ignore"):
        x = a * np.uint64(0x9E3779B97F4A7C15) ^ (b + np.uint64(0x632BE59BD9B4E019))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(27))


def ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """``start, start + 1, ...`` for ``size`` places each, one after another."""
    size = size.astype(np.int64)
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - size, size) + np.repeat(start, size)


def neighbours(of: np.ndarray, used: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs of words of one line (``of`` names each word's line): first and second word, and the pair's place."""
    at = np.flatnonzero(of[1:] == of[:-1]) if len(of) else np.zeros(0, np.int64)
    return used[at], used[at + 1], at


def own_lines(page: np.ndarray, kind: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Rows of the lines that are counted: the page's own, each wording once a page."""
    rows = np.flatnonzero(~np.isin(kind, SKIPPED + OF_SITE))
    key = mixed(page[rows].astype(np.uint64), h[rows].view(np.uint64))
    return rows[np.sort(np.unique(key, return_index=True)[1])]


class Counts:
    """The words and pairs of each page of a batch: ``page`` and key, how often the page has it, and how often in a way
    that does not repeat it (``quiet``, always 0 for words). Sorted by page and key; words and pairs share one space of keys."""

    def __init__(self, n_pages: int, page: np.ndarray, kind: np.ndarray, lines: dict[str, np.ndarray], used: np.ndarray):
        rows = own_lines(page, kind, lines["h"])
        sizes = lines["n_words"][rows]
        ends = np.cumsum(lines["n_words"])
        w = used[ranges((ends - lines["n_words"])[rows], sizes)] if len(rows) else np.zeros(0, np.uint64)
        of = np.repeat(rows, sizes)
        a, b, at = neighbours(of, w)
        keys = np.concatenate([w, mixed(a, b)])
        pages = np.concatenate([page[of], page[of[at]]]).astype(np.int64)
        order = np.lexsort((keys, pages))
        k, p, word = keys[order], pages[order], (order < len(w))
        first = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (p[1:] != p[:-1])])) if len(k) else np.zeros(0, np.int64)
        self.n = np.diff(np.concatenate([first, [len(k)]])) if len(k) else np.zeros(0, np.int64)
        self.k, self.page, self.is_word = k[first], p[first], word[first]
        pairs = np.bincount(page[of[at]], minlength=n_pages) if len(at) else np.zeros(n_pages, np.int64)
        repeated = (self.n >= REPEATS) & (self.n >= DENSE_SHARE * pairs[self.page])
        self.quiet = np.where(self.is_word | repeated, 0, self.n)
        self.pairs = pairs


def tally(n_pages: int, page: np.ndarray, kind: np.ndarray, lines: dict[str, np.ndarray], used: np.ndarray) -> pa.Array:
    """The counts of all pages of a batch together, as a list that stands with its first page."""
    c = Counts(n_pages, page, kind, lines, used)
    k, back = np.unique(c.k, return_inverse=True)
    n, quiet = (np.bincount(back, x, len(k)).astype(np.int64) for x in (c.n, c.quiet))
    is_word = np.zeros(len(k), bool)
    is_word[back[c.is_word]] = True
    offsets = np.concatenate([[0], np.full(n_pages, len(k))]).astype(np.int32)
    struct = pa.StructArray.from_arrays([pa.array(k.view(np.int64)), pa.array(n), pa.array(quiet), pa.array(is_word)], names=["k", "n", "quiet", "is_word"])
    return pa.ListArray.from_arrays(pa.array(offsets), struct)
