"""Encoding of texts by a public byte-level BPE vocabulary.

Two tiers: a minimal perfect hash (hash and displace) resolves every pre-token that is a vocabulary entry as a whole;
a pre-token that is none is merged by a heap over its linked bytes. Both tiers stand behind a per-process memo of
pre-tokens, so each distinct pre-token is worked out once a task, however often it occurs.
"""

from __future__ import annotations

import base64
import heapq
import itertools
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession

#: Folder of the public tokenizers' files; a parameter of every operator here.
TOKENIZER_DIR = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Fixed value: the published pattern that splits text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Distinct pre-tokens remembered by a process before the memo is emptied (a bound on memory, not on results).
MEMO = 400_000

_MASK = (1 << 64) - 1
_ODD = 0x9E3779B97F4A7C15


class PerfectHash:
    """A minimal perfect hash over byte strings: ``n`` keys on ``n`` slots, built by hash and displace.

    Keys fall into about ``n / 1.5`` buckets. From the largest bucket on, a displacement is sought that sends all keys
    of the bucket to free slots; buckets of one key are given a free slot outright (a negative displacement).
    """

    def __init__(self, keys: list[bytes], values: list[int]):
        n = len(keys)
        self.n, self.buckets = n, max(1, int(n / 1.5))
        members: list[list[int]] = [[] for _ in range(self.buckets)]
        hashes = [xxhash.xxh64_intdigest(k) for k in keys]
        for i, h in enumerate(hashes):
            members[h % self.buckets].append(i)
        self.shift, self.keys, self.values = [0] * self.buckets, [b""] * n, [0] * n
        taken, place = bytearray(n), [0] * n
        order = sorted((b for b in range(self.buckets) if members[b]), key=lambda b: -len(members[b]))
        for b in order:
            own = members[b]
            if len(own) == 1:
                break
            d = 1
            while True:
                slots = [self._slot(hashes[i], d) for i in own]
                if not any(taken[s] for s in slots) and len(set(slots)) == len(slots):
                    break
                d += 1
            self.shift[b] = d
            for i, s in zip(own, slots):
                taken[s], place[i] = 1, s
        free = iter([s for s in range(n) if not taken[s]])
        for b in order:
            if len(members[b]) == 1:
                s = next(free)
                self.shift[b], place[members[b][0]] = -s - 1, s
        for i, s in enumerate(place):
            self.keys[s], self.values[s] = keys[i], values[i]

    def _slot(self, h: int, d: int) -> int:
        return ((((h ^ (d * _ODD & _MASK)) * 0xC2B2AE3D27D4EB4F) & _MASK) >> 29) % self.n

    def get(self, key: bytes) -> int | None:
        """The value of ``key``; None for a byte string that is no key (the stored key is compared)."""
        if not self.n:
            return None
        h = xxhash.xxh64_intdigest(key)
        d = self.shift[h % self.buckets]
        s = -d - 1 if d < 0 else self._slot(h, d)
        return self.values[s] if self.keys[s] == key else None


def merge_bytes(data: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Byte-pair merges in order of rank, leftmost first, by a heap over a doubly linked list of spans."""
    n = len(data)
    end = list(range(1, n + 1))
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    alive = [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(data[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = after[i] if alive[i] else n
        if j >= n or end[j] != stop or not alive[i]:
            continue
        alive[j] = False
        end[i], after[i] = stop, after[j]
        if after[i] < n:
            before[after[i]] = i
            if (r := ranks.get(data[i : end[after[i]]])) is not None:
                heapq.heappush(heap, (r, i, end[after[i]]))
        if (p := before[i]) >= 0 and (r := ranks.get(data[p:stop])) is not None:
            heapq.heappush(heap, (r, p, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[data[i : end[i]]])
        i = after[i]
    return out


class Encoder(dict):
    """Pre-token (text) to tuple of ids; a missing pre-token goes through the two tiers."""

    def __init__(self, ranks: dict[bytes, int], whole: PerfectHash):
        super().__init__()
        self.ranks, self.whole, self.split = ranks, whole, regex.compile(PATTERN).findall

    @classmethod
    def load(cls, path: str) -> Encoder:
        """The encoder of a rank file."""
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
        # An entry that its own merges do not lead to is left to the heap.
        whole = [k for k in ranks if len(k) <= 2 or merge_bytes(k, ranks) == [ranks[k]]]
        return cls(ranks, PerfectHash(whole, [ranks[k] for k in whole]))

    def __missing__(self, token: str) -> tuple[int, ...]:
        data = token.encode("utf-8", "surrogatepass")
        known = self.whole.get(data)
        ids = (known,) if known is not None else tuple(merge_bytes(data, self.ranks))
        if len(self) >= MEMO:
            self.clear()
        self[token] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        """The ids of ``text`` without special tokens; [] for a null or empty text."""
        return list(itertools.chain.from_iterable(map(self.__getitem__, self.split(text)))) if text else []

    def count(self, text: str | None) -> int:
        """The number of ids of ``text``."""
        return sum(map(len, map(self.__getitem__, self.split(text)))) if text else 0


_ENCODERS: dict[str, Encoder] = {}


def encoder(directory: str = TOKENIZER_DIR, vocabulary: str = VOCABULARY) -> Encoder:
    """The process's encoder of a rank file, built at its first use."""
    path = os.path.join(directory, vocabulary)
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder.load(path)
    return _ENCODERS[path]


def _shared(spark: SparkSession, directory: str, vocabulary: str) -> Callable[[], Encoder]:
    """Ships the two tiers, built once on the driver, to the tasks. Their size is that of the vocabulary, not of data."""
    e, path = encoder(directory, vocabulary), os.path.join(directory, vocabulary)
    tiers = spark.sparkContext.broadcast((e.ranks, e.whole))

    def get() -> Encoder:
        if path not in _ENCODERS:
            _ENCODERS[path] = Encoder(*tiers.value)
        return _ENCODERS[path]

    return get


def encode(documents: DataFrame, directory: str = TOKENIZER_DIR, vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc_id bigint, ids array<int>``: the token ids of every document.

    Null and empty texts have the empty list; the strings of special tokens are ordinary text; a null ``doc_id`` is
    kept, repeated rows stay repeated. Only ``doc_id`` and ``text`` are read. It is one narrow pass over the scan's
    own partitions: nothing is shuffled, and Arrow batches carry the rows. An empty table gives no rows.
    """

    get = _shared(documents.sparkSession, directory, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = get()
        for b in batches:
            lists = [e.encode(t) for t in b.column(1).to_pylist()]
            offsets = np.zeros(len(lists) + 1, np.int32)
            np.cumsum([len(x) for x in lists], out=offsets[1:])
            flat = np.fromiter(itertools.chain.from_iterable(lists), np.int32, int(offsets[-1]))
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
            yield pa.RecordBatch.from_arrays([b.column(0), ids], names=["doc_id", "ids"])

    slim = documents.selectExpr("cast(doc_id AS bigint) AS doc_id", "text")
    return slim.mapInArrow(run, "doc_id bigint, ids array<int>")


def sizes(documents: DataFrame, directory: str = TOKENIZER_DIR, vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc_id bigint, n_tokens int``: the number of ids of every document (0 for null and empty texts)."""

    get = _shared(documents.sparkSession, directory, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = get()
        for b in batches:
            n = pa.array([e.count(t) for t in b.column(1).to_pylist()], pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), n], names=["doc_id", "n_tokens"])

    slim = documents.selectExpr("cast(doc_id AS bigint) AS doc_id", "text")
    return slim.mapInArrow(run, "doc_id bigint, n_tokens int")
