import random

import pytest

from cairnlake.llm import packing, tokens

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def library():
    t = tokenizers.Tokenizer.from_file(f"{tokens.TOKENIZER_DIR}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


def texts():
    rng = random.Random(3)
    pool = [chr(c) for c in (*range(0, 0x250), *range(0x2000, 0x2070), *range(0x3040, 0x30A0), 0x1F600, 0xFEFF, 0x85, 0x301)]
    made = ["".join(rng.choice(pool if rng.random() < 0.5 else " \n\t'sab1") for _ in range(rng.randint(0, 40))) for _ in range(1500)]
    return ["<|endoftext|> x", "don't  we'LL\r\n 12345 ", "a" * 5000, " " * 300, "漢字かな交じり文", *made]


def test_ids_are_the_librarys(library):
    e = tokens.encoder()
    for t in texts():
        assert e.encode(t) == library(t), repr(t[:60])
        assert e.count(t) == len(e.encode(t))


def test_perfect_hash_is_minimal_and_exact():
    keys = [f"k{i}".encode() for i in range(3000)]
    h = tokens.PerfectHash(keys, list(range(3000)))
    assert [h.get(k) for k in keys] == list(range(3000)) and len(h.keys) == 3000
    assert h.get(b"other") is None and h.get(b"") is None
    assert tokens.PerfectHash([], []).get(b"x") is None and tokens.PerfectHash([b"a"], [7]).get(b"a") == 7


def test_heap_agrees_with_plain_merging():
    ranks = {bytes([i]): i for i in range(256)} | {b"ab": 256, b"bc": 257, b"abc": 258, b"aa": 259, b"aaaa": 260}

    def plain(data):
        parts = [data[i : i + 1] for i in range(len(data))]
        while True:
            best = min(((ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks), default=None)
            if best is None:
                return [ranks[p] for p in parts]
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    rng = random.Random(1)
    for _ in range(2000):
        data = bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 14)))
        assert tokens.merge_bytes(data, ranks) == plain(data), data


def test_null_empty_repeated_and_clashing(spark, library):
    df = spark.createDataFrame([(1, None), (2, ""), (3, " "), (None, "x y"), (4, "hi"), (4, "hi")], "doc_id bigint, text string").selectExpr("*", "'c' AS ids")
    got = [(r.doc_id, list(r.ids)) for r in tokens.encode(df).collect()]
    assert got == [(1, []), (2, []), (3, library(" ")), (None, library("x y")), (4, library("hi")), (4, library("hi"))]
    assert tokens.encode(df.limit(0)).count() == 0


def test_best_fill_is_optimal():
    rng = random.Random(5)
    for _ in range(200):
        counts = {rng.randint(1, 30): rng.randint(1, 3) for _ in range(rng.randint(1, 5))}
        room = rng.randint(0, 60)
        sums = {0}
        for k, n in counts.items():
            sums = {s + k * j for s in sums for j in range(n + 1)}
        chosen = packing.best_fill(counts, room)
        assert sum(k * n for k, n in chosen.items()) == max(s for s in sums if s <= room)
        assert all(n <= counts[k] for k, n in chosen.items())


def test_solution_places_every_item_once():
    rng = random.Random(6)
    counts = {rng.randint(1, 2048): rng.randint(1, 500) for _ in range(300)}
    rows, n = packing.solution(counts)
    fill, seen = [0] * n, dict.fromkeys(counts, 0)
    for length, lo, hi, per, first in rows:
        assert lo == seen[length]
        seen[length] = hi
        for r in range(lo, hi):
            fill[first + (r - lo) // per] += length
    assert seen == counts and max(fill) <= 2048
    assert n <= -(-sum(k * v for k, v in counts.items()) // 2048) * 1.02 + 2
    assert packing.solution({}) == ([], 0)


def test_pack(spark, library):
    data = [(i, " ".join(["word"] * (i * 37 % 900))) for i in range(400)] + [(400, " a" * 5000), (401, None), (402, ""), (403, " b" * 4096), (404, "same"), (405, "same")]
    df = spark.createDataFrame(data, "doc_id bigint, text string").selectExpr("*", "1 AS container_id", "2 AS rank")
    got = packing.pack(df).collect()
    size = {i: len(library(t or "")) for i, t in data}
    per, parts = {}, {}
    for r in got:
        per[r.container_id] = per.get(r.container_id, 0) + r.n_tokens
        parts.setdefault(r.doc_id, []).append((r.part_no, r.first_token, r.n_tokens))
    assert max(per.values()) <= 2048 and set(parts) == set(size)
    for i, n in size.items():
        p = sorted(parts[i])
        assert sum(x[2] for x in p) == n and [x[0] for x in p] == list(range(len(p))) and [x[1] for x in p] == [2048 * k for k in range(len(p))]
        assert len(p) == max(1, -(-n // 2048))
    assert sum(per.values()) / (2048 * len(per)) > 0.98
    assert packing.pack(df.limit(0)).count() == 0
