"""Text statistics of each document, and boosted trees on them that tell running prose from lists, tables and junk.

The classifier is fitted on a bounded sample (``TRAIN_ROWS`` documents by hash of ``doc_id``): labelling functions
give weak labels or abstain, and each prose text also enters as junk with its words shuffled or repeated. Word order is judged
by a transition model between common words (at most 201 states), fitted on the sample's prose. Probabilities are
calibrated on a hand-checked holdout of made texts and read documents; others that were read are kept out and measured. The statistics and the scores cover every document.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnlake.llm.boosting import BoostedTrees
from cairnlake.llm.holdout import CALIBRATION, KEPT_OUT

#: Documents at most (in expectation) in the training sample.
TRAIN_ROWS = 3000
HASH_PARTS = 1 << 60
#: A document is a case from this probability of being no prose.
JUNK_FROM = 0.5

_LINES = re.compile(r"\r\n|\r|\n")
_WORDS = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
_KANA = re.compile(r"[぀-ヿ]")
_BULLET = re.compile(r"^(?:[-*•–—+>|#☐✓✔]|\[.?\]|\(?\w{1,3}[.)]|No\. |\d+(?:\.\d+)*\s)")
_ENDS = frozenset(".!?…。！？:;")
_QUOTES = "\"'”’»“«)]"

STATISTICS = (
    "n_chars", "n_words", "mean_word_length", "symbol_ratio", "digit_ratio", "upper_ratio", "end_punctuation_share",
    "common_share", "distinct_share", "words_per_line", "bullet_share", "prose_line_share", "kana_ratio",
    "longest_word", "stops_per_word", "separator_ratio", "repeated_line_share", "letter_words_share", "lower_start_share",
)
FEATURES = (*STATISTICS, "order_score")


def statistics(text: str, common: dict[str, int]) -> tuple[list[float], Counter]:
    """The values of ``STATISTICS`` for a text, and how often each pair of states follows one another.

    A word is a run without white space. ``common`` gives the state of each common word; other words have state 0.
    A blank text has zeros throughout.
    """
    words = text.split()
    n, solid = len(words), sum(map(len, words))
    if not n:
        return [float(len(text))] + [0.0] * (len(STATISTICS) - 1), Counter()
    alpha, digit, upper = sum(map(str.isalpha, text)), sum(map(str.isdigit, text)), sum(map(str.isupper, text))
    lines = [s for s in (x.strip() for x in _LINES.split(text)) if s]
    ended = bullets = prose = known = total = 0
    pairs: Counter = Counter()
    distinct, seen, last = set(), Counter(), None
    for s in lines:
        core = s.rstrip(_QUOTES)
        stop = bool(core) and core[-1] in _ENDS
        ended += stop
        bullets += _BULLET.match(s) is not None
        seen[s] += 1
        found = _WORDS.findall(s.lower())
        states = [common.get(w, 0) for w in found]
        k = sum(map(bool, states))
        known += k
        total += len(found)
        distinct.update(found)
        if len(found) >= 5 and k >= 0.22 * len(found) or _KANA.search(s) and (stop or len(s) > 25):
            prose += len(s)
        if last is not None and states:
            states.insert(0, last)
        if states:
            pairs.update(zip(states, states[1:]))
            last = states[-1]
    long = sum(map(len, lines))
    letters = max(1, alpha)
    return [
        float(len(text)), float(n), solid / n, (solid - alpha - digit) / solid, digit / solid, upper / letters, ended / len(lines),
        known / max(1, total), len(distinct) / max(1, total), n / len(lines), bullets / len(lines), prose / long,
        len(_KANA.findall(text)) / solid, float(max(map(len, words))), sum(map(text.count, ".!?。！？")) / n,
        sum(map(text.count, ",;|\t/·=")) / solid, 1 - len(seen) / len(lines), total / n,
        sum(w[0].islower() for w in words) / n,
    ], pairs


def spoiled(text: str, seed: int) -> str:
    """The text as junk: its words in random order without the stops at their ends, or a few of them over and over.

    Every third text keeps its first line, every eighth becomes a repeated phrase.
    """
    rng, words = random.Random(seed), text.split()
    if seed % 8 == 1 and len(words) > 4:
        at, n = rng.randrange(len(words) - 3), rng.randint(2, 4)
        return rng.choice(" \n").join([" ".join(words[at : at + n])] * rng.randint(12, 60))
    head, _, rest = text.strip().partition("\n" if seed % 2 else ". ") if seed % 3 == 0 else ("", "", text)
    if not rest or 3 * len(head) > len(rest):
        head, rest = "", text
    words = [w.rstrip(".,!?…;:") for w in rest.split()]
    rng.shuffle(words)
    return f"{head}.\n{' '.join(words)}" if head else " ".join(words)


def weak_label(s: dict[str, float]) -> int | None:
    """1 for prose, 0 for lists, tables and junk, None where the labelling functions abstain."""
    if s["kana_ratio"] >= 0.3:
        return 1
    few = s["distinct_share"] * s["n_words"] < 12
    if s["n_words"] >= 12 and few and (s["distinct_share"] < 0.2 and s["common_share"] < 0.3 or s["distinct_share"] < 0.1):
        return 0
    many_lines = s["n_words"] >= 4 * s["words_per_line"] and s["words_per_line"] < 8
    if many_lines and s["end_punctuation_share"] <= 0.1 and s["common_share"] < 0.38 and s["stops_per_word"] < 0.03:
        return 0
    if s["prose_line_share"] <= 0.3 or s["letter_words_share"] < 0.4:
        return 0
    if s["prose_line_share"] >= 0.7 and s["common_share"] >= 0.25 and s["digit_ratio"] < 0.1:
        return 1
    return None


class OrderModel:
    """Mean pointwise mutual information of neighbouring word states, from transition counts of prose."""

    def __init__(self, states: int):
        self.counts = np.zeros((states, states))

    def add(self, pairs: dict[tuple[int, int], int]) -> None:
        for (a, b), n in pairs.items():
            self.counts[a, b] += n

    def fit(self) -> OrderModel:
        c = self.counts
        total = max(c.sum(), 1.0)
        independent = np.outer(c.sum(1), c.sum(0)) / total
        self.pmi = np.log((c + 0.5) / (independent + 0.5))
        return self

    def score(self, pairs: dict[tuple[int, int], int]) -> float:
        n = sum(pairs.values())
        return sum(self.pmi[a, b] * k for (a, b), k in pairs.items()) / n if n else 0.0


class Judge:
    """The fitted order model and trees; its size depends on the number of common words and trees alone."""

    def __init__(self, common: dict[str, int], order: OrderModel, trees: BoostedTrees):
        self.common, self.order, self.trees = common, order, trees

    def rows(self, texts: list[str]) -> np.ndarray:
        both = [statistics(t, self.common) for t in texts]
        return np.array([[*s, self.order.score(p)] for s, p in both]).reshape(len(texts), len(FEATURES))

    def junk(self, x: np.ndarray) -> np.ndarray:
        return 1 - self.trees.probability(x) if len(x) else np.zeros(0)


def common_states(common_word: DataFrame) -> dict[str, int]:
    """State 1.. of each common word in any language. The list is a fixed table of a few hundred words."""
    words = sorted({r["word"].lower() for r in common_word.select("word").where("word IS NOT NULL").distinct().collect()})
    return {w: i + 1 for i, w in enumerate(words)}


def fit(documents: DataFrame, common_word: DataFrame, rows: int = TRAIN_ROWS) -> Judge:
    """Fits on about ``rows`` documents, drawn by the hash of ``doc_id``; below that number on all of them."""
    common = common_states(common_word)
    total = documents.count()
    # Of so many parts of the hashes that the share stays exact for any number of documents.
    share = min(HASH_PARTS, -(-HASH_PARTS * rows // max(1, total)))
    sample = documents.where(F.col("text").rlike(r"\S") & (F.pmod(F.xxhash64("doc_id"), F.lit(HASH_PARTS)) < share))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values, keys, counts, mixed = [], [], [], []
            for t in b.column(0).to_pylist():
                for flag, version in ((False, t), (True, spoiled(t, len(t)))):
                    s, p = statistics(version, common)
                    values.append(s)
                    keys.append([x * 65536 + y for x, y in p])
                    counts.append(list(p.values()))
                    mixed.append(flag)
            kinds = (pa.list_(pa.float64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.bool_())
            arrays = [pa.array(v, k) for v, k in zip((values, keys, counts, mixed), kinds)]
            yield pa.RecordBatch.from_arrays(arrays, names=["s", "k", "c", "mixed"])

    got = sample.select("text").mapInArrow(run, "s array<double>, k array<int>, c array<int>, mixed boolean").collect()
    order, labelled = OrderModel(len(common) + 1), []
    for own, other in zip(got[::2], got[1::2]):
        label = weak_label(dict(zip(STATISTICS, own["s"])))
        for r, y in ((own, label), (other, 0 if label == 1 and own["s"][12] < 0.3 and own["s"][1] >= 12 else None)):
            if y is not None:
                pairs = {(k >> 16, k & 65535): c for k, c in zip(r["k"], r["c"])}
                labelled.append((r["s"], pairs, y))
                if y == 1:
                    order.add(pairs)
    order.fit()
    x = np.array([[*s, order.score(p)] for s, p, _ in labelled]).reshape(-1, len(FEATURES))
    y = np.array([v for _, _, v in labelled], float)
    judge = Judge(common, order, BoostedTrees())
    if len(y):
        judge.trees.fit(x, y)
    held = judge.rows([t for t, _ in CALIBRATION])
    judge.trees.calibrate(held, np.array([v for _, v in CALIBRATION], float))
    return judge


def held_out(documents: DataFrame, common_word: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """One row on the read documents that were kept out of fitting and calibration: ``texts, brier, precision, recall`` for
    what is no prose."""
    judge = fit(documents, common_word, rows)
    p = judge.junk(judge.rows([t for t, _ in KEPT_OUT]))
    y = np.array([1 - v for _, v in KEPT_OUT], float)
    found = p >= JUNK_FROM
    row = (len(y), float(((p - y) ** 2).mean()), float(y[found].mean()) if found.any() else 0.0, float(found[y == 1].mean()))
    return documents.sparkSession.createDataFrame([row], "texts int, brier double, precision double, recall double")


def counts(documents: DataFrame, common_word: DataFrame) -> DataFrame:
    """``doc_id`` and the ``STATISTICS`` alone, without any model: a narrow pass."""
    common = common_states(common_word)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([statistics(t or "", common)[0] for t in b.column(1).to_pylist()]).reshape(len(b), len(STATISTICS))
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, x.T.copy())], names=["doc_id", *STATISTICS])

    return documents.selectExpr("cast(doc_id AS bigint) AS doc_id", "text").mapInArrow(run, "doc_id bigint, " + ", ".join(f"{f} double" for f in STATISTICS))


def score(documents: DataFrame, common_word: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """``doc_id``, the columns of ``FEATURES`` and ``junk_probability`` for every document.

    Null, empty and blank texts have zeros as statistics (``n_chars`` counts the blanks) and a null probability.
    Rows stay as they are: repeated rows are scored each, a null ``doc_id`` is kept. Only ``doc_id`` and ``text`` are
    read. An empty table gives no rows. One narrow pass; the fitted model is all that is shipped.
    """
    spark: SparkSession = documents.sparkSession
    model = spark.sparkContext.broadcast(fit(documents, common_word, rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = model.value
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            x = judge.rows(texts)
            p = pa.array(judge.junk(x), mask=x[:, 1] == 0)
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, x.T.copy()), p], names=["doc_id", *FEATURES, "junk_probability"])

    schema = "doc_id bigint, " + ", ".join(f"{f} double" for f in FEATURES) + ", junk_probability double"
    return documents.selectExpr("cast(doc_id AS bigint) AS doc_id", "text").mapInArrow(run, schema)


def junk(documents: DataFrame, common_word: DataFrame) -> DataFrame:
    """``doc_id`` of the documents that are mostly a list, a table or junk; blank texts are none."""
    return score(documents, common_word).where(F.col("junk_probability") >= JUNK_FROM).select("doc_id").distinct()
