import numpy as np

from cairnlake.llm import quality
from cairnlake.llm.boosting import BoostedTrees
from cairnlake.llm.holdout import HOLDOUT

COMMON = "the of and to in is was it that for on with as they be at by this had not are but from or have an which you were all we when there can more if out so up said what its about than into them only other time new some could these two may then do first any my now such like our over me even most made after also did many off before must well back through years much where your way down should because long each just state those people too mr how little good world make very year still see own work men day get here old life".split()  # noqa: E501


def made(spark, n=400):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(n):
        if i % 4:
            a = rng.choice(["lamp", "boat", "door", "mill", "path"], 3)
            t = " ".join(f"The {x} was old when they came, but it is still in the {y} and we have not seen it." for x, y in zip(a, a[::-1]))
        else:
            t = "\n".join(f"{k}. {rng.choice(['blue', 'red', 'small'])} {rng.choice(['lamps', 'boats', 'jars'])}" for k in range(12))
        rows.append((i, t))
    rows += [(n, None), (n + 1, ""), (n + 2, "  \n"), (n + 3, "x" * 30_000), (None, rows[1][1]), (0, rows[0][1])]
    words = spark.createDataFrame([("en", w, i) for i, w in enumerate(COMMON)] + [("de", "der", 1), ("en", None, 0)], "lang string, word string, place int")
    return spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "'c' AS n_words"), words


def test_lists_are_found_and_prose_is_not(spark):
    docs, words = made(spark)
    got = {r.doc_id for r in quality.junk(docs, words).collect()}
    assert {i for i in range(0, 400, 4)} <= got and not {i for i in range(400) if i % 4} & got
    assert not {400, 401, 402} & got and 403 in got


def test_statistics_of_blank_and_plain_texts(spark):
    docs, words = made(spark, 40)
    out = {r.doc_id: r for r in quality.score(docs.where("doc_id > 37"), words).collect()}
    assert out[40].junk_probability is None and out[41].n_words == 0 and out[42].n_chars == 3
    s = dict(zip(quality.STATISTICS, quality.statistics("The cat sat.\nIt was 12!", {"the": 1, "it": 2, "was": 3})[0]))
    assert (s["n_words"], s["end_punctuation_share"], s["words_per_line"]) == (6, 1.0, 3.0)
    assert s["common_share"] == 3 / 5 and abs(s["mean_word_length"] - 18 / 6) < 1e-9


def test_empty_table(spark):
    docs, words = made(spark, 8)
    assert quality.junk(docs.limit(0), words).count() == 0
    assert quality.score(docs, words.limit(0)).count() == docs.count()


def test_boosting_learns_and_calibrates():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    t = BoostedTrees(rounds=60).fit(x[:1500], y[:1500]).calibrate(x[1500:1600], y[1500:1600])
    p = t.probability(x[1600:])
    assert ((p > 0.5) == y[1600:]).mean() > 0.95
    assert abs(p.mean() - y[1600:].mean()) < 0.08
    assert len({label for _, label in HOLDOUT}) == 2


def test_read_documents_kept_out():
    from cairnlake.llm.holdout import CALIBRATION, KEPT_OUT, READ

    assert not {t for t, _ in KEPT_OUT} & {t for t, _ in CALIBRATION} and set(KEPT_OUT) <= set(READ)
