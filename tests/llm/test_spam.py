import random

import pytest

from cairnlake.llm import spam
from cairnlake.llm.kinds import NOTICE
from tests.llm.made import made
from tests.llm.test_pages import NOUNS, sentence


def found(df):
    return {r.content_id for r in spam.found_contents(df).collect()}


FORMS = (
    "Nobody in the valley had seen such a {a} before.", "What happens to the {a} when our {b} is open?", "She found that it rarely needs a {a} in winter.",
    "If you have no {a}, you can use any {b} that works.", "After three weeks his {a} was closed and they went home.", "It is not clear why this {a} follows so many rules.",
    "Most readers will know that {a} from an old {b}.", "They have had their {a} for years, yet it still holds.", "On quiet days one could hear the {a} from here.",
    "Some of these came from town, where every {a} costs more.", "He would rather keep one good {a} than two bad ones.", "There was hardly any {a} left behind at last.",
)


def prose(rng, n):
    return [[("p", f.format(a=rng.choice(NOUNS), b=rng.choice(NOUNS))) for f in rng.sample(FORMS, 8)] for _ in range(n)]


def test_a_campaign_of_a_third_of_the_corpus(spark):
    rng = random.Random(3)
    mains = [[("p", f"{sentence(rng)} {sentence(rng)}") for _ in range(5)] for _ in range(200)]
    for i in range(0, 200, 3):
        mains[i] = [("p", f"Buy cheap brass lamps in {n} {i}.") for n in NOUNS[:12]]
    assert found(made(spark, mains)) >= {f"c{i:03d}" for i in range(0, 200, 3)}


def test_a_campaign_among_varied_prose(spark):
    mains = prose(random.Random(3), 200)
    for i in range(0, 200, 3):
        mains[i] = [("p", f"Buy cheap brass lamps in {n} {i}.") for n in NOUNS[:12]]
    assert found(made(spark, mains)) == {f"c{i:03d}" for i in range(0, 200, 3)}


def test_word_salad_is_told_by_pmi_alone(spark):
    rng = random.Random(4)
    mains = prose(rng, 150)
    words = [w.strip(".").lower() for m in mains for _, x in m for w in x.split()]
    for i in (7, 60, 121):
        mains[i] = [("p", " ".join(rng.sample(NOUNS, 12) + rng.sample(words, 4))) for _ in range(4)]
    df = made(spark, mains)
    assert found(df) == {"c007", "c060", "c121"}
    rows = {r.content_id: r for r in spam.scores(df).collect()}
    assert all(rows[c].mean_pmi < spam.SALAD_PMI and rows[c].repeated == 0 for c in found(df))


def test_refrains_are_prose(spark):
    rng = random.Random(5)
    mains = prose(rng, 150)
    for i in (3, 4):
        line = mains[i][0][1]
        mains[i] = [("p", f"{line} {x}" if k % 2 else x) for k, (_, x) in enumerate(mains[i] + mains[i + 50])]
    assert found(made(spark, mains)) == set()


def test_short_tags_without_links(spark):
    rng = random.Random(6)
    mains = prose(rng, 150)
    mains[9] = [("li", f"{a} {b}") for a in ("cheap", "brass", "best") for b in NOUNS[:9]] * 2
    mains[10] = [("td", f"{n} {i}") for i, n in enumerate(NOUNS)] + [("p", sentence(rng))] * 9
    assert found(made(spark, mains)) == {"c009"}


def test_filler_is_residue_and_no_spam(spark):
    mains = prose(random.Random(8), 60)
    mains[5] = [("p", "bla bla bla bla bla"), ("p", "foo foo foo foo foo foo")]
    assert found(made(spark, mains)) == set()


def test_keywords_set_by_the_site(spark):
    mains = prose(random.Random(9), 60)
    mains[5] = [("p", "Notes of the day")] + [("p", f"buy brass lamps in {n} now") for n in NOUNS[:12]]
    assert found(made(spark, mains, kinds={(5, k): NOTICE for k in range(1, 13)})) == {"c005"}


@pytest.mark.parametrize("share", (0.5, 0.01, 0.001))
def test_rare_counts_come_by_the_join(spark, monkeypatch, share):
    rng = random.Random(10)
    mains = prose(rng, 80)
    mains[5] = [("p", f"Buy cheap brass lamps in {n}.") for n in NOUNS[:12]]
    df = made(spark, mains)
    expected = sorted(map(tuple, spam.scores(df).collect()))
    monkeypatch.setattr(spam, "BROADCAST_SHARE", share)
    assert sorted(map(tuple, spam.scores(df).collect())) == expected
