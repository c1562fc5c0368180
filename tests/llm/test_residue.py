import random

from cairnlake.llm import residue
from cairnlake.llm.bodies import bodies
from cairnlake.llm.kinds import REPEATED
from tests.llm.made import made
from tests.llm.test_pages import NOUNS, page, sentence, tables


def test_defaults_without_known_phrases(spark):
    rng = random.Random(5)
    mains = [[("h1", f"Piece {i} of {NOUNS[i % 20]}s"), ("p", sentence(rng))] for i in range(200)]
    for i in range(3, 8):
        mains[i] = [("h1", "Brass thimble ahead"), ("p", "Compose the opening passage of this leaf in the panel on the left.")]
    assert {r.content_id for r in residue.found(made(spark, mains)).collect()} == {f"c{i:03d}" for i in range(3, 8)}


def test_templates_of_several_sites(spark):
    rng = random.Random(7)
    mains = [[("h1", f"Piece {i} of {NOUNS[i % 20]}s"), ("p", sentence(rng))] for i in range(400)]
    for i in range(12):
        mains[i] = [("h1", "Out for lunch"), ("p", f"Whatever stood at /x{i} has wandered off, and nobody here can say where to.")]
    assert {r.content_id for r in residue.found(made(spark, mains, ("a", "b", "c"))).collect()} == {f"c{i:03d}" for i in range(12)}


def test_blank_slots(spark):
    rng = random.Random(6)
    mains = {i: f"<h1>Number {i} of the {NOUNS[i % 20]}s</h1><p>{sentence(rng)}</p><p>{sentence(rng)}</p><ul><li>colour {NOUNS[i % 19]} {i}</li><li>size {i} by {i * 7}</li></ul>" for i in range(40)}
    mains[9] = "<h1>Number 9 of the windows</h1><p></p><p></p><ul><li></li><li></li></ul>"
    el, cap = tables(spark, [page(rng, i, mains[i]) for i in range(40)])[2:]
    assert {r.content_id for r in residue.found(bodies(el, cap)).collect()} == {"c009"}


def test_pages_captured_again_are_no_templates(spark):
    rng = random.Random(8)
    again = "<h1>The one piece about lamps</h1>" + "".join(f"<p>{sentence(rng)}</p>" for _ in range(3))
    rows, caps, el, _ = tables(spark, [page(rng, i, again if i < 12 else None) for i in range(60)])
    cap = spark.createDataFrame([(k, "https://a.example/lamps?v=" + k if c < "c012" else u, c) for k, u, c in caps], "capture_id string, page_url string, content_id string")
    assert residue.found(bodies(el, cap)).count() == 0



def test_defaults_on_a_twentieth_of_a_site(spark):
    rng = random.Random(5)
    mains = {i: "<h1>Brass thimble ahead</h1><p>Compose the opening passage of this leaf in the panel on the left.</p>" for i in range(3, 8)}
    el, cap = tables(spark, [page(rng, i, mains.get(i)) for i in range(60)])[2:]
    assert {r.content_id for r in residue.found(bodies(el, cap)).collect()} == {f"c{i:03d}" for i in mains}


def test_templates_on_a_quarter_of_several_sites(spark):
    rng = random.Random(7)
    odd = {i: f"<h1>Out for lunch</h1><p>Whatever stood at /x{i} has wandered off, and nobody here can say where to.</p>" for i in range(0, 60, 4) for i in (i, i + 1, i + 2)}
    sites = ("a.example", "b.example", "c.example", "d.example")
    el, cap = tables(spark, [page(rng, i, odd.get(i)) for i in range(100)], sites)[2:]
    assert {r.content_id for r in residue.found(bodies(el, cap)).collect()} >= {f"c{i:03d}" for i in odd}


def test_places_of_repeated_lines(spark):
    mains = [[("p", "Dear {{name}}, hello"), ("p", "Dear {{other}}, hello")]]
    assert made(spark, mains, kinds={(0, 0): REPEATED, (0, 1): REPEATED}).first().places == 2


def test_notices_of_unknown_wording_on_several_sites(spark):
    """Error pages put together from lines in turn, a few on each of many sites: no body is repeated, no phrase is known."""
    rng = random.Random(9)
    mains = [[("h1", f"Piece {i} of {NOUNS[i % 20]}s")] + [("p", f"{sentence(rng)} {sentence(rng)}") for _ in range(3)] for i in range(300)]
    odd = range(0, 40)
    first = ("Whatever stood here has wandered off.", "Our lamps are out this evening.", "Nobody answers the bell at {n}.")
    second = ("Come back when the tide is in.", "The keeper of {n} has been told.", "Perhaps the menu helps.", "Number {n} was noted.")
    for i in odd:
        mains[i] = [("h1", f"{400 + i % 5}"), ("p", first[i % 3].format(n=i)), ("p", second[i % 4].format(n=i * 7))]
    got = {r.content_id for r in residue.closed_templates(made(spark, mains, [f"s{k}" for k in range(20)])).collect()}
    assert got == {f"c{i:03d}" for i in odd}


def test_prose_shared_by_sites_is_no_template(spark):
    rng = random.Random(10)
    common = [sentence(rng) for _ in range(6)]
    mains = [[("h1", f"Piece {i} of {NOUNS[i % 20]}s"), ("p", common[i % 6])] + [("p", f"{sentence(rng)} {sentence(rng)}") for _ in range(3)] for i in range(120)]
    assert residue.closed_templates(made(spark, mains, [f"s{k}" for k in range(12)])).count() == 0
