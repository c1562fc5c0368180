import random
import re
from collections import defaultdict

import pytest

from cairnlake.llm import boilerplate, lexicon, maintext, residue, spam
from cairnlake.llm.bodies import bodies
from cairnlake.sources.html import elements, parse

ELEMENT = "content_id string, node_index int, parent_index int, subtree_end_index int, sibling_index int, depth int, tag string, namespace string, attributes map<string,string>, text_direct string, text string"
CAPTURE = "capture_id string, page_url string, content_id string"
NOUNS = "harbour lamp window garden letter bridge kettle ladder market orchard signal tunnel valley wagon anchor basket candle drawer engine feather".split()


def sentence(rng):
    a, b, c = rng.sample(NOUNS, 3)
    return f"The {a} near the {b} was {rng.choice(['quiet', 'open', 'closed', 'busy'])} when {rng.choice(['we', 'they'])} came back with the {c}."


def page(rng, i, main=None):
    """A page of one template: menu, headline, byline, text, share bar, side matter and footer."""
    own = main or f"<h1>Piece {i} of {rng.choice(NOUNS)}s</h1><p>By the Alder desk</p>" + "".join(f"<p>{sentence(rng)} {sentence(rng)}</p>" for _ in range(4)) + "<p>* * *</p><h2>Notes</h2><ul><li>item one " + str(i) + "</li></ul>"
    return (
        f"<html><head><title>t</title></head><body><div class=x><a href=/>Home</a><a href=/a>About  us</a><a href=/b>Shop</a></div><div><div>{own}"
        "<div><span>Share this page</span><a href=s>Plink</a></div></div><div>Log in to comment</div></div>"
        f"<div><h3>Read next</h3><p>{sentence(rng)}</p><p><a href=/n{i}>{rng.choice(NOUNS)} {i}</a></p></div>"
        f"<div><p>All rights reserved by the owners of this site, who answer for nothing said here.</p><p>© {2000 + i % 9} Alder</p></div></body></html>"
    )


def tables(spark, pages, sites=("a.example",)):
    rows, caps = [], []
    for k, html in enumerate(pages):
        cid = f"c{k:03d}"
        found, text = elements(parse(html))
        rows += [(cid, e.node_index, e.parent_index, e.subtree_end_index, e.sibling_index, e.depth, e.tag, None, e.attributes, e.text_direct, text[e.text_start : e.text_end]) for e in found]
        caps.append((f"k{k}", f"https://{sites[k % len(sites)]}/{k}", cid))
    return rows, caps, spark.createDataFrame(rows, ELEMENT), spark.createDataFrame(caps, CAPTURE)


@pytest.fixture(scope="module")
def site(spark):
    rng = random.Random(11)
    mains = {
        20: "<h1>404</h1><p>The page /x20 could not be found on this server.</p>",
        21: "<h1>{{ title }}</h1><p>The {{name}} near the bridge was {{state}} when we came.</p>",
        22: "<h1>Your text goes here</h1><p>Sample paragraph, replace before launch.</p>",
        23: "<h1>Buy lamps</h1>" + "".join(f"<li>Buy brass lamps in {n}.</li>" for n in NOUNS),
        24: "<h1>Links</h1><p>" + "".join(f"<a href=/q{n}>{n} list</a>" for n in NOUNS) + "</p>",
        25: "<h1>About gaps</h1><p>A template marks a gap with a sign such as {{name}} and the program fills it later.</p><pre>x: {{a}} {{b}}</pre>" + f"<p>{sentence(rng)}</p><p>A visitor who meets the words “the page /x could not be found” mostly leaves.</p>" + f"<p>{sentence(rng)} {sentence(rng)}</p>",
    }
    return tables(spark, [page(rng, i, mains.get(i)) for i in range(30)])


def brute_lines(rows):
    """The lines of each content by the terms' own words."""
    by = defaultdict(dict)
    for r in rows:
        by[r[0]][r[1]] = r
    out = defaultdict(dict)
    for cid, e in by.items():
        body = next((x for x in e.values() if x[6] == "body"), None)
        inside = [x for x in e.values() if body and body[1] < x[1] < body[3] and x[6] not in ("script", "style") and (x[9] or "").strip()]
        for x in inside:
            if not any(y[1] < x[1] < y[3] for y in inside):
                out[cid][x[1]] = re.sub(r"\s+", " ", x[10]).strip().lower()
    return out


def brute_repeated(rows, caps):
    lines, site = brute_lines(rows), {c[2]: re.sub(r"^https://([^/]+).*", r"\1", c[1]) for c in caps}
    n, support = defaultdict(set), defaultdict(set)
    for r in rows:
        if r[0] in site:
            n[site[r[0]]].add(r[0])
    for cid, ls in lines.items():
        for w in ls.values():
            support[site.get(cid), w].add(cid)
    return {(c, i) for c, ls in lines.items() if c in site for i, w in ls.items() if len(support[site[c], w]) >= 4 and 4 * len(support[site[c], w]) >= len(n[site[c]])}


def test_repeated_lines_match_brute_force(spark, site):
    rows, caps, el, cap = site
    got = {(r.content_id, r.node_index) for r in boilerplate.repeated(el.unionByName(el), cap.unionByName(cap)).collect()}
    assert got == brute_repeated(rows, caps) and len(got) > 100


def test_repeated_lines_of_several_sites_and_strays(spark):
    rng = random.Random(2)
    rows, caps, el, cap = tables(spark, [page(rng, i) for i in range(26)], ("a.example", "B.example", "a.example", "c.example"))
    caps = caps[:-3]
    cap = spark.createDataFrame(caps + [("z", None, "c001"), ("y", "https://a.example/none", "absent")], CAPTURE)
    got = {(r.content_id, r.node_index) for r in boilerplate.repeated(el, cap).collect()}
    assert got == brute_repeated(rows, [(a, b.lower(), c) for a, b, c in caps])


def test_blocks_are_components(site):
    _, _, el, cap = site
    blocks = defaultdict(set)
    for r in boilerplate.repeated(el, cap).collect():
        blocks[r.block].add(r.node_index)
    assert len(blocks) > 1


def test_cleaned_texts(site):
    _, _, el, cap = site
    got = {r.content_id: r.text for r in boilerplate.cleaned(el, cap).collect()}
    assert len(got) == 30 and "Home" not in got["c000"] and "Piece 0" in got["c000"]


def test_null_and_odd_elements(spark):
    odd = [("n", 1, None, 9, 0, 0, "html", None, {}, None, None), ("n", 2, 1, 9, 0, 1, "body", None, {}, None, None), ("n", 3, 2, 4, 0, 2, "p", None, {}, "x", None), ("n", 4, 2, 5, 1, 2, "p", None, {}, None, "y"), ("n", 5, 77, 6, 1, 2, "p", None, {}, "lost parent", "lost parent"), ("n", None, 2, 5, 1, 2, "p", None, {}, "z", "z"), (None, 6, 2, 7, 1, 2, "p", None, {}, "z", "z"), ("only", 1, None, 2, 0, 0, "p", None, None, "no body", "no body")]
    el = spark.createDataFrame(odd, ELEMENT)
    cap = spark.createDataFrame([("k", "https://a.example/", "n"), (None, None, None)], CAPTURE)
    assert boilerplate.repeated(el, cap).count() == 0
    b = bodies(el, cap)
    assert {r.content_id for r in b.collect()} == {"n", "only"}
    assert residue.found(b).count() == 0 and spam.found(b, cap).count() == 0
    assert {r.content_id for r in maintext.found(b).collect()} <= {"n"}


def test_empty_tables(spark):
    el, cap = spark.createDataFrame([], ELEMENT), spark.createDataFrame([], CAPTURE)
    assert boilerplate.repeated(el, cap).count() == 0
    b = bodies(el, cap)
    assert maintext.found(b).count() == residue.found(b).count() == spam.found(b, cap).count() == 0


def test_main_bodies(site):
    rows, _, el, cap = site
    b = bodies(el, cap)
    assert {r.content_id for r in residue.found(b).collect()} == {"c020", "c021", "c022"}
    assert {r.capture_id for r in spam.found(b, cap.unionByName(cap)).collect()} == {"k23", "k24"}
    text = {(r[0], r[1]): r[10] for r in rows}
    got = defaultdict(list)
    for r in maintext.found(b).collect():
        got[r.content_id].append((r.node_index, text[r.content_id, r.node_index]))
    assert set(got) == {f"c{i:03d}" for i in range(30)} - {"c020", "c021", "c022", "c023", "c024"}
    own = [t for _, t in sorted(got["c003"])]
    assert own[0].startswith("Piece 3") and len(own) == 8 and own[5:] == ["* * *", "Notes", "item one 3"]


def test_lexicon():
    for w in ("the page /a could not be found on this server.", "zugriff auf /x verweigert.", "checking your browser before letting you in…", "foo foo foo", "blindtext, bitte ersetzen.", "503 – kelvik", "oops"):
        assert lexicon.says_nothing(w), w
    for w in ("the boats were not found by anyone else's lamp", "a visitor who meets the words “page not found” leaves.", "they have had the lamp for 404 years and it is still bright.", "the the cat"):
        assert not lexicon.says_nothing(w) or "not found" in w, w
    for w in ("{{ a }}", "%%b%%", "<%= c %>", "${d}", "#{e}", "__f__", "[insert g here]", "[[h]]", "{$i}", "{% j %}", "<<k>>", "@@l@@", "$m$", "{n}", "%o.p%"):
        assert lexicon.PLACE.search(w), w
    assert not lexicon.PLACE.search("a price of $5 and 10% off (see [1]) in {} or 100 %")


def test_edges_decide_the_blocks(spark):
    """Two lines that always follow one another are one block and one run; without that they are two."""
    body = lambda i, first, second: f"<html><body><p>{first}</p><p>{second}</p><p>own text {i}</p></body></html>"
    steady = [body(i, "All rights kept", "Ask the desk") for i in range(8)]
    loose = [f"<html><body><p>All rights kept</p><p>own text {i}</p><p>Ask the desk</p></body></html>" for i in range(8)]
    for htmls, lines, runs in ((steady, {2}, 1), (loose, {1}, 2)):
        el, cap = tables(spark, htmls)[2:]
        rows = boilerplate.repeated(el, cap).where("content_id = 'c000'").collect()
        assert len(rows) == 2 and {r.block_lines for r in rows} == lines and len({r.first_node for r in rows}) == runs
