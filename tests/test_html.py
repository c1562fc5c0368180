import random

import pytest

from cairnlake.operators.projections import anchors, jsonld, page_terms, postings, resolve
from cairnlake.sources.html import decode_html, elements, parse


def tree(source):
    found, text = elements(parse(source))
    return found, text, {e.node_index: e for e in found}


def tags(source):
    return [e.tag for e in tree(source)[0]]


def test_implied_elements():
    assert tags("<main><section><b>x</b><hr></section></main>") == ["html", "head", "body", "main", "section", "b", "hr"]
    assert tags("") == ["html", "head", "body"]


def test_mixed_content_counts_all_nodes():
    found, text, _ = tree("<!DOCTYPE html><!--c--><p>a<strong>b</strong>c<!--x-->d")
    p = next(e for e in found if e.tag == "p")
    strong = next(e for e in found if e.tag == "strong")
    assert (p.text_direct, text[p.text_start : p.text_end]) == ("acd", "abcd")
    assert (strong.node_index - p.node_index, p.subtree_end_index - p.node_index) == (2, 7)


def test_leaves_and_intervals():
    found, _, by = tree("<div><br><img><span></span></div><ul><li>a<li>b</ul>")
    for e in found:
        if e.tag in ("br", "img", "span"):
            assert e.subtree_end_index == e.node_index + 1
        if e.parent_index is not None:
            up = by[e.parent_index]
            assert up.node_index < e.node_index < e.subtree_end_index <= up.subtree_end_index and e.depth == up.depth + 1


def test_unclosed_formatting_is_reconstructed():
    found, text, by = tree("<p>1<b>2<p>3</b>4<p>5")
    assert [text[e.text_start : e.text_end] for e in found if e.tag == "b"] == ["2", "3"]
    found, text, _ = tree("<b>" + "<p>x" * 2)
    assert [text[e.text_start : e.text_end] for e in found if e.tag == "p"] == ["x", "x"]


def test_adoption_agency():
    found, text, by = tree("<a href=1>x<div>y<a href=2>z</a></div>")
    assert [(text[e.text_start : e.text_end], by[e.parent_index].tag) for e in found if e.tag == "a"] == [("x", "body"), ("y", "div"), ("z", "div")]


def test_tables():
    found, text, by = tree("<table>x<tr><td>1<td>2</table>y")
    assert [e.tag for e in found][3:] == ["table", "tbody", "tr", "td", "td"]
    assert text == "x12y"


@pytest.mark.parametrize("source, kind, text", [("<title>a<b>&amp;</title>", "title", "a<b>&"), ("<script>if (a<b) '</p>'</script>", "script", "if (a<b) '</p>'"), ("<textarea>\n<p></textarea>", "textarea", "<p>")])
def test_raw_text(source, kind, text):
    found, whole, _ = tree(source)
    e = next(x for x in found if x.tag == kind)
    assert whole[e.text_start : e.text_end] == text


def test_entities_make_one_text_node():
    found, text, _ = tree("<p>a&amp;b&#x41;&copy;</p>")
    p = next(e for e in found if e.tag == "p")
    assert p.text_direct == "a&bA©" and p.subtree_end_index == p.node_index + 2


def test_foreign_namespaces_and_templates():
    found, _, _ = tree('<svg><a xlink:href="#x"><title>t</title></a></svg><template><p>q</p></template><p>r')
    a = next(e for e in found if e.tag == "a")
    assert a.namespace.endswith("svg") and a.attributes == {"{http://www.w3.org/1999/xlink}href": "#x"}
    t = next(e for e in found if e.tag == "template")
    assert t.subtree_end_index - t.node_index == 4  # the fragment, p and its text


def test_truncated_pages():
    assert tags("<div><p>a<a href='x") == ["html", "head", "body", "div", "p"]
    assert tags("<script>never closed") == ["html", "head", "script", "body"]


def test_decoding():
    assert decode_html("é") == "é"
    assert decode_html(b"\xef\xbb\xbf\xc3\xa9") == "é"
    assert decode_html(b'<meta charset="utf-8">\xc3\xa9').endswith("é")
    assert decode_html(b"\x80") == "€"
    assert decode_html(b'<meta charset="nonsense">\xe9').endswith("é")


def test_terms():
    assert [t for t, _, _ in page_terms("cat fish’s 3.14 Straße foo_bar a.b, c")] == ["cat", "fish’s", "3.14", "strasse", "foo_bar", "a.b", "c"]
    assert list(page_terms("😀 Straße é"))[0] == ("strasse", 2, 8)
    assert list(page_terms("éx"))[0] == ("éx", 0, 3)


def test_postings_match_brute_force():
    rng = random.Random(714)
    for _ in range(50):
        source = "".join(rng.choice(["<div>", "</div>", "<b>", "</b>", "<p>", "word ", "cat", "fish ", "Straße ", "<span>", "</span>"]) for _ in range(60))
        found, text = elements(parse(source))
        want = {}
        for e in found:
            for term, s, t in page_terms(text):
                if e.text_start <= s and t <= e.text_end:
                    want.setdefault(term, set()).add(e.node_index)
        assert {k: set(v) for k, v in postings(found, text).items()} == want


def test_jsonld_rules():
    page = '<script type="Application/LD+JSON; x=1">{"a":1}</script><script type="application/ld+json">{broken</script><script type="application/ld+json"> </script><script type="application/json">{}</script><script type="application/ld+json">null</script><script type="application/ld+json">NaN</script><svg><script type="application/ld+json">{}</script></svg>'
    found, text = elements(parse(page))
    assert [(v, e) for _, v, e in jsonld(found, text)] == [('{"a":1}', None), (None, "Invalid JSON syntax"), (None, "Empty JSON-LD script"), ("null", None), (None, "Invalid JSON syntax")]


def test_links():
    found, _ = elements(parse('<head><base href="/b/"></head><a href="x">1</a><a href=" ">2</a><a>3</a><a href="mailto:a@b">4</a>'))
    base, links = anchors(found)
    assert base == "/b/" and [h for _, h in links] == ["x", "mailto:a@b"]
    page = "https://www.a.example/p?q=1"
    assert resolve(page, base, "x") == ("https://www.a.example/b/x", "same_origin")
    assert resolve(page, None, "mailto:a@b") is None
    assert resolve(page, None, "#top") == (page, "self")
    assert resolve(page, None, "http://www.a.example/") == ("http://www.a.example/", "same_host")
    assert resolve(page, None, "//b.a.example/") == ("https://b.a.example/", "same_site")
    assert resolve(page, None, "https://c.test/")[1] == "external"
