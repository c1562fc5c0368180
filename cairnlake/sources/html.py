"""Decoding and tree construction for captured HTML, after the HTML standard's parsing rules.

Covered: implied html, head and body; the in-body rules with scopes, implied end tags, paragraphs, lists and headings;
active formatting elements with reconstruction and the adoption agency; raw text, RCDATA and templates; tables with
implied sections and foster parenting; SVG and MathML namespaces. Left out: framesets, the select mode and encodings
beyond those Python knows.
"""

from __future__ import annotations

import codecs
import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

HTML, SVG, MATHML = "http://www.w3.org/1999/xhtml", "http://www.w3.org/2000/svg", "http://www.w3.org/1998/Math/MathML"
XLINK, XML, XMLNS = "http://www.w3.org/1999/xlink", "http://www.w3.org/XML/1998/namespace", "http://www.w3.org/2000/xmlns/"

# Fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr keygen basefont bgsound".split())
RAW = frozenset("style script xmp iframe noembed noframes".split())
RCDATA = frozenset("title textarea".split())
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
SPECIAL = frozenset(
    """address applet area article aside base basefont bgsound blockquote body br button caption center col colgroup dd details dir div dl dt embed
    fieldset figcaption figure footer form frame frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe img input keygen li link listing main
    marquee menu meta nav noembed noframes noscript object ol p param plaintext pre script search section select source style summary table tbody td
    template textarea tfoot th thead title tr track ul wbr xmp""".split()
)
SCOPE = frozenset("applet caption html table td th marquee object template".split())
CLOSES_P = frozenset(
    """address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer header hgroup main menu nav ol p search
    section summary ul pre listing form table hr xmp plaintext h1 h2 h3 h4 h5 h6 li dd dt""".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
IMPLIED_END = frozenset("dd dt li optgroup option p rb rp rt rtc".split())
HEAD_ONLY = frozenset("base basefont bgsound link meta noframes script style template title".split())
TABLE_PARTS = frozenset("caption col colgroup tbody tfoot thead tr td th".split())
BREAKOUT = frozenset(
    """b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span
    strong strike sub sup table tt u ul var""".split()
)
SVG_HTML_POINTS = frozenset("foreignobject desc title".split())

_ATTRIBUTE = re.compile(r"""[\s/]*([^\s/>=][^\s/>=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?""")
_TAG_END = re.compile(r"""(?:[^"'>]|=\s*"[^"]*"|=\s*'[^']*'|["'])*?>""", re.S)
_NAME = re.compile(r"[A-Za-z][^\s/>]*")
_META = re.compile(rb"""<meta[^>]*?charset\s*=\s*["']?\s*([A-Za-z0-9_:.-]+)""", re.I)
_SPACE = " \t\n\f\r"


def decode_html(data: bytes | str) -> str:
    """Text as it is; bytes by byte order mark, else a meta charset in the first 1024, else windows-1252."""
    if isinstance(data, str):
        return data
    for mark, name in ((b"\xef\xbb\xbf", "utf-8"), (b"\xfe\xff", "utf-16-be"), (b"\xff\xfe", "utf-16-le")):
        if data.startswith(mark):
            return data[len(mark) :].decode(name, "replace")
    m = _META.search(data[:1024])
    name = m.group(1).decode().lower() if m else "windows-1252"
    try:
        name = codecs.lookup(name).name
    except LookupError:
        name = "windows-1252"
    if name.startswith("utf-16"):
        name = "utf-8"
    return data.decode("cp1252" if name in ("iso8859-1", "ascii", "cp1252") else name, "replace")


@dataclass(eq=False)
class Node:
    kind: str  # document, doctype, element, text, comment, fragment
    name: str = ""
    space: str = HTML
    attributes: dict[str, str] = field(default_factory=dict)
    text: str = ""
    children: list[Node] = field(default_factory=list)
    parent: Node | None = None

    def append(self, n: Node) -> None:
        n.parent = self
        self.children.append(n)

    def detach(self) -> None:
        if self.parent is not None:
            self.parent.children.remove(self)
            self.parent = None

    def add_text(self, s: str) -> None:
        if self.children and self.children[-1].kind == "text":
            self.children[-1].text += s
        else:
            self.append(Node("text", text=s))


def _attributes(s: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(s):
        value = next((g for g in m.groups()[1:] if g is not None), "")
        out.setdefault(m.group(1).lower(), html.unescape(value) if "&" in value else value)
    return out


class Builder:
    """Builds the tree of one document."""

    def __init__(self) -> None:
        self.document = Node("document")
        self.stack: list[Node] = []
        self.active: list[Node | None] = []
        self.head: Node | None = None
        self.body: Node | None = None
        self.after_head = self.after_body = False
        self.form: Node | None = None

    # -- places ---------------------------------------------------------------------------------------------------
    @property
    def here(self) -> Node:
        return self.stack[-1] if self.stack else self.document

    def _content(self, n: Node) -> Node:
        return n.children[0] if n.name == "template" and n.space == HTML and n.children else n

    def _place(self) -> tuple[Node, Node | None]:
        """Where new nodes go: parent and the child to stand before (foster parenting inside tables)."""
        target = self.here
        if target.name in ("table", "tbody", "tfoot", "thead", "tr") and target.space == HTML and self._fostering:
            for i in range(len(self.stack) - 1, -1, -1):
                if self.stack[i].name == "template":
                    return self._content(self.stack[i]), None
                if self.stack[i].name == "table":
                    table = self.stack[i]
                    return (table.parent, table) if table.parent is not None else (self.stack[i - 1], None)
        return self._content(target), None

    _fostering = False

    def insert(self, n: Node) -> None:
        parent, before = self._place()
        if before is None:
            parent.append(n)
        else:
            n.parent = parent
            parent.children.insert(parent.children.index(before), n)

    def text(self, s: str) -> None:
        parent, before = self._place()
        if before is None:
            parent.add_text(s)
            return
        at = parent.children.index(before)
        if at and parent.children[at - 1].kind == "text":
            parent.children[at - 1].text += s
        else:
            n = Node("text", text=s, parent=parent)
            parent.children.insert(at, n)

    def open(self, name: str, attributes: dict[str, str] | None = None, space: str = HTML) -> Node:
        n = Node("element", name, space, attributes or {})
        self.insert(n)
        self.stack.append(n)
        if name == "template" and space == HTML:
            n.append(Node("fragment"))
        return n

    def has(self, name: str | frozenset[str], extra: frozenset[str] = frozenset(), only: frozenset[str] | None = None) -> bool:
        """Whether an element is in scope."""
        names = {name} if isinstance(name, str) else name
        for n in reversed(self.stack):
            if n.space == HTML and n.name in names:
                return True
            if n.name in (only if only is not None else SCOPE | extra) and n.space == HTML:
                return False
        return False

    def pop_to(self, name: str | frozenset[str]) -> None:
        names = {name} if isinstance(name, str) else name
        while self.stack:
            n = self.stack.pop()
            if n.name in names and n.space == HTML:
                return

    def imply(self, but: str = "") -> None:
        while self.stack and self.here.name in IMPLIED_END and self.here.name != but:
            self.stack.pop()

    def close_p(self) -> None:
        if self.has("p", frozenset(("button",))):
            self.imply("p")
            self.pop_to("p")

    # -- skeleton -------------------------------------------------------------------------------------------------
    def ensure_html(self) -> None:
        if not self.stack:
            self.open("html")

    def ensure_head(self) -> None:
        self.ensure_html()
        if self.head is None:
            self.head = self.open("head")

    def leave_head(self) -> None:
        self.ensure_head()
        if not self.after_head:
            while self.here is not self.head and self.head in self.stack:
                self.stack.pop()
            if self.here is self.head:
                self.stack.pop()
            self.after_head = True

    def ensure_body(self) -> None:
        self.leave_head()
        if self.body is None:
            self.body = self.open("body")

    # -- formatting -----------------------------------------------------------------------------------------------
    def reconstruct(self) -> None:
        if not self.active or self.active[-1] is None or self.active[-1] in self.stack:
            return
        i = len(self.active) - 1
        while i > 0 and self.active[i - 1] is not None and self.active[i - 1] not in self.stack:
            i -= 1
        for k in range(i, len(self.active)):
            old = self.active[k]
            self.active[k] = self.open(old.name, dict(old.attributes))

    def push_active(self, n: Node) -> None:
        same = []
        for x in reversed(self.active):
            if x is None:
                break
            if x.name == n.name and x.attributes == n.attributes:
                same.append(x)
        if len(same) >= 3:
            self.active.remove(same[-1])
        self.active.append(n)

    def clear_active(self) -> None:
        while self.active and self.active.pop() is not None:
            pass

    def adopt(self, name: str) -> None:
        """The adoption agency."""
        if self.here.name == name and self.here not in self.active:
            self.stack.pop()
            return
        for _ in range(8):
            element = None
            for x in reversed(self.active):
                if x is None:
                    break
                if x.name == name:
                    element = x
                    break
            if element is None:
                self.other_end(name)
                return
            if element not in self.stack:
                self.active.remove(element)
                return
            if not self._in_scope(element):
                return
            at = self.stack.index(element)
            furthest = next((n for n in self.stack[at + 1 :] if n.name in SPECIAL and n.space == HTML), None)
            if furthest is None:
                del self.stack[at:]
                self.active.remove(element)
                return
            ancestor, mark = self.stack[at - 1], self.active.index(element)
            node, last, i, inner = furthest, furthest, self.stack.index(furthest), 0
            while True:
                inner += 1
                i -= 1
                node = self.stack[i]
                if node is element:
                    break
                if inner > 3 and node in self.active:
                    if self.active.index(node) < mark:
                        mark -= 1
                    self.active.remove(node)
                if node not in self.active:
                    self.stack.remove(node)
                    continue
                copy = Node("element", node.name, node.space, dict(node.attributes))
                self.active[self.active.index(node)] = copy
                self.stack[i] = copy
                node = copy
                if last is furthest:
                    mark = self.active.index(node) + 1
                last.detach()
                node.append(last)
                last = node
            last.detach()
            if ancestor.name in ("table", "tbody", "tfoot", "thead", "tr"):
                table = next((n for n in reversed(self.stack) if n.name == "table"), None)
                if table is not None and table.parent is not None:
                    last.parent = table.parent
                    table.parent.children.insert(table.parent.children.index(table), last)
                else:
                    self._content(ancestor).append(last)
            else:
                self._content(ancestor).append(last)
            copy = Node("element", element.name, element.space, dict(element.attributes))
            for child in list(furthest.children):
                child.detach()
                copy.append(child)
            furthest.append(copy)
            gone = self.active.index(element)
            self.active.remove(element)
            self.active.insert(mark - (gone < mark), copy)
            self.stack.remove(element)
            self.stack.insert(self.stack.index(furthest) + 1, copy)

    def _in_scope(self, element: Node) -> bool:
        for n in reversed(self.stack):
            if n is element:
                return True
            if n.name in SCOPE:
                return False
        return False

    def other_end(self, name: str) -> None:
        for i in range(len(self.stack) - 1, -1, -1):
            n = self.stack[i]
            if n.name == name and n.space == HTML:
                self.imply(name)
                del self.stack[i:]
                return
            if n.name in SPECIAL and n.space == HTML:
                return

    # -- tokens ---------------------------------------------------------------------------------------------------
    def characters(self, s: str) -> None:
        if not self.stack or self.head is None or (not self.after_head and self.here is self.head):
            blank = s[: len(s) - len(s.lstrip(_SPACE))]
            if blank and self.stack and self.here is self.head:
                self.text(blank)
            s = s[len(blank) :]
            if not s:
                return
            self.ensure_body()
        elif self.after_head and self.body is None:
            blank = s[: len(s) - len(s.lstrip(_SPACE))]
            if blank:
                self.text(blank)
            s = s[len(blank) :]
            if not s:
                return
            self.ensure_body()
        if self.here.space != HTML:
            self.text(s)
            return
        if self.here.name in ("table", "tbody", "tfoot", "thead", "tr") and s.strip(_SPACE):
            self._fostering = True
            self.reconstruct()
            self.text(s)
            self._fostering = False
            return
        if self.here.name not in ("table", "tbody", "tfoot", "thead", "tr", "colgroup"):
            self.reconstruct()
        self.text(s)

    def raw(self, s: str) -> None:
        if s:
            self._content(self.here).add_text(s)

    def comment(self, s: str) -> None:
        n = Node("comment", text=s)
        if self.after_body and self.stack:
            self.stack[0].append(n)
        else:
            self._content(self.here).append(n)

    def start(self, name: str, attributes: dict[str, str], closed: bool) -> str | None:
        """Handles a start tag; the name of a raw text element whose text follows is returned."""
        if self.stack and self.here.space != HTML and not (self.here.space == SVG and self.here.name in SVG_HTML_POINTS or self.here.space == MATHML and self.here.name in ("mi", "mo", "mn", "ms", "mtext")):
            if name in BREAKOUT:
                while self.here.space != HTML:
                    self.stack.pop()
            else:
                self._foreign(name, attributes, self.here.space, closed)
                return None
        if name == "html":
            self.ensure_html()
            for k, v in attributes.items():
                self.stack[0].attributes.setdefault(k, v)
            return None
        if name == "head":
            self.ensure_html()
            if self.head is None:
                self.head = self.open("head", attributes)
            return None
        if name in HEAD_ONLY and self.body is None:
            self.ensure_head()
            if self.after_head:
                self.stack.append(self.head)
            n = self.open(name, attributes)
            if name in VOID:
                self.stack.pop()
            if self.after_head and name != "template":
                self.stack.remove(self.head)
            return n.name if name in RAW or name in RCDATA else None
        if name == "noscript" and self.body is None and not self.after_head and self.head is not None:
            self.open(name, attributes)
            return None
        if name == "body":
            self.leave_head()
            if self.body is None:
                self.body = self.open("body", attributes)
            else:
                for k, v in attributes.items():
                    self.body.attributes.setdefault(k, v)
            return None
        self.ensure_body()
        return self._in_body(name, attributes, closed)

    def _foreign(self, name: str, attributes: dict[str, str], space: str, closed: bool) -> None:
        renamed = {}
        for k, v in attributes.items():
            prefix, _, local = k.partition(":")
            uri = {"xlink": XLINK, "xml": XML, "xmlns": XMLNS}.get(prefix)
            renamed[f"{{{uri}}}{local}" if uri and local else f"{{{XMLNS}}}xmlns" if k == "xmlns" else k] = v
        self.open(name, renamed, space)
        if closed:
            self.stack.pop()

    def _in_body(self, name: str, attributes: dict[str, str], closed: bool) -> str | None:
        if name in TABLE_PARTS:
            return self._table_part(name, attributes)
        inside = self.here.name in ("table", "tbody", "tfoot", "thead", "tr") and self.here.space == HTML
        if inside and name not in ("table", "style", "script", "template", "input", "form"):
            self._fostering = True
        try:
            if name in CLOSES_P:
                if name == "li":
                    self._close_item(("li",))
                elif name in ("dd", "dt"):
                    self._close_item(("dd", "dt"))
                self.close_p()
                if name in HEADINGS and self.here.name in HEADINGS:
                    self.stack.pop()
            if name == "form":
                if self.form is not None:
                    return None
                self.form = self.open(name, attributes)
                return None
            if name == "a":
                for x in reversed(self.active):
                    if x is None:
                        break
                    if x.name == "a":
                        self.adopt("a")
                        if x in self.active:
                            self.active.remove(x)
                        if x in self.stack:
                            self.stack.remove(x)
                        break
            if name == "nobr" and self.has("nobr"):
                self.adopt("nobr")
            if name == "button" and self.has("button"):
                self.imply()
                self.pop_to("button")
            if name in ("option", "optgroup") and self.here.name == "option":
                self.stack.pop()
            if name not in CLOSES_P and name not in HEAD_ONLY:
                self.reconstruct()
            if name in FORMATTING:
                self.push_active(self.open(name, attributes))
                return None
            if name in ("svg", "math"):
                self._foreign(name, attributes, SVG if name == "svg" else MATHML, closed)
                return None
            if name == "image":
                name = "img"
            if name in ("applet", "marquee", "object"):
                self.active.append(None)
            n = self.open(name, attributes)
            if name in VOID:
                self.stack.pop()
            return n.name if name in RAW or name in RCDATA or name == "plaintext" else None
        finally:
            self._fostering = False

    def _close_item(self, names: tuple[str, ...]) -> None:
        for n in reversed(self.stack):
            if n.name in names and n.space == HTML:
                self.imply(n.name)
                self.pop_to(n.name)
                return
            if n.name in SPECIAL and n.name not in ("address", "div", "p"):
                return

    def _table_part(self, name: str, attributes: dict[str, str]) -> None:
        if not self.has("table", only=frozenset(("html", "table", "template"))) and not any(n.name == "template" for n in self.stack):
            return None
        stop = {"caption": ("table",), "colgroup": ("table",), "col": ("colgroup", "table"), "tbody": ("table",), "thead": ("table",), "tfoot": ("table",), "tr": ("tbody", "thead", "tfoot", "table"), "td": ("tr", "tbody", "thead", "tfoot", "table"), "th": ("tr", "tbody", "thead", "tfoot", "table")}[name]
        while self.stack and self.here.name not in (*stop, "html", "template"):
            if self.stack.pop().name in ("td", "th", "caption"):
                self.clear_active()
        if name == "col" and self.here.name == "table":
            self.open("colgroup")
        if name in ("tr", "td", "th") and self.here.name == "table":
            self.open("tbody")
        if name in ("td", "th") and self.here.name in ("tbody", "thead", "tfoot"):
            self.open("tr")
        self.open(name, attributes)
        if name == "col":
            self.stack.pop()
        if name in ("td", "th", "caption"):
            self.active.append(None)
        return None

    def end(self, name: str) -> None:
        if self.stack and self.here.space != HTML:
            for i in range(len(self.stack) - 1, 0, -1):
                if self.stack[i].space == HTML:
                    break
                if self.stack[i].name.lower() == name:
                    del self.stack[i:]
                    return
        if name == "head":
            self.ensure_head()
            self.leave_head()
        elif name in ("body", "html"):
            self.ensure_body()
            self.after_body = True
        elif name in HEAD_ONLY and self.body is None and any(n.name == name for n in self.stack):
            self.pop_to(name)
        elif name == "noscript" and self.body is None and self.here.name == "noscript":
            self.stack.pop()
        elif name == "p":
            self.ensure_body()
            if not self.has("p", frozenset(("button",))):
                self.open("p")
            self.close_p()
        elif name == "br":
            self.start("br", {}, False)
        elif name in HEADINGS:
            if self.has(HEADINGS):
                self.imply()
                self.pop_to(HEADINGS)
        elif name == "li":
            if self.has("li", frozenset(("ol", "ul"))):
                self.imply("li")
                self.pop_to("li")
        elif name in FORMATTING:
            if self.body is not None:
                self.adopt(name)
        elif name in ("table", "tbody", "thead", "tfoot", "tr", "td", "th", "caption"):
            if self.has(name, only=frozenset(("html", "table", "template")) - {name}):
                self.imply()
                self.pop_to(name)
                if name in ("td", "th", "caption"):
                    self.clear_active()
        elif name == "template":
            if any(n.name == "template" for n in self.stack):
                self.pop_to("template")
        elif name == "form":
            node, self.form = self.form, None
            if node is not None and node in self.stack:
                self.imply()
                if node in self.stack:
                    self.stack.remove(node)
        elif name in ("applet", "marquee", "object"):
            if self.has(name):
                self.imply()
                self.pop_to(name)
                self.clear_active()
        elif self.stack:
            if name in SPECIAL:
                if self.has(name):
                    self.imply()
                    self.pop_to(name)
            else:
                self.other_end(name)


def parse(source: bytes | str) -> Node:
    """The document tree of a page; every input has one."""
    s = decode_html(source).replace("\r\n", "\n").replace("\r", "\n")
    b, at, n, doctype = Builder(), 0, len(s), False
    while at < n:
        lt = s.find("<", at)
        if lt < 0:
            lt = n
        if lt > at:
            chunk = s[at:lt]
            b.characters(html.unescape(chunk) if "&" in chunk else chunk)
            at = lt
            continue
        if s.startswith("<!--", at):
            end = s.find("-->", at + 4)
            b.comment(s[at + 4 : end if end >= 0 else n])
            at = end + 3 if end >= 0 else n
        elif s[at : at + 9].lower() == "<!doctype":
            end = s.find(">", at)
            if not doctype and not b.stack:
                b.document.append(Node("doctype", name=s[at + 9 : end if end >= 0 else n].strip().lower()[:64]))
            doctype, at = True, end + 1 if end >= 0 else n
        elif s.startswith(("<!", "<?"), at) or s.startswith("</", at) and not _NAME.match(s, at + 2):
            end = s.find(">", at)
            b.comment(s[at + (1 if s[at + 1] == "?" else 2) : end if end >= 0 else n])
            at = end + 1 if end >= 0 else n
        else:
            close = s.startswith("</", at)
            m = _NAME.match(s, at + 1 + close)
            if not m:
                b.characters("<")
                at += 1
                continue
            e = _TAG_END.match(s, m.end())
            if not e:  # an unfinished tag at the end of the page is dropped
                break
            name, inside, at = m.group().lower(), s[m.end() : e.end() - 1], e.end()
            if close:
                b.end(name)
                continue
            raw = b.start(name, _attributes(inside) if inside.strip(" \t\n\f\r/") else {}, inside.endswith("/"))
            if raw:
                stop = n if raw == "plaintext" else _raw_end(s, raw, at)
                body = s[at:stop]
                if raw == "textarea" and body.startswith("\n"):
                    body = body[1:]
                b.raw(html.unescape(body) if raw in RCDATA and "&" in body else body)
                if b.here.name == raw:
                    b.stack.pop()
                gt = s.find(">", stop)
                at = gt + 1 if 0 <= gt and stop < n else n
            elif name in ("pre", "listing") and s.startswith("\n", at):
                at += 1
    b.ensure_body()
    return b.document


def _raw_end(s: str, name: str, at: int) -> int:
    m = re.compile(rf"</{name}(?=[\s/>])", re.I).search(s, at)
    return m.start() if m else len(s)


@dataclass
class Element:
    """An element of the projection: ids count all nodes in preorder, offsets count code points."""

    node_index: int
    parent_index: int | None
    subtree_end_index: int
    sibling_index: int
    depth: int
    tag: str
    namespace: str | None
    attributes: dict[str, str]
    text_direct: str
    text_start: int
    text_end: int


def elements(document: Node) -> tuple[list[Element], str]:
    """The elements in document order and the page's whole text, of which each element has a span."""
    out: list[Element] = []
    pieces: list[str] = []
    length, index = 0, 0
    # Entries: a node to enter, or (element, None) to close it.
    todo: list[tuple[Node | Element, Element | None]] = [(document, None)]
    kids: dict[int, int] = {}
    while todo:
        n, above = todo.pop()
        if isinstance(n, Element):
            n.subtree_end_index, n.text_end = index, length
            continue
        me = above
        here, index = index, index + 1
        if n.kind == "text":
            pieces.append(n.text)
            length += len(n.text)
        elif n.kind == "element":
            key = -1 if above is None else above.node_index
            kids[key] = kids.get(key, -1) + 1
            direct = "".join(c.text for c in n.children if c.kind == "text")
            me = Element(here, None if above is None else above.node_index, 0, kids[key], 0 if above is None else above.depth + 1, n.name, n.space, dict(sorted(n.attributes.items())), direct, length, 0)
            out.append(me)
            todo.append((me, None))
        todo += [(c, me) for c in reversed(n.children)]
    return out, "".join(pieces)


def walk(document: Node) -> Iterator[Node]:
    todo = [document]
    while todo:
        n = todo.pop()
        yield n
        todo += reversed(n.children)
