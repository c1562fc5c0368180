"""The main body of every page: its lines, and why some of them are no part of the page's own piece.

Pages pass twice. The first pass takes lines and what their texts say (``features``) and leaves a compact table of page
structures in the shared folder; from it come the site-wide repetition counts. The second pass meets each site's
repeated wordings and finds the main body by composite text density, repeated lines counting as links. It reads no
text, and leaves with each body what the operators on residue and spam need: the values of the template's slots, the
words as hashes, and the counts of words and pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnlake.llm import pages, slots, words
from cairnlake.llm.boilerplate import LEAST_CONTENTS, LEAST_SHARE, _lists, with_site
from cairnlake.llm.features import BYLINE, DATED, LETTER, NOTHING, PROMPTLIKE, SEPARATOR, Lines
from cairnlake.llm.kinds import BEFORE, BLANK, CELLS, DATE, NOTICE, OWN, PROMPT, REPEATED, SHARE
from cairnlake.session import cut, written

#: A line is a notice of its site from so many contents ...
NOTICE_CONTENTS = 3
#: ... and this share of the site's contents.
NOTICE_SHARE = 0.05
#: A line in more than this share of the site's pages is furniture even where nothing else is left.
FURNITURE_SHARE = 0.9
#: A byline stands in so many lines below the headline.
BYLINE_LINES = 3
#: A frame is a prompt or byline from so many sites ...
FRAME_SITES = 4
#: ... and this share of all sites ...
FRAME_SITES_SHARE = 0.01
#: ... where it stands in this share of the site's contents.
FRAME_SHARE = 0.02

#: Tags whose repeated lines may still be the page's own, as subheadings or cells are.
KEEP_SOFT = (*CELLS, "li", "blockquote", "figcaption", "code", "pre", "caption", *pages.HEADINGS)
#: Tags that hold a value of the page, and are blank where it is missing.
VALUES = ("p", "li", "td", "dd", "blockquote", "figcaption", *pages.HEADINGS)
#: What the first pass keeps of each line, as arrays beside one another.
LINE_COLUMNS = {"h": "bigint", "frame": "bigint", "flags": "int", "size": "int", "masked": "bigint", "label": "bigint", "fixed": "int", "n_words": "int"}
STRUCTURE = (
    "content_id string, site string, page bigint, node array<int>, up array<int>, stop array<int>, tag array<string>, own array<int>, line array<int>, titled array<boolean>, "
    + "".join(f"{n} array<{t}>, " for n, t in LINE_COLUMNS.items())
    + "words array<bigint>"
)
_ARROW = {"bigint": np.int64, "int": np.int32}


def line_arrays(found: list) -> dict[str, np.ndarray]:
    """The ``Line`` tuples as one array for each of ``LINE_COLUMNS``, and all their words."""
    out = {n: np.fromiter((getattr(x, n) for x in found), _ARROW[t], len(found)) for n, t in LINE_COLUMNS.items() if n != "n_words"}
    out["n_words"] = np.fromiter((len(x.words) for x in found), np.int32, len(found))
    out["words"] = np.concatenate([x.words for x in found]) if found else np.zeros(0, np.uint64)
    return out


def structures(elements: DataFrame, capture: DataFrame, texts: bool = False) -> DataFrame:
    """One row per content and site: the element tree in document order, and what is known of the lines.

    The site (null for a content without capture) is joined to the gathered pages while they lie by content, so the
    texts are shuffled once. The texts themselves are kept only if asked for.
    """
    gathered = pages.whole_pages(elements).join(pages.content_pages(capture), "content_id", "left")
    gathered = gathered.select("content_id", "e", "site", F.coalesce("page", F.xxhash64("content_id")).alias("page"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Lines()
        for big in batches:
            for at in range(0, len(big), pages.PAGES_PER_BATCH):
                b = big.slice(at, pages.PAGES_PER_BATCH)
                f, flat = pages.forest(b.column(1))
                rows = pages.line_rows(f)
                w = flat.field("w")
                text = w.take(pa.array(f.take[rows]))
                found = line_arrays([memo[t] for t in text.to_pylist()])
                titles: dict[int, int] = {}
                at_title = np.flatnonzero(f.is_tag("title"))
                for p, t in zip(f.page[at_title].tolist(), w.take(pa.array(f.take[at_title])).to_pylist()):
                    if t and t.strip():
                        titles.setdefault(p, memo[t].h)
                titled = np.fromiter((titles.get(p) for p in f.page[rows].tolist()), object, len(rows)) == found["h"] if len(rows) else np.zeros(0, bool)
                base = np.searchsorted(f.page, np.arange(f.pages + 1))
                mine = np.searchsorted(f.page[rows], np.arange(f.pages + 1))
                first = base[f.page]
                tag = pa.DictionaryArray.from_arrays(pa.array(f.tag), pa.array(f.tags, pa.string())).cast(pa.string())
                i32 = lambda x: pa.array(x.astype(np.int32))
                ends = np.concatenate([[0], np.cumsum(found["n_words"])])
                columns = {
                    "content_id": b.column(0), "site": b.column(2), "page": b.column(3), "node": _lists(base, i32(f.node)), "up": _lists(base, i32(np.where(f.up < 0, -1, f.up - first))),
                    "stop": _lists(base, i32(f.stop - first)), "tag": _lists(base, tag), "own": _lists(base, i32(f.own)), "line": _lists(mine, i32(rows - first[rows])),
                    "titled": _lists(mine, pa.array(titled.astype(bool))), **{n: _lists(mine, pa.array(found[n])) for n in LINE_COLUMNS},
                    "words": _lists(ends[mine], pa.array(found["words"].view(np.int64))),
                }
                if texts:
                    columns["text"] = _lists(mine, text)
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return gathered.mapInArrow(run, STRUCTURE + (", text array<string>" if texts else ""))


def site_words(contents: DataFrame) -> DataFrame:
    """``site, hard, soft, most, frames``: hashes that are repeated on a site, one row per site that has any.

    ``hard`` are the wordings in a quarter of the pages, ``soft`` those in a twentieth, ``most`` those in more than
    nine tenths, ``frames`` the masked wordings that many sites share. By their shares of the site's pages, the lists are at
    most 4, 20, 2 and 50 times as long as a page has lines on average, whatever the number of pages. Contents of one
    address are one page here: a page that was captured again and again repeats nothing.
    """
    total = cut(contents.select("site", "page").distinct().groupBy("site").agg(F.count(F.lit(1)).alias("total")))
    sites = total.count()
    per = (
        contents.select("site", "page", F.explode(F.array_distinct("h")).alias("h")).distinct()
        .groupBy("site", "h").agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") >= NOTICE_CONTENTS)
        .join(total, "site").where(F.col("n") >= F.col("total") * NOTICE_SHARE)
    )
    is_hard = (F.col("n") >= LEAST_CONTENTS) & (F.col("n") >= F.col("total") * LEAST_SHARE)
    is_most = is_hard & (F.col("n") > F.col("total") * FURNITURE_SHARE)
    words = per.groupBy("site").agg(F.collect_list(F.when(is_hard, F.col("h"))).alias("hard"), F.collect_list("h").alias("soft"), F.collect_list(F.when(is_most, F.col("h"))).alias("most"))
    present = (
        contents.select("site", "page", F.explode(F.array_distinct(F.filter("frame", lambda x: x != 0))).alias("frame")).distinct()
        .groupBy("site", "frame").agg(F.count(F.lit(1)).alias("n"))
        .join(total, "site").where(F.col("n") >= F.col("total") * FRAME_SHARE).select("site", "frame")
    )
    shared = present.groupBy("frame").agg(F.count(F.lit(1)).alias("sites")).where(F.col("sites") >= max(FRAME_SITES, FRAME_SITES_SHARE * sites)).select("frame")
    frames = present.join(shared, "frame", "left_semi").groupBy("site").agg(F.collect_list("frame").alias("frames"))
    return words.join(frames, "site", "full")


BODY = (
    "content_id string, site string, page bigint, node array<int>, tag array<string>, kind array<int>, h array<bigint>, size array<int>, n_words array<int>, words array<bigint>, "
    f"{slots.COLUMNS}, tally array<{words.COUNT}>"
)


def _forest(b: pa.RecordBatch) -> tuple[pages.Forest, np.ndarray, np.ndarray]:
    """The forest of stored structures, the rows of its lines, and the page of each line."""
    col = {n: b.column(i) for i, n in enumerate(b.schema.names)}
    sizes = pc.list_value_length(col["node"]).to_numpy(zero_copy_only=False)
    page = np.repeat(np.arange(len(b)), sizes)
    first = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    flat = {n: col[n].flatten().to_numpy(zero_copy_only=False).astype(np.int64) for n in ("node", "up", "stop", "own", "line")}
    up = np.where(flat["up"] < 0, -1, flat["up"] + first[page])
    tag = pc.dictionary_encode(col["tag"].flatten())
    codes = tag.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    f = pages.Forest(page, flat["node"], up, flat["stop"] + first[page], codes, tag.dictionary.to_pylist(), flat["own"], np.arange(len(page)), len(b))
    of = np.repeat(np.arange(len(b)), pc.list_value_length(col["line"]).to_numpy(zero_copy_only=False))
    return f, flat["line"] + first[of], of


def _member(values: np.ndarray, of: np.ndarray, lists: pa.ListArray) -> np.ndarray:
    """Whether each value is in the list of its page."""
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    there = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    page = np.repeat(np.arange(len(lists)), sizes)
    mix = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        a = values.astype(np.uint64) * mix + of.astype(np.uint64)
        z = there.astype(np.uint64) * mix + page.astype(np.uint64)
    return np.isin(a, z)


def _headline(f: pages.Forest, rows: np.ndarray, of: np.ndarray, within: np.ndarray, titled: np.ndarray, link: np.ndarray) -> np.ndarray:
    """The first line of each page's body that is a first-level heading, else that repeats the title; -1 for none."""
    out = np.full(f.pages, -1)
    top = np.isin(f.tag[rows], [k for k, t in enumerate(f.tags) if t == "h1"])
    for mark in (titled & ~link[rows], top):
        at = np.flatnonzero(mark & within)
        out[of[at][::-1]] = rows[at][::-1]
    return out


def _bodies(b: pa.RecordBatch, texts: bool) -> pa.RecordBatch:
    f, rows, of = _forest(b)
    names = b.schema.names
    column = lambda n: b.column(names.index(n))
    flat = {n: column(n).flatten().to_numpy(zero_copy_only=False).astype(_ARROW[t]) for n, t in LINE_COLUMNS.items()}
    h, frame, flags = flat["h"], flat["frame"], flat["flags"]
    says = lambda bit: (flags & bit) != 0
    titled = column("titled").flatten().to_numpy(zero_copy_only=False).astype(bool)
    hard, soft, prompt = _member(h, of, column("hard")), _member(h, of, column("soft")), (frame != 0) & _member(frame, of, column("frames"))
    link = f.inside(f.is_tag("a", "button"))
    line_tag = lambda *t: np.isin(f.tag[rows], [k for k, x in enumerate(f.tags) if x in t])
    heading = line_tag(*pages.HEADINGS)
    may = ~line_tag(*KEEP_SOFT)
    other = says(NOTHING) | ~says(LETTER)
    weak = (soft | prompt) & may & ~hard & (~other & soft | says(PROMPTLIKE) & prompt & ~line_tag("a", "button"))
    noise, title = np.zeros(len(f.page), bool), np.zeros(len(f.page), bool)
    noise[rows[hard | weak]] = True
    title[rows[titled & ~link[rows]]] = True
    main = pages.main_body(f, noise, title)
    # Where nothing is left, or a headline that is no furniture was left out, the body is found again: with furniture as
    # noise only, then without any.
    furniture = np.zeros(len(f.page), bool)
    furniture[rows[_member(h, of, column("most"))]] = True
    lead = line_tag("h1") | titled & ~link[rows]
    muted = (line_tag("h1") | titled) & ~link[rows] & (hard | weak) & ~furniture[rows]
    inside_first = (main[of] >= 0) & (rows >= main[of]) & (rows < f.stop[np.maximum(main[of], 0)])
    again = np.bincount(of[muted], minlength=f.pages) > 0
    again &= np.bincount(of[lead & inside_first], minlength=f.pages) == 0
    again |= main < 0
    for left in (furniture, np.zeros(len(f.page), bool)):
        if again.any():
            second = pages.main_body(f, left, title)
            main = np.where(again & (second >= 0), second, main)
            again &= main < 0

    def inside_main() -> np.ndarray:
        top = main[of]
        return (top >= 0) & (rows >= top) & (rows < f.stop[np.maximum(top, 0)])

    within = inside_main()
    head = _headline(f, rows, of, within, titled, link)
    # A body without headline that opens like side matter gives way to a notice standing apart from it.
    own = np.flatnonzero(within & ~noise[rows])
    opening = np.full(f.pages, -1)
    opening[of[own][::-1]] = own[::-1]
    side = line_tag("a", "h3", "h4", "h5", "h6")
    asides = (head < 0) & (opening >= 0) & side[np.maximum(opening, 0)] if len(rows) else np.zeros(f.pages, bool)
    if asides.any():
        apart = np.flatnonzero(asides[of] & ~within & ~hard & ~link[rows] & (f.up[rows] >= 0) & says(NOTHING))
        apart = apart[~f.is_tag("body")[f.up[rows[apart]]]]
        main[of[apart]] = f.up[rows[apart]]
        within = inside_main()
        head = _headline(f, rows, of, within, titled, link)
    top = main[of]
    kind = np.zeros(len(rows), np.int64)
    kind[weak] = PROMPT
    kind[weak & soft] = NOTICE
    kind[hard & ~heading & ~line_tag(*CELLS)] = REPEATED
    # Separators between paragraphs are the piece's own, however often the site sets them.
    kind[within & (kind == REPEATED) & ~link[rows] & ~line_tag("span") & says(SEPARATOR)] = OWN
    kind[(head[of] >= 0) & (rows < head[of])] = BEFORE
    # Containers inside the main body that hold mostly such lines: bars to share, letters to order.
    holder = f.up[rows]
    loose = within & (holder >= 0) & (holder != top)
    if loose.any():
        ids, back = np.unique(holder[loose], return_inverse=True)
        bad = np.bincount(back, np.isin(kind[loose], (REPEATED, NOTICE, PROMPT)))
        every = np.bincount(back)
        listy = np.isin(f.tag[ids], [k for k, t in enumerate(f.tags) if t in ("ul", "ol", "dl", "tr", "table", "tbody", "article", "main", "section", "body")])
        gone = (2 * bad >= every) & ~listy
        at = np.flatnonzero(loose)
        kind[at[gone[back] & (kind[at] == OWN) & ~heading[at]]] = SHARE
    # Dates, and what stands like a byline in the first lines below the headline.
    place = np.arange(len(rows)) - np.where(head[of] >= 0, np.searchsorted(rows, head[of]), len(rows))
    plain = within & (kind == OWN) & (line_tag("time") | may)
    dated = plain & (line_tag("time") | says(DATED))
    kind[dated] = DATE
    kind[plain & ~dated & (place > 0) & (place <= BYLINE_LINES) & says(BYLINE) & line_tag("span", "div", "p", "small", "address")] = PROMPT
    # Leaves that would hold a value and are blank stand among the lines, with nothing in them.
    at = np.flatnonzero(within)
    index = np.arange(len(f.page))
    leaf = f.is_tag(*VALUES) & (f.own == 0) & (f.stop == index + 1) & ~link
    leaf[rows] = False
    leaf &= (main[f.page] >= 0) & (index > main[f.page]) & (index < f.stop[np.maximum(main[f.page], 0)])
    blank = np.flatnonzero(leaf)
    row = np.concatenate([rows[at], blank])
    order = np.argsort(row, kind="stable")
    row = row[order]
    kinds = np.concatenate([kind[at], np.full(len(blank), BLANK)])[order].astype(np.int32)
    lines = {n: np.concatenate([flat[n][at], np.zeros(len(blank), flat[n].dtype)])[order] for n in LINE_COLUMNS}
    every_word = column("words").flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    ends = np.cumsum(flat["n_words"])
    start = np.concatenate([(ends - flat["n_words"])[at], np.zeros(len(blank), np.int64)])[order]
    used = every_word[words.ranges(start, lines["n_words"])]
    tag = [f.tags[k] for k in f.tag[row]]
    out = feature_columns(f.pages, f.page[row], f.node[row], tag, kinds, lines, used)
    if texts:
        text = pa.concat_arrays([column("text").flatten().take(pa.array(at)), pa.array([""] * len(blank), pa.string())]).take(pa.array(order))
        out["text"] = _lists(np.searchsorted(f.page[row], np.arange(f.pages + 1)), text)
    first = {n: column(n) for n in ("content_id", "site", "page")}
    return pa.RecordBatch.from_arrays([*first.values(), *out.values()], names=[*first, *out])


def feature_columns(n_pages: int, page: np.ndarray, node: np.ndarray, tag: list[str], kind: np.ndarray, lines: dict[str, np.ndarray], used: np.ndarray) -> dict[str, pa.Array]:
    """The columns of ``BODY`` after the first three, from the lines of a batch of bodies in order."""
    offsets = np.searchsorted(page, np.arange(n_pages + 1))
    ends = np.concatenate([[0], np.cumsum(lines["n_words"])])
    i32 = lambda x: _lists(offsets, pa.array(np.asarray(x).astype(np.int32)))
    out = {
        "node": i32(node), "tag": _lists(offsets, pa.array(tag, pa.string())), "kind": i32(kind), "h": _lists(offsets, pa.array(lines["h"])), "size": i32(lines["size"]),
        "n_words": i32(lines["n_words"]), "words": _lists(ends[offsets], pa.array(used.view(np.int64))),
    }
    out |= slots.values(n_pages, page, np.array(tag, object), kind, lines)
    out["tally"] = words.tally(n_pages, page, kind, lines, used)
    return out


def bodies(elements: DataFrame, capture: DataFrame, texts: bool = False) -> DataFrame:
    """The lines of each content's main body in document order, one row per content and site: the columns of ``BODY``.

    ``kind`` says for each line whether it is the page's own or why not. A content without capture has a null site
    and no repeated lines; one without lines has empty arrays. Blank leaves of the body are of kind ``BLANK``. ``page``
    is one for all contents of an address. With ``texts`` there is a column ``text`` too. The table is written once to
    the shared folder.
    """
    contents = written(structures(elements, capture, texts), "structures")
    repeated = site_words(contents.where("site IS NOT NULL"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for at in range(0, len(big), pages.PAGES_PER_BATCH):
                yield _bodies(big.slice(at, pages.PAGES_PER_BATCH), texts)

    joined = with_site(contents, repeated, "left")
    return written(joined.mapInArrow(run, BODY + (", text array<string>" if texts else "")), "bodies")
