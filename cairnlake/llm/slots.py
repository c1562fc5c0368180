"""The slots of a body's template and the values that stand in them, as arrays over a batch of bodies.

A line stands in the slot of its place (its tag, and the how-manieth of that tag), in that of its tag alone (where
lines in between shift the places), in that of its masked text, and in that of its label before a colon. Slots and
values are hashes; what fills a slot on other pages of the site is compared later.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from cairnlake.llm.features import BARE_LABEL, NOTHING, ONLY_PLACE, PLACED, VARIES, hashed
from cairnlake.llm.kinds import BEFORE, BLANK, DATE, LINKS, OWN, REPEATED, SAMPLES, SHARE
from cairnlake.llm.pages import HEADINGS
from cairnlake.llm.words import mixed

UNIT = "struct<line:int,slot:bigint,value:bigint,size:int,extra:int,by:int>"
#: Of a body: slots with variable names outside of samples and whether one is in a heading; the characters that say
#: nothing and all that count; the hash of the masked body, the share of its characters that are not masked, the hash
#: of the body as it stands; the lines that stand in slots, and the values of the slots.
#: Of its own lines besides: the characters of all, and of those that are mostly fixed text the masked hash and size.
COLUMNS = f"own_size int, masks array<struct<mask:bigint,size:int>>, places int, in_heading boolean, empty int, total int, template bigint, fixed double, whole bigint, lines int, units array<{UNIT}>"
#: A line of a template has so many characters that are not masked.
LEAST_FIXED = 8
#: The value of a blank slot.
NONE = 0
# How a slot was told: by the tag alone or in a line the site repeats, by its place, text or label, by the place of the first heading.
TAGGED, BY_PLACE, HEADED = range(3)


def _sequence(page: np.ndarray, values: np.ndarray, n_pages: int) -> np.ndarray:
    """A hash of each page's values in their order; 0 for a page without any."""
    out = np.zeros(n_pages, np.uint64)
    if len(page):
        first = np.searchsorted(page, page)
        part = mixed(values.astype(np.int64).view(np.uint64), (np.arange(len(page)) - first).astype(np.uint64))
        with np.errstate(over="ignore"):
            np.add.at(out, page, part)
    return out.view(np.int64)


def values(n_pages: int, page: np.ndarray, tag: np.ndarray, kind: np.ndarray, lines: dict[str, np.ndarray]) -> dict[str, pa.Array]:
    """The columns ``COLUMNS`` of a batch of bodies, from their lines in order."""
    flags, size = lines["flags"], lines["size"].astype(np.int64)
    says = lambda bit: (flags & bit) != 0
    has = lambda *t: np.isin(tag.astype(str), t)
    sums = lambda mask, x: np.bincount(page[mask], x[mask], n_pages).astype(np.int64)
    heading, sample = has(*HEADINGS), has(*SAMPLES)
    blank = kind == BLANK
    counts = ~has("a") & ~np.isin(kind, (BEFORE, SHARE, DATE))
    full = counts & ~blank & (size > 0)
    weight = np.where(full & ~((kind == REPEATED) & ~says(NOTHING) & ~says(PLACED)), size, 0)
    place = (weight > 0) & ~sample & says(PLACED)
    nothing = np.where(place, np.where(says(ONLY_PLACE), weight, 0), np.where(says(NOTHING), weight, 0))
    own = full & (kind == OWN)
    chosen = np.where(np.bincount(page[own], minlength=n_pages)[page] > 0, own, full) if len(page) else full
    whole_size = np.maximum(sums(chosen, size), 1)
    # Slots.
    unit = full & ~sample & (nothing == 0)
    first = np.full(n_pages, -1)
    lead = np.flatnonzero(heading & ~np.isin(kind, (BEFORE, SHARE)))
    first[page[lead][::-1]] = lead[::-1]
    rank = np.zeros(len(page), np.int64)
    names, code = np.unique(tag.astype(str), return_inverse=True) if len(tag) else (np.zeros(0, str), np.zeros(0, np.int64))
    seen = np.flatnonzero(counts)
    order = seen[np.lexsort((seen, code[seen], page[seen]))]
    group = page[order] * max(len(names), 1) + code[order]
    rank[order] = np.arange(len(order)) - np.searchsorted(group, group)
    tag_hash = np.array([hashed(f"tag {n}") for n in names], np.int64).view(np.uint64)[code] if len(tag) else np.zeros(0, np.uint64)
    by = np.where(kind == OWN, BY_PLACE, TAGGED)
    index = np.arange(len(page))
    h = lines["h"]
    held = unit | counts & blank
    where = [held, unit, unit & says(VARIES), unit & (lines["label"] != 0)]
    slot = [
        mixed(tag_hash, rank.astype(np.uint64)), tag_hash, mixed(lines["masked"].view(np.uint64), np.uint64(2)), mixed(lines["label"].view(np.uint64), np.uint64(3)),
    ]
    value = [np.where(blank, NONE, h), h, h, np.where(says(BARE_LABEL), NONE, h)]
    told = [np.where(blank, BY_PLACE, np.where(index == first[page] if len(page) else False, HEADED, by)), np.full(len(page), TAGGED), by, by]
    at = np.concatenate([np.flatnonzero(w) for w in where])
    pick = lambda xs: np.concatenate([x[w] for x, w in zip(xs, where)])
    sort = np.argsort(at, kind="stable")
    at = at[sort]
    line = index - np.searchsorted(page, page)
    fields = {
        "line": line[at].astype(np.int32), "slot": pick(slot)[sort].view(np.int64), "value": pick(value)[sort].astype(np.int64), "size": size[at].astype(np.int32),
        "extra": (size - weight)[at].astype(np.int32), "by": pick(told)[sort].astype(np.int32),
    }
    offsets = pa.array(np.searchsorted(page[at], np.arange(n_pages + 1)).astype(np.int32))
    units = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(x) for x in fields.values()], names=list(fields)))
    i32 = lambda x: pa.array(x.astype(np.int32))
    said = own & ~has(*LINKS)
    firm = np.flatnonzero(said & (2 * lines["fixed"] >= size) & (lines["fixed"] >= LEAST_FIXED))
    masks = pa.ListArray.from_arrays(
        pa.array(np.searchsorted(page[firm], np.arange(n_pages + 1)).astype(np.int32)),
        pa.StructArray.from_arrays([pa.array(lines["masked"][firm]), i32(size[firm])], names=["mask", "size"]),
    )
    return {
        "own_size": i32(sums(said, size)), "masks": masks,
        "places": i32(np.bincount(page[place], minlength=n_pages)), "in_heading": pa.array(np.bincount(page[place & heading], minlength=n_pages) > 0),
        "empty": i32(sums(full, nothing)), "total": i32(sums(full, weight)), "template": pa.array(_sequence(page[chosen], lines["masked"][chosen], n_pages)),
        "fixed": pa.array(sums(chosen, lines["fixed"].astype(np.int64)) / whole_size), "whole": pa.array(_sequence(page[chosen], h[chosen], n_pages)),
        "lines": i32(np.bincount(page[held], minlength=n_pages)), "units": units,
    }
