"""What a line's text alone says of it, computed once for each distinct text and carried on as numbers.

The passes after the first one need no text: hashes stand for wordings, frames and words, bits for what phrases and
patterns say.
"""

from __future__ import annotations

import re
from typing import NamedTuple

import numpy as np
import xxhash

from cairnlake.llm.lexicon import PLACE, holds_place, says_nothing

#: Texts a process remembers before the memo is emptied.
MEMO = 50_000
#: A label before a colon is shorter, in characters.
LABEL_CHARACTERS = 40
#: A byline or prompt next to the headline has fewer words.
BYLINE_WORDS = 9

# Bits of ``Line.flags``.
LETTER, NOTHING, PROMPTLIKE, SEPARATOR, DATED, BYLINE, PLACED, ONLY_PLACE, VARIES, BARE_LABEL = (1 << k for k in range(10))

_NAMES = re.compile(r"\b[^\W\d_a-zß-ÿ][\w’'-]*|\d[\d.,]*")
_VARIES = re.compile(r"/\S+|\d[\d.,]*|\b[^\W\d_a-zß-ÿ][\w’'-]*")
_LETTER, _DIGIT, _SMALL = re.compile(r"[^\W\d_]"), re.compile(r"\d"), re.compile(r"\b[a-zß-ÿ][\w’'-]*")
_ALNUM = re.compile(r"[^\W_]")
_WORD = re.compile(r"[^\W_]+(?:['’-][^\W_]+)*")
_STOPS = tuple(".?!…:»”\"'")
_MONTHS = r"[^\W\d_]{3,10}\.?"
_DATE = re.compile(
    rf"^(?:[^\W\d_]+[,:]? )?(?:\d{{1,2}}[.,]? (?:de )?{_MONTHS}(?: de)? \d{{4}}|{_MONTHS} \d{{1,2}},? \d{{4}}|\d{{4}}-\d\d-\d\d|\d{{1,2}}[./]\d{{1,2}}[./]\d{{2,4}})(?:[ t,]+\d{{1,2}}:\d\d.*)?$"
)


def hashed(text: str) -> int:
    """A signed 64-bit hash."""
    return xxhash.xxh64_intdigest(text) - (1 << 63)


class Line(NamedTuple):
    """``h``: the hash of the wording; ``frame``: of a prompt's wording with names and numbers masked, 0 for other lines;
    ``size`` the characters of the wording; ``masked`` the hash of the wording with names, numbers and paths masked;
    ``label`` of what stands before a colon, 0 for none; ``fixed`` the characters that are not masked; ``words`` the
    hashes of its words."""

    h: int
    frame: int
    flags: int
    size: int
    masked: int
    label: int
    fixed: int
    words: np.ndarray


class Words(dict):
    """Word to a 64-bit hash; numbers share one."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest("0" if word[0].isdigit() else word)
        return h


class Lines(dict):
    """Text of a line to its ``Line``."""

    def __init__(self) -> None:
        super().__init__()
        self.memo = Words()

    def __missing__(self, text: str) -> Line:
        if len(self) >= MEMO:
            self.clear()
        line = self[text] = self.made(text)
        return line

    def made(self, text: str) -> Line:
        whole = " ".join(text.split())
        plain = whole.lower()
        letter, frame = bool(_LETTER.search(plain)), 0
        nothing, place = says_nothing(plain), holds_place(plain)
        stop, n_words = plain[-1:] in _STOPS, plain.count(" ") + 1
        flags = LETTER * letter | NOTHING * nothing | PLACED * place
        if letter and not nothing and not stop and not _DIGIT.search(whole) and len(_SMALL.findall(whole[:1].lower() + whole[1:])) >= 3:
            flags |= PROMPTLIKE
            frame = hashed((whole[:1] + _NAMES.sub("*", whole[1:])).lower())
        if not _ALNUM.search(plain):
            flags |= SEPARATOR
        if _DATE.match(plain):
            flags |= DATED
        if letter and not nothing and not stop and n_words < BYLINE_WORDS:
            flags |= BYLINE
        if place and not PLACE.sub("", plain).strip(" .,:;!?"):
            flags |= ONLY_PLACE
        masked = _VARIES.sub("*", whole).lower()
        if "*" in masked and _LETTER.search(masked):
            flags |= VARIES
        before, colon, rest = plain.partition(":")
        label = hashed(before) if colon and len(before) < LABEL_CHARACTERS else 0
        if label and not rest.strip():
            flags |= BARE_LABEL
        words = np.array([self.memo[w] for w in _WORD.findall(plain)], np.uint64)
        return Line(hashed(plain), frame, flags, len(plain), hashed(masked), label, len(masked) - masked.count("*"), words)
