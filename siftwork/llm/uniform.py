"""Visually identical text with different characters (problem 2).

A transducer over grapheme clusters (a character with its combining marks and invisible characters). Its mapping is precomputed when the module is
loaded, by rule from the Unicode tables: widths and fonts (the compatibility forms tagged wide, narrow and font, and ligatures), spaces, invisible
characters, hyphens, pairs of a letter and a mark; and, for each state of the transducer, the look-alike letters. The state is the script of
the word: Latin, Cyrillic or undecided. The mapping of every state is checked for conflicts: no input has two outputs, and no output is an input.
It is compiled into one pattern of longest matches, whose units are read in one pass; a word is put out when its state is known.

* A word's letters that only one script has decide its state. If both scripts have such letters, only whole parts are turned that are
  look-alikes throughout and beside the other script.
* A word of look-alikes throughout ("cop") is undecided. A run of such words in small letters between two words of one script, with single
  spaces, takes that script; a single Latin letter does so behind a comma or semicolon, too, and as a capital.
* Marks are ordered by class and joined pairwise with the letter, however many there are.

Words of two scripts joined by a hyphen, or run together by the normalisation of finding values (there, whole parts of either
script stay), are no mixtures. A soft hyphen before a line's end is scanned hyphenation and left alone, and so is ь + і for ы.

Defined cases: null gives null, text without such characters comes out as it is; the result is stable under a second pass.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import numpy as np

from pyspark.sql import DataFrame

from siftwork.llm import chars
from siftwork.util import map_batches

INVISIBLE = "­͏؜᠎​‌‍‎‏‪‫‬‭‮⁠⁡⁢⁣⁤︎️﻿"
SPACES = "               　"
#: Look-alike letters, Latin beside Cyrillic, those of Greek, and further Cyrillic ones that look Latin (fixed values).
LATIN, CYRILLIC = "aceopxyABCEHKMOPTXYisjIJS", "асеорхуАВСЕНКМОРТХУіѕјІЈЅ"
GREEK_LATIN = dict(zip("αορνικυχΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aopvikuxABEZHIKMNOPTYX"))
MORE_LATIN = dict(zip("һԁԛԝԚԜ", "hdqwQW"))
#: In finding values capitals have become small letters.
LOWERED = dict(zip("bhkmt", "внкмт"))
#: Letters with marks that Russian has.
MARKED = "ёЁйЙ"
TO_CYRILLIC = {a: b for a, b in zip(LATIN, CYRILLIC) if b not in "іѕјІЈЅ"}
TO_LATIN = dict(zip(CYRILLIC, LATIN)) | MORE_LATIN
#: Words that spelled-out addresses put between parts.
JOINTS = ("собака", "точка", "дефис", "тире")
MARKS = "\u0300-\u036f\u3099\u309a"
SOFT = "\u00ad"


def conflict_free(m: dict[str, str]) -> dict[str, str]:
    for k, v in m.items():
        if v in m or any(c in m for c in v):
            raise ValueError(f"{k!r} gives {v!r}, which is mapped on")
    return m


def singles() -> dict[str, str]:
    """Characters that are written otherwise wherever they stand."""
    m: dict[str, str] = {}

    def put(k: str, v: str) -> None:
        if m.setdefault(k, v) != v:
            raise ValueError(f"two outputs for {k!r}")

    for c in INVISIBLE:
        put(c, "")
    for c in SPACES:
        put(c, " ")
    for c in "‐‑":
        put(c, "-")
    for o in [*range(0x80, 0xD800), *range(0xE000, 0x20000)]:
        tag, _, form = unicodedata.decomposition(chr(o)).partition(" ")
        if chr(o) not in m and (tag in ("<wide>", "<narrow>", "<font>") or 0xFB00 <= o <= 0xFB06):
            out = unicodedata.normalize("NFKC", chr(o)) if tag == "<compat>" else "".join(chr(int(x, 16)) for x in form.split())
            put(chr(o), m.get(out, out))
    return conflict_free(m)


def pairs() -> dict[str, str]:
    """Letter + mark -> the letter with the mark."""
    m = {}
    for o in [*range(0xC0, 0x3100), *range(0xF900, 0xFFFE)]:
        form = unicodedata.decomposition(chr(o)).split()
        if len(form) == 2 and form[0][0] != "<":
            base, mark = (chr(int(x, 16)) for x in form)
            if base.isalpha() and re.match(f"[{MARKS}]", mark) and unicodedata.normalize("NFC", base + mark) == chr(o):
                m[base + mark] = chr(o)
    return conflict_free(m)


SINGLES, PAIRS = singles(), pairs()
MAPPING = SINGLES | PAIRS


def looks(m: dict[str, str], lowered: bool) -> dict[str, str]:
    """One state's mapping of look-alikes, with their Russian marked forms."""
    out = dict(m)
    for c in MARKED:
        base, mark = unicodedata.normalize("NFD", c)
        for a, b in m.items():
            for x, y in ((a, b),):
                if base == y and (whole := unicodedata.normalize("NFC", x + mark)) and len(whole) == 1:
                    out[whole] = c
                elif base == x and len(unicodedata.normalize("NFC", y + mark)) == 1:
                    out[c] = unicodedata.normalize("NFC", y + mark)
    return conflict_free(out)


_class = lambda cs: "[" + "".join(map(re.escape, sorted(cs))) + "]"
_single = _class(SINGLES)
_wide_letters = "".join(k for k, v in SINGLES.items() if v and v.isalpha())
_LETTER = "A-Za-zÀ-ʯḀ-ỿͰ-Ͽἀ-\u1fffЀ-ԯ" + "".join(map(re.escape, (c for c in _wide_letters if re.fullmatch("[A-Za-zÀ-ʯḀ-ỿͰ-Ͽἀ-\u1fffЀ-ԯ]+", SINGLES[c]))))
_HIDDEN = INVISIBLE.replace(SOFT, "") + "\\u0300-\\u036f"
#: Longest matches: a soft hyphen at a line's end, a word with its marks and invisible characters, another cluster, or a single input.
_unit = re.compile(f"{SOFT}(?=[ \\t]*\\n)|(?P<word>[{_LETTER}](?:[{_LETTER}{_HIDDEN}]|{SOFT}(?![ \\t]*\\n))*)|(?P<other>\\S[{MARKS}\uff9e\uff9f]+|{_single}[{MARKS}\uff9e\uff9f]*)")
_special = re.compile(f"{_single}|[{MARKS}]")
_parts = re.compile("[A-Za-zÀ-ʯḀ-ỿ]+|[Ѐ-ԯ]+|[Ͱ-Ͽἀ-\u1fff]+")
_cyr = re.compile("[Ѐ-ԯ]")
_lat = re.compile("[A-Za-zÀ-ʯḀ-ỿ]")
_grk = re.compile("[Ͱ-Ͽἀ-\u1fff]")

_INPUT, _L, _C, _G, _LOOK = 1, 2, 4, 8, 16
_flags = chars.table(
    (_INPUT, [*(c for c in SINGLES if ord(c) < 0x10000), (0x300, 0x36F), (0x370, 0x3FF), (0x3099, 0x309A), *"ЅІЈѕіј", *MORE_LATIN, "\uffff"]),
    (_L, [(0x41, 0x5A), (0x61, 0x7A), (0xC0, 0x2AF), (0x1E00, 0x1EFF)]), (_C, [(0x400, 0x52F)]), (_LOOK, [*LATIN, *CYRILLIC]),
)


def triggered(texts: list[str]) -> np.ndarray:
    """Which texts may have an input: an odd character, scripts side by side, or a word of look-alikes beside the other script."""
    c, starts = chars.joined(texts)
    f = _flags[c]
    m = (f & _INPUT) > 0
    lat, cyr = (f & _L) > 0, (f & _C) > 0
    m[:-1] |= lat[:-1] & cyr[1:] | cyr[:-1] & lat[1:]
    # a word of look-alikes throughout, behind a letter of the other script (or its comma) and before one, or before another such word
    at = np.flatnonzero(c == 32)
    at = at[(at > 1) & (at < len(c) - 1)]
    if len(at) > 1:
        i, j = at[:-1], at[1:]
        for own, other in ((lat, cyr), (cyr, lat)):
            look = own & ((f & _LOOK) > 0)
            total = np.cumsum(look)
            whole = (j - i > 1) & (total[j - 1] - total[i] == j - i - 1)
            comma = ((c[i - 1] == 44) | (c[i - 1] == 59)) & other[i - 2] if own is lat else False
            hit = whole & (other[i - 1] | comma) & (other[j + 1] | look[j + 1])
            m[i[hit] + 1] = True
    return chars.texts_with(m, starts)


def neutral(s: str) -> str:
    """Single inputs written otherwise, marks ordered and joined with their letters."""
    out: list[str] = []
    marks: list[str] = []

    def close() -> None:
        if not marks:
            return
        base, kept, last = (out.pop() if out else ""), [], 0
        for k in sorted(marks, key=unicodedata.combining):
            cc = unicodedata.combining(k)
            if base and last != cc and base + k in PAIRS:
                base = PAIRS[base + k]
            else:
                kept.append(k)
                last = cc
        out.append(base + "".join(kept))
        marks.clear()

    for c in s:
        for x in SINGLES.get(c, c):
            if unicodedata.combining(x):
                marks.append(x)
            else:
                close()
                out.append(x)
    close()
    return "".join(out)


class Uniform:
    """Brings texts to one form; lowered: the text is a finding's value."""

    def __init__(self, lowered: bool = False):
        self.lowered = lowered
        self.cyr = looks(TO_CYRILLIC | (LOWERED if lowered else {}), lowered)
        self.lat = looks(TO_LATIN | ({b: a for a, b in LOWERED.items()} if lowered else {}), lowered)
        #: Words are few and come again; the table of those seen is bounded.
        self.known = lru_cache(100_000)(lambda w: (y := w if w.isascii() else self.word(w), self.state(y), y.islower()))
        self.to_cyr, self.to_lat, self.greek = str.maketrans(self.cyr), str.maketrans(self.lat), str.maketrans(conflict_free(GREEK_LATIN))

    def word(self, w: str) -> str:
        """A letter turned may join with its mark or decide the word's state anew, so this goes on until nothing changes."""
        seen = {w}
        while True:
            y = self.turned(neutral(w) if _special.search(w) else w)
            if y == w or y in seen:
                return y
            seen.add(y)
            w = y

    def turned(self, w: str) -> str:
        """The look-alike letters of the other script turned to the word's."""
        g = _grk.findall(w)
        if g and all(c in GREEK_LATIN for c in g) and (_lat.search(w) or _cyr.search(w)):
            w = w.translate(self.greek)
        if not _cyr.search(w) or not _lat.search(w):
            return w
        only_cyr = sum(c not in self.lat for c in _cyr.findall(w))
        only_lat = sum(c not in self.cyr for c in _lat.findall(w))
        if only_cyr and only_lat:
            return self.joined(w)
        if only_lat or (not only_cyr and len(_lat.findall(w)) > len(_cyr.findall(w))):
            return w.translate(self.to_lat)
        return w.translate(self.to_cyr)

    def joined(self, w: str) -> str:
        """A word with letters that only one script has, of both: parts that are look-alikes throughout take their neighbours' script."""
        parts = _parts.findall(w)
        if "".join(parts) != w:
            return w
        out: list[str] = []
        for k, p in enumerate(parts):
            near = [parts[j] for j in (k - 1, k + 1) if 0 <= j < len(parts)]
            if any(n in JOINTS for n in near) or p in JOINTS:
                out.append(p)
            elif _cyr.match(p) and all(c in self.lat for c in p):
                out.append(p.translate(self.to_lat))
            elif _lat.match(p) and all(c in self.cyr for c in p):
                out.append(p.translate(self.to_cyr))
            else:
                out.append(p)
        return "".join(out)

    def state(self, w: str) -> str:
        """L or C, small if the word is of look-alikes throughout; empty for other scripts and mixtures."""
        c, t = bool(_cyr.search(w)), bool(_lat.search(w))
        if c == t:
            return ""
        if c:
            return "c" if all(x in self.lat for x in w) else "C"
        return "l" if all(x in self.cyr for x in w) else "L"

    def __call__(self, s: str | None) -> str | None:
        if not s:
            return s
        out: list[str] = []
        #: The last decided state, whether its word is small, and where the undecided words behind it stand in out.
        last, small, waiting = "", False, []
        at, gap = 0, ""
        for m in _unit.finditer(s):
            a, b = m.span()
            x = m[0]
            gap += s[at:a]
            out.append(s[at:a])
            at = b
            if m.lastgroup != "word":
                y = x if x == SOFT and m.lastgroup is None else neutral(x)
                out.append(y)
                gap += y
                continue
            y, now, low = self.known(x)
            if not self.lowered:
                plain = gap == " " or gap in (", ", "; ") and len(y) == 1 and now == "l" and not waiting
                if now in ("l", "c") and last and plain and (low or len(y) == 1 and now == "l"):
                    waiting.append((len(out), now, y))
                else:
                    if waiting and gap == " " and now == last and y[:1].islower() and (small or all(w[1] == "l" and len(w[2]) == 1 for w in waiting)):
                        for k, script, w in waiting:
                            if script.upper() != last:
                                out[k] = w.translate(self.to_cyr if last == "C" else self.to_lat)
                    waiting = []
                    last, small = (now if now in ("L", "C") else "", low)
                    if now in ("l", "c"):
                        last = ""
            out.append(y)
            gap = ""
        out.append(s[at:])
        return "".join(out)


def unify(rows: DataFrame, key: str, text: str, lowered: bool = False, unless=None) -> DataFrame:
    """(key, uniform) of the rows whose text has a character that looks like another.

    unless() is called once in each worker and gives a function that says of a changed text whether it is to be left out.
    """

    def make():
        u = Uniform(lowered)
        skip = unless() if unless else None

        def f(ids, texts):
            hit = triggered([t or "" for t in texts])
            found = [(i, s) for i, t, x in zip(ids, texts, hit) if x for s in [u(t)] if s != t and not (skip and skip(t))]
            return [[x[0] for x in found], [x[1] for x in found]]

        return f

    return map_batches(rows.select(key, text), make, f"{key} {dict(rows.dtypes)[key]}, uniform string")
