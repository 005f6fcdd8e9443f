"""Sentence units of texts in many scripts (problem 9), by document-centred disambiguation.

Whether a full stop ends a sentence depends on the token before it and the word after it. Both are decided by the document's own
unambiguous occurrences first: a token whose stop is followed by lower case or a comma elsewhere in the document is an abbreviation; a next word
that also stands in lower case is a common word, one that is capitalised behind a lower-case word a name. Corpus counts come second: words
that follow unambiguous ends (`starters`), and tokens whose stop is followed by lower case, figures or by words that aren't starters
(`abbreviations`). A short token without a vowel is an abbreviation wherever it stands. Scripts without case use their own terminators: 。！？ for
Chinese and Japanese, danda for Hindi (a full stop there marks abbreviations only), ؟ and a stop after a long token for Arabic, and for Thai the
space between two Thai letters.

Corpus counts cover every document and have fixed least counts. Up to MAX_WORDS words of evidence are sent to the workers; beyond that,
each document is joined with the evidence on its own tokens.

Defined cases: null, empty and blank texts have no units; repeated rows give repeated units; very long texts take linear time; a
quotation is protected up to its paragraph's end, however long it is; a token of more than LONGEST characters is no abbreviation.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwork.util import checkpoint, map_batches, map_rows

#: How often starters and abbreviations must be seen at least.
LEAST = 2
#: How many words of corpus evidence are sent to the workers at most.
MAX_WORDS = 200_000
LONGEST = 64
CLOSE = "\"'»”’“)\\]）」』】〉》›"
UPPER = "A-ZА-ЯЁÀ-ÖØ-Þ"
LETTERS = "[^\\W\\d_]"

_abbr = re.compile(rf"(?<![\w.@+\-])({LETTERS}{{1,6}}|\d+)\.(?:[ \n\xa0]{{1,2}}[«“„\"(]?(?={LETTERS})|(?=,)|[ \xa0](?=[+№]|\d+(?![\d.)])))({LETTERS}+|[,\d+№])")
_start = re.compile(rf"(?:\n\s*\n|^|[!?][»”\"“)]?[ \n]+|[a-zа-яёäöüß]{{4}}\.[ \n]+)[«“„\"(]?([{UPPER}]\w*)")
_mid = re.compile(rf"[a-zа-яёäöüß0-9],?[ \n]([{UPPER}]\w*)")

_within = lambda inner: f"(?:[^{inner}\\n]+|\\n(?!\\s*\\n))*+"
_protect = re.compile(
    f"«{_within('«»')}»|„{_within('„“”')}[“”]|“{_within('“”')}”|(?<![\\w.,!?…])\"(?=\\S){_within(chr(34))}\"|「[^「」\\n]*+」|『[^『』\\n]*+』|（[^（）\\n]*+）|\\({_within('()')}\\)"
)
_ends = re.compile(f"[.!?…。！？।॥؟]+[{CLOSE.replace('“', '')}]*|\\n\\s*|[\\u0e00-\\u0e7f][ \\xa0]+(?=[\\u0e00-\\u0e7f])")
_last = re.compile(r"[\w.]*\Z")
_visible = re.compile(r"\S")
_chunk = re.compile(r"\S+")
_vowel = re.compile("[aeiouyäöüаеёиоуыэюя]", re.I)
_own_low = re.compile(r"(?<![\w.@+/-])([^\W\d_]\w*)(?![\w@+/-]|\.\w)")
_own_mid = re.compile(r"[a-zа-яёäöüß],? (?=([^\W\d_]+)(?!\w))")
_own_abbr = re.compile(rf"(?<![\w.@+\-])({LETTERS}{{1,6}})\.(?:,|[ \n\xa0]{{1,2}}(?=[a-zа-яёäöüß](?![{UPPER}])))")
_list_mark = re.compile(r"[ \t]*(?:\d{1,3}[.)]|[-–—•*·]|[a-zа-я]\))\s")
_next = re.compile(rf"\s*[«“„\"'(\[「『（]*({LETTERS}*)")
_initial = re.compile(rf"[ \n\xa0]*{LETTERS}\.")
#: Another short word with a stop and a figure: a chain of references.
_chain = re.compile(rf"[ \n\xa0]*{LETTERS}{{1,5}}\. ?\d")
_heading_rest = re.compile(r"[ \t]*[^\n.!?;:,]{1,40}(?:\n|\Z)")
_devanagari = re.compile("[\\u0900-\\u097f]")
_caseless = re.compile("[\\u0600-\\u06ff\\u0900-\\u097f\\u0e00-\\u0e7f\\u3040-\\u30ff\\u3400-\\u9fff]")


def counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Corpus evidence (kind, a, b, n), added up in the workers before it is shuffled."""

    def make():
        def f(texts):
            c: Counter = Counter()
            for t in texts:
                if not t:
                    continue
                c.update([("a", x if len(x) > 1 and not x.isdigit() else "1" if x.isdigit() else x, y if y[0].isalpha() or y == "," else "0") for x, y in _abbr.findall(t)])
                c.update([("s", x, "") for x in _start.findall(t)])
                c.update([("m", x, "") for x in _mid.findall(t)])
            k = list(c)
            return [[x[0] for x in k], [x[1] for x in k], [x[2] for x in k], list(c.values())]

        return f

    part = map_batches(docs.select(text), make, "kind string, a string, b string, n bigint")
    return part.groupBy("kind", "a", "b").agg(F.sum("n").alias("n"))


def evidence(docs: DataFrame, text: str = "text") -> DataFrame:
    """(kind, word): the starters (s) and abbreviations (a) of a corpus."""
    c = counts(docs, text).persist()
    try:
        words = (
            c.filter("kind in ('s', 'm')").groupBy("a").agg(F.sum(F.when(F.col("kind") == "s", F.col("n"))).alias("s"), F.sum(F.when(F.col("kind") == "m", F.col("n"))).alias("m"))
            .filter((F.col("s") >= LEAST) & (F.col("s") > 2 * F.coalesce("m", F.lit(0))))
        )
        pairs = c.filter("kind = 'a'").join(words.select(F.col("a").alias("b"), F.lit(1).alias("starter")), "b", "left")
        lower = (F.col("b") == ",") | F.col("b").rlike("^\\p{Ll}(?!\\p{Lu})")
        by = pairs.groupBy("a").agg(
            F.sum("n").alias("n"),
            F.sum(F.when(lower, F.col("n")).otherwise(0)).alias("low"),
            F.sum(F.when(~lower & F.col("starter").isNull() & (F.upper(F.substring("b", 1, 1)) != F.lower(F.substring("b", 1, 1))), F.col("n")).otherwise(0)).alias("name"),
            F.sum(F.when(F.col("b") == "0", F.col("n")).otherwise(0)).alias("figure"),
        )
        abbr = by.filter((F.col("n") >= LEAST) & ((F.col("low") >= 0.05 * F.col("n")) | (F.col("name") >= 0.5 * F.col("n")) & (F.col("n") >= 5) & (F.length("a") <= 4) | (F.col("figure") >= 0.5 * F.col("n"))))
        # words in capitals throughout are emphasis
        abbr = abbr.filter(~F.col("a").rlike("^\\p{Lu}{3,}$"))
        return checkpoint(words.select(F.lit("s").alias("kind"), F.col("a").alias("word")).union(abbr.select(F.lit("a"), F.col("a"))))
    finally:
        c.unpersist()


def with_own(docs: DataFrame, known: DataFrame, text: str) -> DataFrame:
    """Adds starters and abbreviations: the part of the corpus's evidence that a document may ask for. Equal texts ask once."""

    def asked(key, t):
        out = set()
        for m in _ends.finditer(t):
            if m[0][0] == ".":
                i = at = m.start()
                while i and at - i <= LONGEST and not t[i - 1].isspace():
                    i -= 1
                token = own_token(t[i:at])
                parts = token.split(".")
                out |= {("a", x) for k in range(len(parts)) for y in (".".join(parts[k:]),) for x in (y, y.lower())}
                out.add(("s", _next.match(t, m.end())[1]))
        return [(key, k, x) for k, x in out if x]

    keyed = docs.withColumn("_key", F.md5(text))
    used = map_rows(keyed.filter(F.length(text) > 0).select("_key", text).dropDuplicates(["_key"]), lambda: asked, "_key string, kind string, word string")
    per = used.join(known, ["kind", "word"]).groupBy("_key").agg(*[F.collect_list(F.when(F.col("kind") == k, F.col("word"))).alias(n) for k, n in (("s", "starters"), ("a", "abbreviations"))])
    return keyed.join(per, "_key", "left").drop("_key")


def lower(word: str) -> bool:
    """Begins in lower case, unlike iScan."""
    return word[:1].islower() and not word[1:2].isupper()


def own_token(chunk: str) -> str:
    """The end of a chunk that may be an abbreviation."""
    token = chunk.lstrip("«“„\"'([（「")
    k = len(token)
    while k and (token[k - 1].isalnum() or token[k - 1] in ".\u0301" or "\u0900" <= token[k - 1] <= "\u097f"):
        k -= 1
    return token[k:]


class Own:
    """What a document's own unambiguous places say, each read in one pass when first asked for."""

    def __init__(self, text: str):
        self.text = text

    @cached_property
    def common(self) -> set[str]:
        """Words that stand in lower case."""
        return {w for w in _own_low.findall(self.text) if w[0].islower()}

    @cached_property
    def names(self) -> set[str]:
        """Words that stand behind a lower-case word as they are."""
        return set(_own_mid.findall(self.text))

    @cached_property
    def abbreviations(self) -> set[str]:
        return set(_own_abbr.findall(self.text))

    @cached_property
    def chunks(self) -> tuple[list[int], list[tuple[bool, int]]]:
        """(starts, (has @, first / or _)) of the chunks with any of these, between white space."""
        starts, what = [], []
        if "@" in self.text or "/" in self.text or "_" in self.text:
            for m in _chunk.finditer(self.text):
                c = m[0]
                if "@" in c or "/" in c or "_" in c:
                    starts.append(m.start())
                    what.append((m.end(), "@" in c, m.start() + min(k for k in (c.find("/"), c.find("_"), len(c)) if k >= 0)))
        return starts, what

    def address(self, at: int) -> bool:
        """Does place `at` lie in an address or behind a slash or underscore of its chunk?"""
        starts, what = self.chunks
        k = bisect_right(starts, at) - 1
        return k >= 0 and at < what[k][0] and (what[k][1] or what[k][2] < at)


class Splitter:
    """Cuts one text; starters and abbreviations come from evidence()."""

    def __init__(self, starters=frozenset(), abbreviations=frozenset()):
        self.starters, self.abbr = frozenset(starters), frozenset(abbreviations)

    def common(self, word: str, own: Own) -> bool | None:
        """Is the capitalised word a common one? The document's own evidence first, then the corpus's; None: unknown."""
        low = word.lower()
        if low != word and low in own.common:
            return True
        if word in self.starters:
            return True
        return False if word in own.names else None

    def is_abbreviation(self, token: str, own: Own) -> bool:
        """The form decides for single letters, dotted pairs and short tokens without a vowel; then the document, then the corpus."""
        if len(token) == 1 and token.isalpha():
            return True
        if "." in token and all(len(x) <= 2 for x in token.split(".")):
            return True
        if 1 < len(token) <= 4 and token.isalpha() and not token[1:].isupper() and not _vowel.search(token) and not _caseless.match(token):
            return True
        return token in own.abbreviations or token in self.abbr or token.lower() in self.abbr

    def stop(self, s: str, at: int, begin: int, glued: bool, nxt: str, own: Own) -> bool:
        """Does the full stop at `at` end a sentence, the next word being nxt?"""
        if glued and own.address(at):
            return False
        i = at
        while i > begin and at - i <= LONGEST and not s[i - 1].isspace():
            i -= 1
        chunk = s[i:at]
        token = own_token(chunk)
        alone = len(token) == len(chunk.lstrip("«“„\"'([（「"))
        first = nxt[:1]
        if len(token) == 1 and len(nxt) == 1 and _initial.match(s, at + 1):
            return False  # И. о., Z. B., two initials
        if (token.isdigit() or len(token) == 1) and _heading_rest.match(s, at + 1) and at - begin < 30 and (begin == 0 or "\n" in s[max(0, begin - 2) : begin + 1]):
            return False  # a heading with its number
        if token and _caseless.match(token[-1]):
            return not _devanagari.match(token[-1]) and not self.is_abbreviation(token, own) and len(token) > 2
        if token[-1:].isdigit():
            digits = token.isdigit() and len(token) <= 2 and alone
            if not digits:
                return True
            return not first or bool(self.common(nxt, own)) or bool(_caseless.match(first))
        if self.is_abbreviation(token, own):
            if not first or _chain.match(s, at + 1):
                return False
            return bool(self.common(nxt, own))
        return True

    def ends(self, s: str) -> list[int]:
        out: list[int] = []
        spans = [(m.start(), m.end()) for m in _protect.finditer(s)]
        k, begin, n = 0, 0, len(s)
        width, wrapped = self.layout(s)
        own = Own(s)
        for m in _ends.finditer(s):
            at, end = m.span()
            if end <= begin:
                continue
            c = s[at]
            while k < len(spans) and spans[k][1] <= at:
                k += 1
            if c == "\n":
                if k < len(spans) and spans[k][0] < at:
                    continue
                if self.line_end(s, at, begin, width, wrapped):
                    out.append(at)
                    begin = end
                continue
            if "\u0e00" <= c <= "\u0e7f":
                if not (k < len(spans) and spans[k][0] < at):
                    out.append(at + 1)
                    begin = end
                continue
            if k < len(spans) and spans[k][0] < at:  # inside a quotation or brackets
                if spans[k][1] == end + 1 and s[end] == "“":
                    end += 1
                if spans[k][1] > end:
                    continue
                inner = True
                opened = spans[k][0]
            else:
                inner, opened = False, 0
            tail = s[end : end + 1]
            if tail and not tail.isspace() and not inner and m[0][-1] in ".":
                # glued: only before a capital, after a lower-case letter or a digit with a hyphenated ending
                if not (tail.isupper() or tail in "«“„\"(") or not (s[at - 1 : at].islower() or s[at - 1 : at] in CLOSE.replace("\\", "")):
                    if not (tail in "«“„\"(" or _caseless.match(tail) and _caseless.match(s[at - 1 : at])):
                        continue
            nm = _next.match(s, end)
            nxt = nm[1]
            j = end
            while j < n and s[j].isspace():
                j += 1
            following = s[j : j + 1]
            # a line's end in a hard-wrapped text is no more than a space
            newline = "\n" in s[end:j] and (not wrapped or self.para(s, end, j))
            if inner and opened > begin and s[opened] in "(（" and _visible.search(s, begin, opened):
                continue  # brackets within a sentence
            if not newline and following and following in ",;:—–-…)»”":
                continue
            if lower(nxt) and not (newline and self.line_end(s, end, begin, width, wrapped)):
                continue
            if m[0][0] == "…" or m[0].startswith("..."):
                if nxt and not nxt[0].isupper() and not newline:
                    continue
            elif m[0][0] == ".":
                if at == begin or (mark := _list_mark.match(s, begin)) and mark.end() > at:
                    continue
                if s[at - 1 : at].isdigit() and s[end : end + 1].isdigit():
                    continue
                if j < n and not self.para(s, end, j) and not self.stop(s, at, begin, end == j, nxt, own):
                    continue
                if following.isdigit() and not newline and self.is_abbreviation(_last.search(s, max(begin, at - LONGEST), at)[0], own):
                    continue
            if inner and s[opened] not in "(（" and nxt and _caseless.match(nxt) and not newline:
                continue  # the sentence goes on behind a quotation, or its speaker follows
            out.append(end)
            begin = end
        out.append(n)
        return out

    @staticmethod
    def para(s: str, i: int, j: int) -> bool:
        """Is there a blank line in s[i:j]?"""
        return s.count("\n", i, j) > 1

    @staticmethod
    def layout(s: str) -> tuple[int, bool]:
        """(width, whether the text is hard-wrapped): most line ends are where the next word didn't fit."""
        if "\n" not in s:
            return 0, False
        lines = [x.rstrip() for x in s.split("\n")]
        width = max(map(len, lines))
        if width > 110:
            return width, False
        full = other = 0
        for a, b in zip(lines, lines[1:]):
            if a and b:
                if len(a) + 1 + len(b.split(None, 1)[0]) > width - 3:
                    full += 1
                else:
                    other += 1
        return width, full > other

    def line_end(self, s: str, at: int, begin: int, width: int, wrapped: bool) -> bool:
        """Does the line end at `at`, without an end mark before it, separate units?"""
        if not _visible.search(s, begin, at):
            return False
        j = at + 1
        while j < len(s) and s[j] in " \t\xa0\r":
            j += 1
        if j >= len(s) or s[j] == "\n":
            return True
        mark = _list_mark.match(s, at + 1)
        if mark and not (wrapped and mark[0].strip() in "-–—"):
            return True
        start = s.rfind("\n", 0, at) + 1
        stop = j
        while stop < len(s) and not s[stop].isspace():
            stop += 1
        line, word = s[start:at].rstrip(), s[j:stop]
        if lower(word):
            return False
        if "\u0e00" <= line[-1:] <= "\u0e7f" and "\u0e00" <= word[:1] <= "\u0e7f":
            return True
        if wrapped and _caseless.match(word[:1]) and " " not in line:
            return len(line) + 2 <= width - 2
        if not wrapped:
            return True
        if line[-1:] in ",;:—–-" or not word[:1].isalpha():
            return False
        return len(line) + 1 + len(word) <= width - 3 and len(line) < 0.75 * width

    def units(self, s: str | None) -> list[tuple[int, int]]:
        """(start, end) of every unit, without surrounding white space."""
        if not s or s.isspace():
            return []
        out, i = [], 0
        for e in self.ends(s):
            a, b = i, e
            while a < b and s[a].isspace():
                a += 1
            while b > a and s[b - 1].isspace():
                b -= 1
            if a < b:
                out.append((a, b))
            i = e
        return out


def split_sentences(docs: DataFrame, key: str = "doc_id", text: str = "text", with_text: bool = True) -> DataFrame:
    """(key, start_pos, end_pos, sentence) of every unit; without its text if not wanted."""
    known = evidence(docs, text)
    few = known.limit(MAX_WORDS + 1).collect()
    one = len(few) <= MAX_WORDS
    words = [frozenset(r.word for r in few if r.kind == k) for k in "sa"] if one else None
    docs = docs.select(key, text)
    rows = docs if one else with_own(docs, known, text).select(key, text, "starters", "abbreviations")

    def make():
        p = Splitter(*words) if one else None

        def f(ids, texts, *own):
            keys, first, last, units = [], [], [], []
            for n, (i, t) in enumerate(zip(ids, texts)):
                u = (p or Splitter(own[0][n] or (), own[1][n] or ())).units(t)
                keys += [i] * len(u)
                first += [a for a, _ in u]
                last += [b for _, b in u]
                if with_text:
                    units += [t[a:b] for a, b in u]
            return [keys, first, last, units] if with_text else [keys, first, last]

        return f

    return map_batches(rows, make, f"{key} {dict(docs.dtypes)[key]}, start_pos int, end_pos int" + ", sentence string" * with_text)
