"""Text decoded with the wrong character encoding (problem 6).

1. Sentences with suspicious characters are joined with clean near-twins word by word: on the sentence's text stripped of its non-ASCII characters
   (numbers alike; the lengths of what was stripped as well where little else is left), the word's place in it, its own ASCII characters and the
   lengths of its other runs. A clean word has one key by its characters and one by its bytes in UTF-8. Every clean twin takes part; equal words of
   one place are one. A bit table of the garbled keys, of fixed size, keeps clean words without a garbled twin out of the shuffle.
2. The characters of the joined words are aligned. The aligned pieces say which byte a character stands for: a pair of codecs (the right one, the
   wrong one) that explains all pieces of words of a sentence gets its support. Sentences that no known codecs explain make tables of their
   own, one for each way in which the most frequent letters are written. Pairs and tables with enough support are the learned mappings.
3. The learned mappings are applied to all remaining suspicious records, text by text and up to three times over (text may be garbled twice).
   Multi-byte mappings need whole sequences; single-byte ones are taken where character bigrams of the clean corpus
   find the result far likelier and it has no letter outside the corpus's alphabet.

The join stays within the shuffle; only supports (one row per mapping), tables and bigram counts (of a fixed alphabet) come to the driver.

Defined cases: null and empty texts are never affected; foreign names whose letters form no whole sequence stay as they are; characters
lost in the wrong decoding come out as U+FFFD; repeated rows give repeated results.
"""

from __future__ import annotations

import itertools
import operator
import re
import zlib
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftwork.llm import chars
from siftwork.util import map_batches, map_rows

CODECS = ("cp1251", "cp1252", "latin-1", "cp866", "koi8-r", "iso8859-5", "mac_cyrillic", "cp437", "cp850")
#: Distinct garbled sentences that must support a pair of codecs, and a table of its own.
SUPPORT, TABLE_SUPPORT = 2, 5
#: Pieces that a single sentence must have to support a pair of codecs alone.
ALONE = 20
#: Size of the bit table of garbled keys.
BITS = 1 << 20
#: The letters whose forms tell tables apart.
FREQUENT = "оеаи"
#: Mean gain in log likelihood per bigram that a single-byte mapping needs.
GAIN = 1.0

#: Characters that ordinary text of these languages has; a line with any other may be garbled.
ORDINARY = "\\x00-\\x7fА-яЁё«»—–№“”„’‘…äöüÄÖÜß"
#: May be garbled: an unusual character, typographic signs after a capital that begins a sequence, or words with swapped case.
SUSPICIOUS = f"[^{ORDINARY}]|[РСГв][«»—–№“”„’‘…]|(?<![А-Яа-яЁё])[а-яё][А-ЯЁ]{{2}}|[ÄÖÜß][äöüÄÖÜß„“”…–—’‘»«]|[А-ЯЁ]{{4}} [А-ЯЁ]{{4}}"
_suspicious = re.compile(SUSPICIOUS)
_ODD, _SIGN, _LEAD, _LOW, _UP, _UML = 1, 2, 4, 8, 16, 32
_flags = chars.table(
    (_SIGN, "«»—–№“”„’‘…"), (_LEAD, "РСГв"), (_LOW, [(0x430, 0x44F), "ё"]), (_UP, [(0x410, 0x42F), "Ё"]), (_UML, "äöüÄÖÜß"),
)
_flags[[o for o in range(0x80, 0x10000) if not _flags[o]]] = _ODD


def suspects(texts: list[str]) -> np.ndarray:
    """Which texts SUSPICIOUS would find something in (or a little more)."""
    c, starts = chars.joined(texts)
    f = _flags[c]
    m = (f & _ODD) > 0
    a, b = f[:-1], f[1:]
    m[:-1] |= ((a & _LEAD) > 0) & ((b & _SIGN) > 0) | ((a & _UML) > 0) & ((b & (_UML | _SIGN)) > 0)
    up = (f & _UP) > 0
    m[:-2] |= ((f[:-2] & _LOW) > 0) & up[1:-1] & up[2:]
    if len(f) > 9:
        four = up[:-3] & up[1:-2] & up[2:-1] & up[3:]
        m[: len(four) - 5] |= four[:-5] & (c[4 : len(four) - 1] == 32) & four[5:]
    return chars.texts_with(m, starts)


#: Letters of the bigram model.
ALPHABET = "".join(map(chr, [*range(0x410, 0x450), 0x401, 0x451])) + "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZäöüÄÖÜßéèêëïîñçåøãáíóú"
#: Classes of a bigram's characters: 0 space or ASCII mark, 1.. letters, last: anything else.
OTHER = len(ALPHABET) + 1
_class = np.full(0x10000, OTHER, np.int16)
_class[:0x80] = 0
for _i, _c in enumerate(ALPHABET):
    _class[ord(_c)] = _i + 1
_class[[ord(c) for c in "«»—–№“”„’‘…\xa0"]] = 0
SIZE = OTHER + 1


def table_of(codec: str) -> list[str]:
    """The character of every byte; bytes without one stay control characters."""
    out = []
    for b in range(256):
        try:
            out.append(bytes([b]).decode(codec))
        except UnicodeDecodeError:
            out.append(chr(b))
    return out


class Mapping:
    """Text of one encoding (right) that was decoded by another (wrong)."""

    def __init__(self, right: str, wrong: str):
        self.right, self.wrong = right, wrong
        seen = table_of(wrong)
        self.back = {c: b for b, c in enumerate(seen)}
        self.back.setdefault("�", 0x98)
        if right == "utf-8":
            cls = lambda lo, hi: "[" + "".join(re.escape(seen[b]) for b in range(lo, hi + 1)) + "]"
            cont = cls(0x80, 0xBF)[:-1] + "�]"
            self.sequence = re.compile(f"{cls(0xE1, 0xEF)}{cont}{cont}|{cls(0xC2, 0xDF)}{cont}")
            self.forward = None
        else:
            mine = table_of(right)
            self.map = {ord(seen[b]): mine[b] for b in range(128, 256)}
            self.forward = {ord(mine[b]): seen[b] for b in range(128, 256)}
        self.seen = seen

    def garble(self, s: str) -> str:
        if self.forward is not None:
            return s.translate(self.forward)
        return "".join(self.seen[b] for b in s.encode("utf-8", "replace"))

    def explains(self, x: str, y: str) -> bool:
        """Does the wrong decoding of character y read x?"""
        if self.forward is not None:
            return len(x) == 1 and self.map.get(ord(x)) == y
        return len(x) > 1 and [self.back.get(c) for c in x] == list(y.encode("utf-8", "replace"))

    def restore_sequences(self, s: str) -> tuple[str, int]:
        """(restored, evidence) for a multi-byte mapping; evidence 0: leave it."""
        evidence = 0

        def one(m: re.Match) -> str:
            nonlocal evidence
            raw = bytes(self.back[c] for c in m[0])
            try:
                c = raw.decode("utf-8")
            except UnicodeDecodeError:
                return m[0]
            if not good(c):
                return m[0]
            a, b = m.span()
            near = last[0] == a
            latin = s[a - 1 : a].isascii() and s[a - 1 : a].isalpha() or s[b : b + 1].isascii() and s[b : b + 1].isalpha()
            if near or len(m[0]) == 3 or self.wrong in ("cp1252", "latin-1") or latin and ord(c) < 0x250 or m[0][0] in "╨╤├┬":
                evidence += 1 + near
            last[0] = b
            return c

        last = [-1]
        out = self.sequence.sub(one, s)
        return out, evidence


class Table:
    """A mapping of single characters that no known codecs explain."""

    def __init__(self, pieces: str):
        self.map = {ord(x): y for x, y in zip(pieces[::2], pieces[1::2])}


def good(c: str) -> bool:
    o = ord(c)
    return 0x400 <= o <= 0x45F or 0xA0 <= o <= 0x17F or 0x2010 <= o <= 0x2044 or o in (0x20AC, 0x2116, 0x2122) or 0x490 <= o <= 0x4F9 or 0x2500 <= o < 0x2600


@lru_cache
def mappings() -> dict[tuple[str, str], Mapping]:
    """Every pair of codecs."""
    pairs = [("utf-8", w) for w in CODECS] + list(itertools.permutations(CODECS[:7], 2))
    return {p: Mapping(*p) for p in pairs if p[0] not in ("cp1252", "latin-1")}


_sentence = re.compile(r"(?<=[.!?]) +|\n")
_zeros = re.compile(b"0+")
_skeleton = bytes(0x30 if 0x30 <= b <= 0x39 else b for b in range(256))


def skeleton(sentence: str) -> bytes:
    """The ASCII characters alone, numbers as 0: the same for sentences that were written alike, garbled or not."""
    return _zeros.sub(b"0", sentence.encode("ascii", "ignore").translate(_skeleton, b'"-\t\r'))


_run = re.compile(r"[^\x00-\x7f]+")
_size = operator.methodcaller("encode", "utf-8", "replace")


def words_of(sentence: str, clean: bool) -> list[tuple[int, int, str]]:
    """(key, place, word) of the words that encodings tell apart; none where the sentence tells too little."""
    k = skeleton(sentence)
    words = [(n, w) for n, w in enumerate(sentence.split(" ")) if not w.isascii()]
    marks = len(k) - k.count(b" ")
    if marks < 3 and len(words) < 6:
        return []
    out = []
    runs = [_run.findall(w) for _, w in words]
    for count in (len, lambda r: len(_size(r))) if clean else (len,):
        sizes = [tuple(map(count, r)) for r in runs]
        base = zlib.crc32(k if marks >= 3 else k + repr(sizes).encode())
        out += [(zlib.crc32(repr((n, z, _run.sub("_", w))).encode(), base) | base << 32 & 0x7FFFFFFF00000000, n, w) for (n, w), z in zip(words, sizes)]
    return out


def survey(texts: DataFrame, text: str) -> DataFrame:
    """(kind, k, line, place, a, n): the words a of garbled sentences under their keys k (kind g), and the number n of bigrams k in clean
    texts (kind b), added up in the workers."""

    def make():
        def f(batch):
            batch = [t for t in batch if t]
            if not batch:
                return [[]] * 6
            bad = suspects(batch)
            c = _class[chars.codes("\n".join(t for t, x in zip(batch, bad) if not x))].astype(np.int64)
            n = np.bincount(c[:-1] * SIZE + c[1:], minlength=1) if len(c) > 1 else np.zeros(1, np.int64)
            garbled = {s for t, x in zip(batch, bad) if x for s in _sentence.split(t) if len(s) >= 8 and not s.isascii() and _suspicious.search(s)}
            rows = [("g", h, zlib.crc32(s.encode("utf-8", "replace")), p, w, 1) for s in garbled for h, p, w in words_of(s, False)] + [("b", int(k), None, None, None, int(n[k])) for k in np.flatnonzero(n)]
            return [list(x) for x in zip(*rows)] if rows else [[]] * 6

        return f

    return map_batches(texts.select(text), make, "kind string, k bigint, line bigint, place int, a string, n bigint")


def clean_twins(texts: DataFrame, text: str, bits: np.ndarray) -> DataFrame:
    """(k, clean): the clean words whose key may be that of a garbled one."""
    packed = np.packbits(bits)

    def make():
        wanted = np.unpackbits(packed).astype(bool)

        def f(batch):
            batch = [t for t in batch if t]
            bad = suspects(batch) if batch else []
            # a text with a garbled part has clean sentences, too
            sentences = {s for t, x in zip(batch, bad) for s in _sentence.split(t) if len(s) >= 8 and not s.isascii() and not (x and _suspicious.search(s))}
            rows = list({(h, w) for s in sentences for h, _, w in words_of(s, True) if wanted[h % BITS]})
            return [[x[0] for x in rows], [x[1] for x in rows]]

        return f

    return map_batches(texts.select(text), make, "k bigint, clean string").distinct()


def likelihoods(counts: np.ndarray) -> np.ndarray:
    """log P(next | this), smoothed; anything outside the alphabet is very unlikely."""
    p = counts + 0.02
    p[:, OTHER] = p[OTHER, :] = 0.02
    return np.log(p / p.sum(1, keepdims=True)).astype(np.float32)


def learn(surveyed: DataFrame, texts: DataFrame, text: str) -> list[tuple[str, str]]:
    """Learned mappings (right codec, wrong codec) or ("table", pieces), by support among near-twins."""
    garbled = surveyed.filter("kind = 'g'").select("k", "line", "place", F.col("a").alias("word"))
    bits = np.zeros(BITS, bool)
    bits[[r.k for r in garbled.select(F.pmod("k", F.lit(BITS)).alias("k")).distinct().collect()]] = True
    if not bits.any():
        return []

    def make():
        known = mappings()

        def f(word, clean):
            pieces, mixed = aligned(word, clean)
            if not pieces:
                return []
            distinct = set(pieces)
            fits = [p for p, m in known.items() if (mixed or len(distinct) >= 3) and all(m.explains(x, y) for x, y in distinct)]
            return [(word, clean, *p, len(distinct), mixed) for p in fits] or [(word, clean, None, None, len(distinct), mixed)]

        return f

    twins = garbled.distinct().join(clean_twins(texts, text, bits), "k").select("line", "place", "word", "clean").persist()
    aligned_pairs = map_rows(twins.select("word", "clean").distinct(), make, "word string, clean string, right string, wrong string, pieces int, mixed boolean")
    by_line = twins.join(aligned_pairs, ["word", "clean"]).persist()
    try:
        one = by_line.filter("right is not null").groupBy("right", "wrong", "line", "place").agg(F.max("pieces").alias("pieces"), F.max("mixed").alias("mixed"))
        lines = one.groupBy("right", "wrong", "line").agg(F.count("*").alias("words"), F.sum("pieces").alias("pieces"), F.max("mixed").alias("mixed")).filter("mixed or words >= 2 and pieces >= 6")
        # of pairs with the same wrong codec, those that explain most of a line
        best = Window.partitionBy("line", "wrong")
        lines = lines.withColumn("most", F.max("pieces").over(best)).filter("pieces = most")
        n = {(r.right, r.wrong): r.n for r in lines.groupBy("right", "wrong").agg(F.count("*").alias("n"), F.max("pieces").alias("p")).filter((F.col("n") >= SUPPORT) | (F.col("p") >= ALONE)).collect()}
        # codecs that agree in most letters support each other's pairs; the weaker one is dropped
        learned = sorted((r, w) for (r, w), k in n.items() if r == "utf-8" or 2 * k >= max(x for (a, b), x in n.items() if b == w and a != "utf-8"))
        return learned + [("table", p) for p in own_tables(by_line.join(lines.select("line").distinct(), "line", "left_anti"))]
    finally:
        by_line.unpersist()
        twins.unpersist()


def own_tables(by_line: DataFrame) -> list[str]:
    """The tables of sentences that no codecs explain: garbled character, character, in turn."""
    # words whose place has one clean form: those are no fields
    sure = by_line.filter("right is null and not mixed").groupBy("line", "place").agg(F.first("word").alias("word"), F.min("clean").alias("clean"), F.max("clean").alias("other")).filter("clean = other")

    def make():
        def f(line, words):
            t = own_table({p for w in words for p in aligned(w["word"], w["clean"])[0]})
            return [("".join(t[x] for x in FREQUENT), line, x + y) for y, x in t.items()] if t else []

        return f

    letters = map_rows(sure.groupBy("line").agg(F.collect_list(F.struct("word", "clean")).alias("words")), make, "sign string, line bigint, piece string")
    signs = letters.groupBy("sign").agg(F.countDistinct("line").alias("n")).filter(F.col("n") >= TABLE_SUPPORT).select("sign")
    counted: dict[str, list[tuple[str, int]]] = {}
    for r in letters.join(signs, "sign").groupBy("sign", "piece").agg(F.countDistinct("line").alias("n")).collect():
        counted.setdefault(r.sign, []).append((r.piece, r.n))
    return ["".join(best_pieces(c)) for _, c in sorted(counted.items())]


def best_pieces(counts: list[tuple[str, int]]) -> list[str]:
    """garbled character + character, where four in five alignments agree."""
    total: dict[str, int] = {}
    for p, n in counts:
        total[p[0]] = total.get(p[0], 0) + n
    return sorted(p for p, n in counts if n >= 2 and 5 * n >= 4 * total[p[0]])


def aligned(x: str, y: str) -> tuple[list[tuple[str, str]], bool]:
    """((garbled piece, character) wherever garbled x and clean y differ, whether y has ASCII letters or no letters at all).

    A character is written as one, or as the bytes of its UTF-8 form; ASCII must agree. Words that fit neither give no pieces.
    """
    mixed = any(c.isascii() and c.isalpha() for c in y) or not any(c.isalpha() for c in y)
    if len(x) == len(y):
        pieces = list(zip(x, y))
    else:
        pieces, at = [], 0
        for c in y:
            n = len(_size(c))
            pieces.append((x[at : at + n], c))
            at += n
        if at != len(x):
            return [], mixed
    if any(p != q for p, q in pieces if p.isascii() or q.isascii()):
        return [], mixed
    return [(p, q) for p, q in pieces if p != q], mixed


def own_table(pieces: set[tuple[str, str]]) -> dict[str, str] | None:
    """character -> garbled character, if every character is written in one way and no two alike, most of a sentence at least."""
    t = {y: x for x, y in pieces}
    if len(t) < 10 or len(t) != len(pieces) or len({x for x, _ in pieces}) != len(t) or any(len(x) != 1 for x, _ in pieces) or any(c not in t for c in FREQUENT):
        return None
    return t


class Restorer:
    """Applies learned mappings to one text."""

    def __init__(self, learned: list[tuple[str, str]], logp: np.ndarray):
        known = mappings()
        self.multi = [known[p] for p in learned if p[0] == "utf-8"]
        self.single = [Table(p[1]) if p[0] == "table" else known[p] for p in learned if p[0] != "utf-8"]
        self.logp = logp
        self.cut = re.compile(r"(¬?\n+|(?<=[.!?;]) +)")

    def restore(self, s: str | None) -> tuple[str | None, bool]:
        """(restored, whether anything was garbled)."""
        if not s or not _suspicious.search(s):
            return s, False
        hit = False
        for _ in range(3):
            best, most = s, 0
            for m in self.multi:
                t, n = m.restore_sequences(s)
                if n > most:
                    best, most = t, n
            if not most:
                break
            s, hit = best, True
        if self.single:
            parts = self.cut.split(s)  # texts and, in between, what separates them
            won = [self.piece(p) if k % 2 == 0 else (p, None) for k, p in enumerate(parts)]
            sure = next((m for _, m in won if m), None)
            if sure:  # what is too short to tell by itself follows the pieces beside it
                s, hit = "".join(p if m or k % 2 else self.piece(p, sure)[0] for k, (p, m) in enumerate(won)), True
        return s, hit

    def piece(self, p: str, sure: Mapping | Table | None = None) -> tuple[str, Mapping | Table | None]:
        """Applies the single-byte mapping that makes words likelier by most, to these words alone; sure: the one to apply."""
        if p.isascii() or not sure and not _suspicious.search(p):
            return p, None
        codes = chars.codes(f" {p} ")
        bounds = np.flatnonzero(codes == 32)  # word k lies between bounds k and k + 1
        starts, size = bounds[:-1], np.diff(bounds)
        ascii_letter = (codes < 0x80) & ((codes | 32) >= 97) & ((codes | 32) <= 122)
        own = np.add.reduceat(ascii_letter, starts) == 0
        c = _class[codes]
        base = np.add.reduceat(self.logp[c[:-1], c[1:]], starts)
        low = _class[chars.codes(f" {p.lower()} ")]
        if len(low) == len(c):  # capitals throughout are no sign of swapped case
            base = np.maximum(base, np.add.reduceat(self.logp[low[:-1], low[1:]], starts))
        best, won = 0.0, None
        for m in [sure] if sure else self.single:
            t = p.translate(m.map)
            if t == p:
                continue
            d = chars.codes(f" {t} ")
            if len(d) != len(codes):
                continue
            k = _class[d]
            gain = np.add.reduceat(self.logp[k[:-1], k[1:]], starts) - base
            take = own & (gain > GAIN * size) & (np.add.reduceat(k[:-1] == OTHER, starts) == 0)
            letters = np.add.reduceat((d != codes) & (d >= 0x400) & (d < 0x460), starts)[take].sum()
            total = float(gain[take].sum())
            if sure or letters >= 4 and total > best:
                best, won = total, (m, t, own & (gain > 0) & (np.add.reduceat(d != codes, starts) > 0))
        if not won:
            return p, None
        m, t, take = won
        words = [t[a : a + n - 1] if x else p[a : a + n - 1] for a, n, x in zip(starts, size, take)]
        return " ".join(words), m


def fit(texts: DataFrame, text: str = "text") -> tuple[list[tuple[str, str]], np.ndarray]:
    """(learned mappings, bigram log likelihoods) of a corpus; at most SIZE * SIZE counts reach the driver."""
    surveyed = survey(texts, text).persist()
    try:
        counts = np.zeros(SIZE * SIZE)
        for r in surveyed.filter("kind = 'b'").groupBy("k").agg(F.sum("n").alias("n")).collect():
            counts[r.k] = r.n
        return learn(surveyed, texts, text), likelihoods(counts.reshape(SIZE, SIZE))
    finally:
        surveyed.unpersist()


def affected(rows: DataFrame, key: str, text: str, fitted: tuple[list[tuple[str, str]], np.ndarray]) -> DataFrame:
    """(key, restored) of the garbled rows."""
    learned, logp = fitted

    def make():
        r = Restorer(learned, logp)

        def f(ids, texts):
            bad = suspects([t or "" for t in texts])
            found = [(i, s) for i, t, x in zip(ids, texts, bad) if x for s, hit in [r.restore(t)] if hit]
            return [[x[0] for x in found], [x[1] for x in found]]

        return f

    return map_batches(rows.select(key, text), make, f"{key} {dict(rows.dtypes)[key]}, restored string")
