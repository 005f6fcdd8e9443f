"""Evaluation passages inside corpus documents (problem 7), by the q-gram lemma.

Texts are folded to letters and digits in lower case. A region that repeats w characters of an item but for k replaced words of m
characters in all shares at least w - q + 1 - m - k (q - 1) of its q-grams with it, all on nearby diagonals. Shared q-grams are counted
in overlapping bands of diagonals; bands in which a window of the item reaches this bound are verified by banded alignment of words.

A q-gram of more than HOT places of a block counts only for items that have a window which its other q-grams can't decide: elsewhere the
bound is lowered by the window's hot q-grams, so the lemma stays exact. What is expanded at once is bounded by POSTINGS: longer texts are
taken in overlapping parts, and items in ranges.

The items are the stated query set: their index is sent to every worker. Beyond ITEM_BLOCK items they are taken in blocks, one after the
other, each with its result in a checkpoint, so that driver and workers hold one block at a time. Which sentences are standard is counted over all
items before. Every document is read as a whole, and no text is shuffled.

Defined cases: null and blank texts leak nothing; items of under `min_words` words match nothing; repeated documents and items give
one row each; passages that stand in several items alike (instructions, questions) don't count by themselves.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwork.util import checkpoint, hot_join, map_batches, map_rows

ITEM_BLOCK = 20_000
#: Places of a q-gram in a block of items from which on it is hot; (place, item) pairs that are expanded at once.
HOT, POSTINGS = 64, 4_000_000
#: In how many items a sentence must stand to be standard.
STANDARD = 3
_word = re.compile(r"\w+(?:[-‑]\w+)*")
_drop = re.compile(r"[\W_]+")


def fold(t: str) -> str:
    return t.lower().replace("ё", "е").replace("ß", "ss")


def words(t: str) -> list[str]:
    return [_drop.sub("", w) for w in _word.findall(fold(t)) if w.strip("_-‑")]


class Index:
    """q-grams of a block of items (id, text, its standard sentences); immutable once built."""

    def __init__(self, items: list[tuple], q: int = 6, min_words: int = 15, per: int = 7):
        self.q, self.min_words, self.per = q, min_words, per
        self.ids = [x[0] for x in items]
        self.words = [words(x[1]) for x in items]
        self.standard = [standard_words(x[1], frozenset(x[2] or ())) for x in items]
        self.starts = [np.cumsum([0] + [len(w) for w in ws]) for ws in self.words]
        grams_of = [grams(np.frombuffer("".join(ws).encode("utf-32-le"), np.uint32), q) for ws in self.words]
        known, count = np.unique(np.concatenate([*grams_of, np.zeros(0, np.uint64)]), return_counts=True)
        rank, item, pos = [], [], []
        self.windows: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for k, h in enumerate(grams_of):
            r = np.searchsorted(known, h)
            first, last, need = self.bounds(self.words[k], self.starts[k], self.standard[k])
            hot = count[r] > HOT
            total = np.concatenate([[0], np.cumsum(hot)])
            cold = need - (total[last] - total[first]) if len(need) else need
            keep = np.ones(len(h), bool)
            if len(cold) and cold.min() >= 1:
                keep, need = ~hot, cold
            self.windows.append((first, last, need))
            rank.append(r[keep])
            item.append(np.full(int(keep.sum()), k, np.int64))
            pos.append(np.flatnonzero(keep).astype(np.int32))
        self.least = np.array([int(w[2].min(initial=1 << 30)) for w in self.windows], np.int64)
        self.hash = known
        # postings in the order of their q-gram, then item
        self.code = np.concatenate([*rank, np.zeros(0, np.int64)]) * len(items) + np.concatenate([*item, np.zeros(0, np.int64)])
        order = np.argsort(self.code, kind="stable")
        self.code = self.code[order]
        self.pos = np.concatenate([*pos, np.zeros(0, np.int32)])[order]
        self.band = 2 * 32
        self.reach = max((int(x[-1]) for x in self.starts), default=0) + 4 * self.band
        self.bits = np.zeros(1 << 22, bool)
        self.bits[(self.hash >> np.uint64(42)).astype(np.int64)] = True

    def bounds(self, ws: list[str], starts: np.ndarray, standard: list[bool]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first q-gram, last q-gram + 1, q-grams that must be shared) of every window of min_words words that aren't all standard.

        The lemma with the edit budget of the window: its min_words // per longest words are the replaced ones.
        """
        first, last, need = [], [], []
        for a in range(len(ws) - self.min_words + 1):
            if all(standard[a : a + self.min_words]):
                continue
            lost = sorted((len(w) for w in ws[a : a + self.min_words]), reverse=True)[: self.min_words // self.per]
            x, y = int(starts[a]), int(starts[a + self.min_words]) - self.q + 1
            first.append(x)
            last.append(y)
            need.append(max(1, y - x - sum(lost) - len(lost) * (self.q - 1)))
        return np.array(first, np.int64), np.array(last, np.int64), np.array(need, np.int64)

    def retained(self, i: int, ipos: np.ndarray) -> bool:
        """Does some window of the item share as many q-grams as its bound asks for?"""
        first, last, need = self.windows[i]
        if not len(first):
            return False
        mask = np.zeros(int(self.starts[i][-1]) + 1, np.int32)
        mask[ipos + 1] = 1
        c = np.cumsum(mask)
        return bool((c[last] - c[first] >= need).any())

    def search(self, docs: list[tuple[int, str]]) -> list[tuple[int, int]]:
        """(position in docs, item id) of verified leaks."""
        texts = [_drop.sub("", fold(t)) for _, t in docs]
        if not len(self.code) or not any(texts):
            return []
        codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        begins = np.cumsum([0] + [len(t) for t in texts])
        h = grams(codes, self.q)
        at = np.flatnonzero(self.bits[(h >> np.uint64(42)).astype(np.int64)])
        rank = np.searchsorted(self.hash, h[at])
        known = self.hash[np.minimum(rank, len(self.hash) - 1)] == h[at]
        at, rank = at[known], rank[known]
        doc = np.searchsorted(begins, at, "right") - 1
        inside = at + self.q <= begins[doc + 1]
        found: set[tuple[int, int]] = set()
        read = (-1, [], None)

        def verify(d: int, i: int, dpos: np.ndarray, ipos: np.ndarray) -> bool:
            nonlocal read
            if read[0] != d:
                dw = words(docs[d][1])
                read = (d, dw, np.cumsum([0] + [len(w) for w in dw]))
            return self.verify(read[1], read[2], i, dpos, ipos)

        self.part(at[inside], rank[inside], doc[inside], begins, 0, len(self.ids), found, verify)
        return [(d, self.ids[i]) for d, i in found]

    def part(self, at, rank, doc, begins, first: int, last: int, found: set, verify) -> None:
        """Adds the leaks of items first .. last - 1 in one part of the texts; parts with too many postings are halved.

        Halves overlap by `reach`, more than any window with its band takes.
        """
        lo, hi = np.searchsorted(self.code, rank * len(self.ids) + first), np.searchsorted(self.code, rank * len(self.ids) + last)
        n = hi - lo
        total = int(n.sum())
        if not total:
            return
        if total > POSTINGS:
            if at[-1] - at[0] > 4 * self.reach:
                middle = (at[0] + at[-1]) // 2
                for half in (at < middle + self.reach, at >= middle):
                    self.part(at[half], rank[half], doc[half], begins, first, last, found, verify)
                return
            if last - first > 1:
                for a, b in ((first, (first + last) // 2), ((first + last) // 2, last)):
                    self.part(at, rank, doc, begins, a, b, found, verify)
                return
        idx = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(total)
        doc, dpos = np.repeat(doc, n), np.repeat(at, n)
        dpos = dpos - begins[doc]
        item, ipos = self.code[idx] % len(self.ids), self.pos[idx]
        diag = dpos - ipos + (1 << 14)
        for shift in (0, self.band // 2):
            key = (doc * len(self.ids) + item) * (1 << 40) + (diag + shift) // self.band
            order = np.argsort(key, kind="stable")
            _, start, count = np.unique(key[order], return_index=True, return_counts=True)
            low = count >= self.least[item[order[start]]]
            for f, c in zip(start[low].tolist(), count[low].tolist()):
                sel = order[f : f + c]
                d, i = int(doc[sel[0]]), int(item[sel[0]])
                if (d, i) not in found and self.retained(i, ipos[sel]) and verify(d, i, dpos[sel], ipos[sel]):
                    found.add((d, i))

    def verify(self, dw: list[str], starts: np.ndarray, i: int, dpos: np.ndarray, ipos: np.ndarray) -> bool:
        """Banded alignment of the words around the hits: is there a window of min_words words with few replaced ones?"""
        iw = self.words[i]
        shift = int(np.median(np.searchsorted(starts, dpos, "right") - np.searchsorted(self.starts[i], ipos, "right")))
        return accepted(align(iw, dw, shift), self.standard[i], self.min_words, self.per, [any(c.isdigit() for c in w) for w in iw])


def align(iw: list[str], dw: list[str], shift: int, band: int = 8) -> list[bool]:
    """Which words of iw are matched in the best local alignment with dw within `band` words of the diagonal."""
    n, m, w = len(iw), len(dw), 2 * band + 1
    score = [[0] * (w + 2) for _ in range(n + 1)]
    back = [[0] * (w + 2) for _ in range(n + 1)]
    best, where = 0, None
    for i in range(1, n + 1):
        x, up, row, b = iw[i - 1], score[i - 1], score[i], back[i]
        for k in range(1, w + 1):
            j = i + shift + k - 1 - band  # 1-based place in dw
            if j < 1 or j > m:
                continue
            same = x == dw[j - 1]
            s, t = up[k] + (2 if same else -1), 1 if same else 2
            if up[k + 1] - 2 > s:
                s, t = up[k + 1] - 2, 3
            if row[k - 1] - 2 > s:
                s, t = row[k - 1] - 2, 4
            if s > 0:
                row[k], b[k] = s, t
                if s > best:
                    best, where = s, (i, k)
    hit = [False] * n
    while where:
        i, k = where
        t = back[i][k]
        if not t:
            break
        if t == 1:
            hit[i - 1] = True
        where = (i - 1, k) if t < 3 else (i - 1, k + 1) if t == 3 else (i, k - 1)
    return hit


def accepted(hit: list[bool], standard: list[bool], min_words: int, per: int, figure: list[bool]) -> bool:
    """Is there a window that begins and ends with matched words, of min_words or more, with at most one in `per` unmatched?

    A window in which every word with a figure is another one is a like sentence, not a copy.
    """
    h = np.array(hit)
    at = np.flatnonzero(h)
    if len(at) < min_words - min_words // per:
        return False
    miss = np.concatenate([[0], np.cumsum(~h)])
    own = np.concatenate([[0], np.cumsum(~np.array(standard))])
    ownmiss = np.concatenate([[0], np.cumsum(~h & ~np.array(standard))])
    a, b = at[:, None], at[None, :] + 1
    size = b - a
    mine = own[b] - own[a]
    ok = (size >= min_words) & ((miss[b] - miss[a]) * per <= size) & (mine >= min_words // 2) & ((ownmiss[b] - ownmiss[a]) * per <= mine + per - 1)
    fig, f = np.array(figure), lambda x: np.concatenate([[0], np.cumsum(x)])
    all_fig, bad_fig = f(fig), f(fig & ~h)
    changed = bad_fig[b] - bad_fig[a]
    return bool((ok & ((changed == 0) | (changed < all_fig[b] - all_fig[a]))).any())


def sentences_of(t: str) -> list[str]:
    return [x for x in re.split(r"(?<=[.!?])\s+|\n", t) if x.strip()]


def standard_words(t: str, standard: frozenset[str]) -> list[bool]:
    """For each word, whether its sentence is a standard one."""
    out: list[bool] = []
    for s in sentences_of(t):
        ws = words(s)
        out += [" ".join(ws) in standard] * len(ws)
    n = len(words(t))
    return (out + [False] * n)[:n]


def with_standard(items: DataFrame) -> DataFrame:
    """(item, text, standard): items with their sentences that stand in STANDARD items or more, counted over all items."""
    forms = map_rows(items, lambda: lambda i, t: [(i, s) for s in {" ".join(words(x)) for x in sentences_of(t)} if s], f"item {dict(items.dtypes)['item']}, form string")
    often = forms.distinct().groupBy("form").agg(F.count("*").alias("n")).filter(F.col("n") >= STANDARD).select("form")
    own = hot_join(forms, often, "form", "inner", salt="item").groupBy("item").agg(F.collect_set("form").alias("standard"))
    return items.join(own, "item", "left")


def grams(codes: np.ndarray, q: int) -> np.ndarray:
    """A hash of every q-gram."""
    n = len(codes) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    c = codes.astype(np.uint64)
    for k in range(q):
        h *= np.uint64(0x9E3779B97F4A7C15)
        h += c[k : k + n]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h


def leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", q: int = 6, min_words: int = 15, per: int = 7) -> DataFrame:
    """(key, item_key): documents that repeat, in one place, at least min_words words of an item with at most one in `per` replaced."""
    kinds = dict(docs.dtypes)[key], dict(items.dtypes)[item_key]
    given = with_standard(items.select(F.col(item_key).alias("item"), F.col(item_text).alias("text")).filter("item is not null and text is not null").distinct())
    blocks = -(-given.count() // ITEM_BLOCK)
    if blocks > 1:
        given = checkpoint(given)
    out = docs.sparkSession.createDataFrame([], f"{key} {kinds[0]}, {item_key} {kinds[1]}")
    for b in range(blocks):
        # by hash, so a block has about ITEM_BLOCK items
        block = [tuple(r) for r in given.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b).orderBy("item", "text").collect()]

        def make(block=block):
            index = Index(block, q, min_words, per)

            def f(ids, texts):
                found: list[tuple] = []
                part: list[tuple] = []
                size = 0
                for i, t in zip(ids, texts):
                    if t:
                        part.append((i, t))
                        size += len(t)
                    if size > 300_000:
                        found += [(part[d][0], k) for d, k in index.search(part)]
                        part, size = [], 0
                found += [(part[d][0], k) for d, k in index.search(part)]
                return [[x[0] for x in found], [x[1] for x in found]]

            return f

        part = map_batches(docs.select(key, text), make, f"{key} {kinds[0]}, {item_key} {kinds[1]}")
        out = part if blocks == 1 else out.union(checkpoint(part))
    return out
