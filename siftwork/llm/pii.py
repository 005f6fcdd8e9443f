"""Personal information inside free text (problem 1).

A character-level bidirectional LSTM with CRF transitions (lstm.py; trained by pii_train.py from labelled spans) tags e-mail addresses, phone
numbers, identity numbers, street addresses and names. Texts are cut into overlapping windows; each is decoded by itself, and the
windows' spans are reconciled over the whole text: a span counts from the window in whose core it begins, and of overlapping ones the
longer stays. An exact check then sets a span's ends to whole words and drops spans without what their kind must have.

A finding's snippet is a piece of its text, so its cases are those of the text there; a value is the case in the middle of its snippet.
Snippets without their text, and values without a snippet, are decoded by themselves.

Defined cases: null and empty fields have no cases and come out as they are; repeated rows give repeated cases; very long texts are
windows like others. A result with very many findings is cut into blocks of BLOCK findings.
"""

from __future__ import annotations

import os
import re
from bisect import bisect_left

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwork.llm import chars, lstm
from siftwork.llm.lstm import KINDS
from siftwork.llm.pii_train import PATTERN_KINDS, place_value
from siftwork.util import map_batches

MODEL = os.path.join(os.path.dirname(__file__), "pii_model.npz")
WINDOW, OVERLAP = 512, 64
LANES = 1024
BLOCK = 2_000

_hidden = "­​‌‍⁠﻿"
_edge = " \n\t\r\xa0.,;:!?\"'«»“”„’—–-<>[]{}" + "               　"
_word = re.compile(rf"[\w{_hidden}̀-ͯ]")
_spelled = re.compile(r"собака|точка|\(at\)|\[at\]|\bat\b|\(dot\)|\[dot\]", re.I)


def margin(a: np.ndarray) -> float:
    """A span of n tags changes n + 1 transitions at most, so where no tag comes nearer to O than this, O throughout is the best path."""
    return 2 * max(0.0, float(a.max() - a[0, 0]))


class Tagger:
    """Finds spans (start, end, kind) in many texts at once."""

    def __init__(self, path: str = MODEL):
        self.model = lstm.Model.load(path)
        self.margin = margin(self.model.a)

    def spans(self, texts: list[str]) -> list[list[tuple[int, int, str]]]:
        found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        windows: list[tuple[int, int, int]] = []
        ids = [lstm.CLASSES[chars.codes(t)] for t in texts]
        for i, x in enumerate(ids):
            n = len(x)
            a = 0
            while True:
                windows.append((i, a, min(WINDOW, n - a)))
                if a + WINDOW >= n:
                    break
                a += WINDOW - OVERLAP
        windows.sort(key=lambda w: w[2])
        for k in range(0, len(windows), LANES):
            self.decode(windows[k : k + LANES], ids, found)
        return [self.reconcile(t, f) for t, f in zip(texts, found)]

    def decode(self, part: list[tuple[int, int, int]], ids: list[np.ndarray], found: list[list]) -> None:
        longest = part[-1][2]
        if not longest:
            return
        x = np.zeros((longest, len(part)), np.uint8)
        for j, (i, a, n) in enumerate(part):
            x[:n, j] = ids[i][a : a + n]
        e = self.model.emissions(x)
        hot = np.flatnonzero((e[:, 1:].max(1) > e[:, 0] - self.margin).any(0))
        if not len(hot):
            return
        tags = self.model.decode(e[:, :, hot])
        tags[x[:, hot] == 0] = 0
        begin = tags.T.copy()  # [window, place]
        full = np.zeros((begin.shape[0], begin.shape[1] + 1), np.int8)
        full[:, :-1] = begin
        for row, place in zip(*np.nonzero(full & 1)):
            tag = full[row, place] + 1
            end = place + 1
            line = full[row]
            while line[end] == tag:
                end += 1
            i, a, n = part[hot[row]]
            low = 0 if a == 0 else OVERLAP // 2
            last = a + n == len(ids[i])
            if place >= low and (last or place < n - OVERLAP // 2):
                found[i].append((a + int(place), a + int(end), int(tag) // 2 - 1))
            elif place < low and end > low:
                found[i].append((a + int(place), a + int(end), int(tag) // 2 - 1))

    def reconcile(self, text: str, found: list[tuple[int, int, int]]) -> list[tuple[int, int, str]]:
        """Spans of all windows: whole words, checked, without overlaps."""
        spans = []
        for a, b, k in found:
            for x, y, kind in parted(text, a, b, KINDS[k]):
                s = checked(text, x, y, kind)
                if s:
                    spans.append((*s, kind))
        spans.sort(key=lambda s: (s[0], -s[1]))
        out: list[tuple[int, int, str]] = []
        for s in spans:
            if out and s[0] < out[-1][1]:
                p = out[-1]
                if s[2] == p[2]:
                    out[-1] = (p[0], max(p[1], s[1]), p[2])
                elif s[1] - s[0] > p[1] - p[0]:
                    out[-1] = s
            elif s not in out[-1:]:
                out.append(s)
        return out


def parted(t: str, a: int, b: int, kind: str) -> list[tuple[int, int, str]]:
    """A span cut where one of its kind can't go on: a sentence's end in a name, a person before a Latin address."""
    s = t[a:b]
    if kind == "name":
        m = _role.match(s)
        if m:
            return parted(t, a + m.end(), b, kind)
        m = _stop.search(s)
        if m:
            rest = parted(t, a + m.end(), b, kind)
            return [(a, a + m.start(1), kind)] + [r for r in rest if _two.search(t[r[0] : r[1]])]
        m = re.match(r"(?:[^\W\d_A-ZА-ЯЁÄÖÜ]\w*[\s,:.]+)+(?=[A-ZА-ЯЁÄÖÜ])", s)
        if m:
            return [(a + m.end(), b, kind)]
    if kind == "address":
        m = _person.match(s)
        if m:
            return [(a, a + m.end(1), "name"), (a + m.end(), b, kind)]
    return [(a, b, kind)]


#: Roles and titles that aren't part of a name (fixed values).
_role = re.compile(r"(?:клиент|заявитель|сотрудник|работник|получатель|плательщик|налогоплательщик|исполнитель|абонент|гражданин|гражданка|господин|госпожа|доктор|инспектор|mr|mrs|ms|miss|dr|prof|herr|frau)\w{0,2}\.?[\s:]+(?=\S)", re.I)
_stop = re.compile(r"\w[^\W\d_](\.)\s+(?=[^\W\d_a-zа-яё])")
_two = re.compile(r"\w[.\s]+\w")
#: Latin words without figures before a part with a house number.
_person = re.compile(r"((?:[A-ZÄÖÜ](?:[a-zß-ÿ]+|[A-ZÄÖÜ]+|\.)(?:-[A-ZÄÖÜ][a-zß-ÿ]+)?[ \n]*(?:,[ \n]*(?=[A-ZÄÖÜ][a-zß-ÿ]+,))?)+),\s*(?=(?:Flat |Apt\.? |\d|[A-ZÄÖÜ][\w.-]+(?:\s[A-ZÄÖÜ]\w+)?\.?\s\d))")
_street_end = re.compile(r"(?:St|Ave|Rd|Ln|Dr|Blvd|Str|str|Sq|Pl|Ct)$")


def checked(t: str, a: int, b: int, kind: str) -> tuple[int, int] | None:
    """The span's exact ends, or None if it can't be of its kind."""
    while a > 0 and _word.match(t[a - 1]) and _word.match(t[a]):
        a -= 1
    while b < len(t) and _word.match(t[b - 1]) and _word.match(t[b]):
        b += 1
    while a < b and t[a] in _edge:
        a += 1
    while b > a and t[b - 1] in _edge:
        b -= 1
    s = t[a:b]
    if s.count("(") < s.count(")"):
        if t[a - 1 : a] == "(":
            a -= 1
        elif s.endswith(")"):
            b -= 1
    elif s.count("(") > s.count(")") and s.startswith("("):
        a += 1
    if kind == "phone" and t[a - 1 : a] in ("+", "＋"):
        a -= 1
    s = t[a:b]
    digits = sum(c.isdigit() for c in s)
    letters = sum(c.isalpha() for c in s)
    if kind == "email":
        ok = letters >= 4 and ("@" in s or "＠" in s or _spelled.search(s))
    elif kind == "phone":
        ok = 7 <= digits + 2 * s.count("О") <= 16 and letters <= 3
    elif kind == "id_number":
        ok = digits >= 5 and letters <= 6
    elif kind == "address":
        ok = letters >= 3 and len(s) >= 6
        if ok and t[b : b + 1] == "." and _street_end.search(s):
            b += 1
    else:
        while digits and t[b - 1 : b].isdigit() or t[b - 1] in " +\n":
            b -= 1
        digits = sum(c.isdigit() for c in t[a:b])
        ok = letters >= 3 and digits <= 1
        # a full stop after an initial belongs to the name
        if ok and b < len(t) and t[b] == "." and re.search(r"(?:^|[\s.])[^\W\d_]$", t[a:b]):
            b += 1
    return (a, b) if ok else None


def placeholder(text: str | None, spans: list[tuple[int, int, str]]) -> str | None:
    """The text with typed placeholders."""
    if not text or not spans:
        return text
    out, at = [], 0
    for a, b, k in spans:
        out += [text[at:a], f"[{k.upper()}]"]
        at = b
    return "".join(out) + text[at:]


def visible(spans: list[tuple[int, int, str]], starts: list[int], low: int, high: int) -> list[tuple[int, int, str, int]]:
    """Spans within text[low:high], at their places there, with their number; one that the cut leaves less than half of is out.

    starts: the spans' starts in order, for the search.
    """
    out = []
    for k in range(max(0, bisect_left(starts, low) - 1), bisect_left(starts, high)):
        a, b, kind = spans[k]
        x, y = max(a, low), min(b, high)
        if y > x and 2 * (y - x) >= b - a:
            out.append((x - low, y - low, kind, k))
    return out


_squeeze = re.compile(r"[\s\-]+")


def squeezed_value(s: str) -> str:
    """As findings write their values."""
    return _squeeze.sub("", s).lower()


FLAT = "field string, row_id bigint, start_pos int, end_pos int, kind string"
SCHEMA = "field string, row_id bigint, spans array<struct<start_pos:int,end_pos:int,kind:string>>, replaced string"


def findings_in(results: DataFrame, findings: DataFrame, path: str = MODEL, flat: bool = False) -> DataFrame:
    """(field, row_id, spans, replaced) of every text, snippet and value with cases; flat: FLAT's columns, a row for each case.

    results: result_id, text; findings: finding_id, result_id, pattern_name, value, context_snippet. Findings of a result are brought to
    its text in blocks, so that a result with very many costs several rows, each with a copy of the text. Findings without a result
    make groups of their own.
    """
    f = findings.select("result_id", "finding_id", "pattern_name", "value", F.regexp_replace("context_snippet", "\\A\\s+\\z", "").alias("snippet"))
    many = f.filter("result_id is not null").groupBy("result_id").count().filter(F.col("count") > BLOCK).select("result_id", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks"))
    many = F.broadcast(many) if many.limit(100_001).count() <= 100_000 else many
    blocked = f.join(many, "result_id", "left").withColumn("block", F.when(F.col("blocks").isNotNull(), F.pmod(F.xxhash64("finding_id"), F.col("blocks")).cast("int")).when(F.col("result_id").isNull(), F.hash("finding_id")).otherwise(0))
    lists = blocked.groupBy("result_id", "block").agg(F.collect_list(F.struct("finding_id", "pattern_name", "value", "snippet")).alias("f"))
    texts = results.select("result_id", "text").join(many, "result_id", "left").withColumn("block", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("blocks") - 1, F.lit(0))))).drop("blocks")
    rows = texts.join(lists, ["result_id", "block"], "full")
    rows = rows.select("result_id", "block", "text", *[F.col(f"f.{c}").alias(c) for c in ("finding_id", "pattern_name", "value", "snippet")])

    def make():
        tagger = Tagger(path)

        def run(ids, blocks, texts, fids, patterns, values, snippets, out):
            found = tagger.spans([t or "" for t in texts])
            alone: list[str] = []
            waiting: list[tuple] = []
            for i, block, t, spans, fi, pa, va, sn in zip(ids, blocks, texts, found, fids, patterns, values, snippets):
                if t and not block and spans:
                    out.append(("text", i, spans, t))
                flat = (t or "").replace("\n", " ")
                starts = [a for a, _, _ in spans]
                names = [squeezed_value(t[a:b]) for a, b, _ in spans] if fi else []
                for fid, pattern, value, snippet in zip(fi or (), pa or (), va or (), sn or ()):
                    inside = same = None
                    if snippet:
                        left = snippet.startswith("…")
                        core = snippet[left : len(snippet) - snippet.endswith("…")]
                        k = flat.find(core) if core else -1
                        if k >= 0:
                            seen = visible(spans, starts, k, k + len(core))
                            inside = [(a + left, b + left, kind) for a, b, kind, _ in seen]
                            same = {kind for _, _, kind, n in seen if names[n] == value}
                    if inside is None and snippet:
                        waiting.append((fid, pattern, value, snippet))
                        alone.append(snippet)
                    elif inside is None:
                        waiting.append((fid, pattern, value, None))
                        alone.append(f"\n{value or ''}\n")
                    else:
                        add_found(out, fid, pattern, value, snippet, inside, same)
            for (fid, pattern, value, snippet), spans in zip(waiting, tagger.spans(alone) if alone else ()):
                add_found(out, fid, pattern, value, snippet, spans)

        def f(*columns):
            out: list[tuple] = []
            a = size = 0
            texts = columns[2]
            for b, t in enumerate(texts):
                size += len(t or "")
                if size > 1_000_000 or b == len(texts) - 1:
                    run(*(c[a : b + 1] for c in columns), out)
                    a, size = b + 1, 0
            if flat:
                rows = [(field, row, x, y, k) for field, row, spans, _ in out for x, y, k in spans]
                return [list(c) for c in zip(*rows)] if rows else [[]] * 5
            cols = [[], [], [], []]
            for field, row, spans, text in out:
                cols[0].append(field)
                cols[1].append(row)
                cols[2].append([{"start_pos": x, "end_pos": y, "kind": k} for x, y, k in spans])
                cols[3].append(placeholder(text, spans))
            return cols

        return f

    return map_batches(rows, make, FLAT if flat else SCHEMA)


def add_found(out: list, fid: int, pattern: str | None, value: str | None, snippet: str | None, spans: list[tuple[int, int, str]], same: set[str] | None = None) -> None:
    """Adds the cases of a finding's snippet and value. The model's kind of the value must agree with the finding's own.

    same: kinds of the spans that read as the value, if any do.
    """
    if snippet and spans:
        out.append(("context_snippet", fid, spans, snippet))
    if not value:
        return
    kind = PATTERN_KINDS.get(pattern or "")
    if same:
        got = same
    elif snippet:
        at = place_value(snippet, value)
        got = {k for a, b, k in spans if at and a < at[1] and at[0] < b}
    else:
        got = {k for _, _, k in spans}
    if kind and kind in got:
        out.append(("value", fid, [(0, len(value), kind)], value))


def occurrences(results: DataFrame, findings: DataFrame, path: str = MODEL) -> DataFrame:
    """(field, row_id, start_pos, end_pos, kind), one row per case."""
    return findings_in(results, findings, path, flat=True)
