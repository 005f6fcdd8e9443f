"""Trains the tagger of personal information from labelled spans.

    python -m siftwork.llm.pii_train DATA_DIR OUT.npz [STEPS [HIDDEN [FIRST.npz]]]

Labelled spans are the findings of a results table: a finding's value is placed in its context snippet, the snippet in the text, and every other
occurrence of the same characters in that text gets the same label. At most TRAIN_TEXTS texts are read (the bound of the sample).
"""

from __future__ import annotations

import sys
from collections import defaultdict

import numpy as np

from siftwork.llm import lstm

TRAIN_TEXTS = 6_000
LENGTH, BATCH = 224, 128
PATTERN_KINDS = {
    "phone": "phone", "email": "email", "full_name": "name", "full_name_context": "name", "initials_name": "name", "address": "address",
    "snils": "id_number", "inn": "id_number", "passport_rf": "id_number",
}


def squeezed(s: str) -> tuple[str, list[int]]:
    """(s without white space and hyphens, in lower case; the place of each character)."""
    out, at = [], []
    for i, c in enumerate(s):
        if not c.isspace() and c != "-":
            for x in c.lower():
                out.append(x)
                at.append(i)
    return "".join(out), at


def place_value(snippet: str, value: str) -> tuple[int, int] | None:
    """Where the value stands in its snippet: the occurrence with like contexts on both sides."""
    left, right = snippet.startswith("…"), snippet.endswith("…")
    s, at = squeezed(snippet)
    best = None
    k = s.find(value)
    while k >= 0 and value:
        a, b = at[k], at[k + len(value) - 1] + 1
        off = abs((a - left) - (len(snippet) - right - b)) if left == right else abs(a - 61) if left else abs(len(snippet) - b - 61)
        if best is None or off < best[0]:
            best = (off, a, b)
        k = s.find(value, k + 1)
    return best and best[1:]


def labelled(texts: dict[int, str], findings) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """[(text, [(start, end, kind number)])] from (result_id, pattern_name, value, context_snippet) rows."""
    spans: dict[int, set] = defaultdict(set)
    for r, pattern, value, snippet in findings:
        kind = PATTERN_KINDS.get(pattern)
        if kind is None or not value or not snippet or r not in texts:
            continue
        t = texts[r]
        core = snippet.strip("…")
        k = t.replace("\n", " ").find(core)
        here = place_value(snippet, value) if k >= 0 else None
        if not here:
            continue
        off = k - snippet.startswith("…")
        a, b = here[0] + off, here[1] + off
        raw = t[a:b]
        k = t.find(raw)
        while k >= 0:
            if not t[k - 1 : k].isalnum() and not t[k + len(raw) : k + len(raw) + 1].isalnum():
                spans[r].add((k, k + len(raw), lstm.KINDS.index(kind)))
            k = t.find(raw, k + 1)
    out = []
    for r, t in texts.items():
        free, rows = 0, []
        for a, b, k in sorted(spans.get(r, ()), key=lambda x: (x[0], -x[1])):
            if a >= free:
                rows.append((a, b, k))
                free = b
        out.append((t, rows))
    return out


def bare_values(findings, most: int = 30_000) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Values by themselves, a line each: what a finding without a snippet looks like."""
    out, text, spans = [], "\n", []
    for _, pattern, value, _ in findings[:most]:
        if not value:
            continue
        kind = PATTERN_KINDS.get(pattern)
        if kind:
            spans.append((len(text), len(text) + len(value), lstm.KINDS.index(kind)))
        text += value + "\n"
        if len(text) > 600:
            out.append((text, spans))
            text, spans = "\n", []
    return out


def arrays(rows) -> list[tuple[np.ndarray, np.ndarray]]:
    from siftwork.llm import chars

    out = []
    for t, spans in rows:
        tags = np.zeros(len(t), np.int8)
        for a, b, k in spans:
            tags[a] = 1 + 2 * k
            tags[a + 1 : b] = 2 + 2 * k
        out.append((lstm.CLASSES[chars.codes(t)], tags))
    return out


def completed(rows, path: str) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """The same rows with what a first model finds beside the labels: the findings miss some cases."""
    from siftwork.llm.pii import Tagger

    tagger, out = Tagger(path), []
    for k in range(0, len(rows), 500):
        part = rows[k : k + 500]
        for (t, spans), more in zip(part, tagger.spans([t for t, _ in part])):
            new = [(a, b, lstm.KINDS.index(kind)) for a, b, kind in more if not any(a < y and x < b for x, y, _ in spans)]
            out.append((t, sorted(spans + new)))
    return out


def train(data: list[tuple[np.ndarray, np.ndarray]], hidden: int = 24, steps: int = 1200, seed: int = 0, rate: float = 0.01, note=print, start: dict | None = None) -> dict[str, np.ndarray]:
    r = np.random.default_rng(seed)
    p = {k: v.astype(np.float32).copy() for k, v in start.items()} if start else lstm.fresh(hidden, seed)
    adam = lstm.Adam(p)
    weight = np.array([len(x) for x, _ in data], float) ** 0.7
    weight /= weight.sum()
    total = 0.0
    for s in range(steps):
        ids, tags = np.zeros((LENGTH, BATCH), np.int64), np.zeros((LENGTH, BATCH), np.int64)
        for k, i in enumerate(r.choice(len(data), BATCH, p=weight)):
            x, y = data[i]
            a = int(r.integers(0, max(1, len(x) - LENGTH // 2)))
            n = min(LENGTH, len(x) - a)
            ids[:n, k], tags[:n, k] = x[a : a + n], y[a : a + n]
            # a span that began before the window begins here
            if tags[0, k] and tags[0, k] % 2 == 0:
                tags[0, k] -= 1
        loss, g = lstm.gradients(p, ids, tags)
        lr = rate * min(1, (s + 1) / 40) * (1 if s < 0.5 * steps else 0.5 * (1 + np.cos(np.pi * (s / steps - 0.5) / 0.5)) + 0.01)
        adam.step(p, g, lr)
        total = 0.98 * total + 0.02 * loss if s else loss
        if s % 50 == 49:
            note(f"step {s + 1}: loss {total:.4f}", flush=True)
    return p


def main(data_dir: str, out: str, steps: int = 1200, hidden: int = 24, first: str | None = None) -> None:
    import pyarrow.parquet as pq

    t = pq.read_table(f"{data_dir}/extraction_results.parquet", columns=["result_id", "text"]).slice(0, TRAIN_TEXTS)
    texts = {i: x for i, x in zip(t["result_id"].to_pylist(), t["text"].to_pylist()) if x and x.strip()}
    f = pq.read_table(f"{data_dir}/pii_findings.parquet", columns=["result_id", "pattern_name", "value", "context_snippet"])
    findings = list(zip(*(f[c].to_pylist() for c in f.column_names)))
    rows = labelled(texts, findings)
    start = None
    if first:  # go on from a first model, with its finds among the labels
        rows = completed(rows, first)
        with np.load(first) as z:
            start = {k: z[k] for k in z.files}
    p = train(arrays(rows + bare_values(findings)), hidden, steps, rate=0.004 if first else 0.01, seed=1 if first else 0, start=start)
    np.savez_compressed(out, **{k: v.astype(np.float16) for k, v in p.items()})


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2], *map(int, sys.argv[3:5]), *sys.argv[5:6])
