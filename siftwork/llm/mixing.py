"""Mixing sources to target weights (problem 8), by soft membership.

1. Every document's tokens are counted by a public tokenizer whose file is a parameter.
2. A naive Bayes classifier, fitted on the labelled table, predicts each document's domain. Its features are the document's source
   tag, if it has one, and its tokens (hashed); their counts come from at most TRAIN_ROWS rows, an equal part of every domain. The weight of the tokens
   beside the tag is the one that predicts the other half of these rows best, so text that tells nothing gets none.
3. Nonnegative rates of the documents, at most their source's max_repeats, start at zero and are fitted by projected gradient steps on the
   squared differences between the expected tokens of the domains and their targets. A step adds to a rate its memberships times the domains'
   misses, over the tokens of the domains it belongs to (with this scale, no step overshoots), so the rates follow from the misses of all steps
   so far: a pass over the documents replays these and adds up a few numbers per domain, and no rate is stored.
4. Rates become whole repeats by a hash of the document's id, so that expected sizes are kept.

A source can't reach its share if the fitted expected tokens and the room that its documents' bounds leave stay below the target.

Domains are the sources named by the mixtures, and one for all others: a fixed table, hence no more than a few arrays at the driver.

Defined cases: null and empty texts have no tokens; documents of unknown source belong to domains by their text alone and are used in
no mixture (they have no repeat limit); sources without documents reach nothing; a mixture with no target gives no rows.
"""

from __future__ import annotations

import base64
import os

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwork.util import checkpoint, map_batches

TRAIN_ROWS = 5_000
BUCKETS = 4_096
#: Pseudo-documents of every tag in every domain, and pseudo-tokens of every bucket.
TAG_PRIOR, TOKEN_PRIOR = 0.01, 0.5
#: Weights of the tokens that are tried.
WEIGHTS = (0.0, 1 / 64, 1 / 16, 1 / 4, 1.0)
#: Most steps, and the change of expected tokens, relative to the targets, below which they end.
STEPS, ENOUGH = 40, 1e-6
#: Folder of the public tokenizers' files and the one used; both can be set by the caller.
TOKENIZERS = os.environ.get("SIFTWORK_TOKENIZERS", "/opt/tokenizers")
TOKENIZER = "byte_bpe_multi_50k.tiktoken"
#: How the tokenizer cuts text into words (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def tokenizer(path: str):
    """encode(text) of a rank file."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


class Classifier:
    """Posteriors of the domains, the last one for all other sources."""

    def __init__(self, domains: list[str], documents: np.ndarray, tokens: np.ndarray, weight: float = 1.0):
        n = len(domains) + 1
        self.where = {d: k for k, d in enumerate(domains)}
        p = tokens + TOKEN_PRIOR
        self.words = (np.log(p / p.sum(1, keepdims=True)) - np.log(p.sum(0) / p.sum())).astype(np.float32)
        self.prior = np.log((documents + TAG_PRIOR) / (documents.sum() + n * TAG_PRIOR))
        tag = np.full((n, n), TAG_PRIOR) + np.diag(documents)
        self.tag = np.log(tag / tag.sum(1, keepdims=True))
        self.weight = weight

    def domain(self, source: str) -> int:
        return self.where.get(source, len(self.where))

    def log_posterior(self, tokens: np.ndarray, source: str | None, weight: float) -> np.ndarray:
        s = self.prior + weight * self.words[:, tokens % BUCKETS].sum(1)
        if source is not None:
            s = s + self.tag[:, self.domain(source)]
        s = s - s.max()
        return s - np.log(np.exp(s).sum())

    def posterior(self, tokens: np.ndarray, source: str | None) -> np.ndarray:
        return np.exp(self.log_posterior(tokens, source, self.weight))


def fit_classifier(docs: DataFrame, domains: list[str], path: str) -> Classifier:
    """Tags from all rows, tokens from a sample: of every domain an equal part of TRAIN_ROWS, half to count and half to choose the tokens' weight."""
    domain = F.when(F.col("source").isin(domains), F.col("source")) if domains else F.lit(None).cast("string")
    n = {r.d: r.n for r in docs.filter("source is not null").groupBy(domain.alias("d")).agg(F.count("*").alias("n")).collect()}
    documents = np.array([float(n.get(d, 0)) for d in [*domains, None]])
    quota = TRAIN_ROWS // len(documents)
    parts = {d: min(1.0, quota / k) for d, k in n.items()}
    chosen = F.lit(False)
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000))
    for d, part in parts.items():
        chosen = chosen | ((F.col("source") == d if d is not None else domain.isNull()) & (place < int(1_000_000 * part)))
    sample = docs.filter(F.col("source").isNotNull() & chosen).select("source", "text", F.pmod(F.hash("doc_id"), F.lit(2)).alias("half"))
    where = {d: k for k, d in enumerate(domains)}

    def count():
        encode = tokenizer(path)

        def f(sources, texts, half):
            x = [np.array(encode(t), np.int64) % BUCKETS + where.get(s, len(where)) * BUCKETS for s, t, h in zip(sources, texts, half) if t and h == 0]
            k, n = np.unique(np.concatenate(x), return_counts=True) if x else ([], [])
            return [k, n]

        return f

    tokens = np.zeros((len(domains) + 1) * BUCKETS)
    for r in map_batches(sample, count, "k int, n bigint").groupBy("k").agg(F.sum("n").alias("n")).collect():
        tokens[r.k] = r.n
    c = Classifier(domains, documents, tokens.reshape(-1, BUCKETS))

    def judge():
        encode = tokenizer(path)

        def f(sources, texts, half):
            total = np.zeros(len(WEIGHTS))
            for s, t, h in zip(sources, texts, half):
                if t and h == 1:
                    x = np.array(encode(t), np.int64)
                    total += [c.log_posterior(x, None, w)[c.domain(s)] for w in WEIGHTS]
            return [list(range(len(WEIGHTS))), total]

        return f

    fits = {r.k: r.x for r in map_batches(sample, judge, "k int, x double").groupBy("k").agg(F.sum("x").alias("x")).collect()}
    c.weight = WEIGHTS[max(fits, key=lambda k: (fits[k], -k))] if fits else 0.0
    return c


def memberships(docs: DataFrame, domains: list[str], path: str) -> DataFrame:
    """(doc_id, source, tokens, member array<float>) of every document; member's last place is for other sources."""
    c = fit_classifier(docs, domains, path)

    def make():
        encode = tokenizer(path)

        def f(ids, sources, texts):
            tokens, member = [], []
            for s, t in zip(sources, texts):
                x = np.array(encode(t or ""), np.int64)
                tokens.append(len(x))
                member.append(c.posterior(x, s).tolist())
            return [ids, sources, tokens, member]

        return f

    kind = dict(docs.dtypes)["doc_id"]
    return map_batches(docs.select("doc_id", "source", "text"), make, f"doc_id {kind}, source string, tokens bigint, member array<float>")


class Mix:
    """One mixture's targets on the domains, and the steps taken so far."""

    def __init__(self, name: str, rows: list, domains: list[str], total: int):
        self.name = name
        self.target = np.zeros(len(domains) + 1)
        self.cap = {}
        self.inside = np.zeros(len(domains) + 1, bool)
        for r in rows:
            k = domains.index(r.source)
            self.target[k] += r.target_share * r.budget_ratio * total
            self.cap[r.source] = float(r.max_repeats)
            self.inside[k] = True
        self.steps: list[np.ndarray] = []
        self.expected = np.zeros(len(domains) + 1)
        self.room = np.zeros(len(domains) + 1)
        self.all_of = np.zeros(len(domains) + 1)
        self.done = False

    def rates(self, sources: list[str | None], member: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rates, their limits): every step goes down the gradient and projects onto [0, max_repeats].

        With steps scaled by 1 / (memberships x tokens of the domains) the curvature is at most 1, by Cauchy's inequality.
        """
        cap = np.array([self.cap.get(s, 0.0) for s in sources])
        r = np.zeros(len(cap))
        if self.steps:
            scale = 1 / np.maximum(member @ self.all_of, 1e-9)
            for g in (member @ np.array(self.steps).T).T:
                np.clip(r + scale * g, 0, cap, out=r)
        return r, cap


def fit_rates(members: DataFrame, mixes: list[Mix]) -> list[Mix]:
    """Projected gradient descent from zero. What comes back from a pass is, per mixture and domain, the expected tokens under the rates and
    the room that the limits leave."""
    for _ in range(STEPS if mixes else 0):

        def make(mixes=mixes):
            def f(sources, tokens, member):
                a = np.array(member, np.float64)
                t = np.array(tokens, np.float64)
                out = []
                for k, m in enumerate(mixes):
                    r, cap = m.rates(sources, a)
                    got, room, all_of = a.T @ (r * t), a.T @ ((cap - r) * t), a.T @ (t * (cap > 0))
                    out += [(k, int(d), float(got[d]), float(room[d]), float(all_of[d])) for d in np.flatnonzero(m.inside)]
                return [list(c) for c in zip(*out)] if out else [[]] * 5

            return f

        sums = map_batches(members.select("source", "tokens", "member"), make, "mix int, d int, got double, room double, all_of double").groupBy("mix", "d").agg(*[F.sum(c).alias(c) for c in ("got", "room", "all_of")]).collect()
        for k, m in enumerate(mixes):
            if m.done:
                continue
            before = m.expected.copy()
            for r in sums:
                if r.mix == k:
                    m.expected[r.d], m.room[r.d], m.all_of[r.d] = r.got, r.room, r.all_of
            m.done = bool(m.steps) and np.abs(m.expected - before).max(initial=0) <= ENOUGH * m.target.sum()
            if not m.done:
                m.steps.append(np.where(m.inside, m.target - m.expected, 0.0))
        if all(m.done for m in mixes):
            break
    return mixes


def prepare(docs: DataFrame, targets: DataFrame, path: str | None = None) -> tuple[DataFrame, list[Mix], list[str], int]:
    """(members, fitted mixtures, domains, tokens of all documents)."""
    rows = targets.orderBy("mix_name", "source").collect()  # a fixed table of mixtures
    domains = sorted({r.source for r in rows if r.source is not None})
    members = checkpoint(memberships(docs, domains, path or os.path.join(TOKENIZERS, TOKENIZER)))
    total = members.agg(F.sum("tokens").alias("n")).first().n or 0
    mixes = [Mix(name, [r for r in rows if r.mix_name == name and r.source is not None], domains, total) for name in sorted({r.mix_name for r in rows})]
    return members, fit_rates(members, mixes), domains, total


def mixture(docs: DataFrame, targets: DataFrame, path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """((mix_name, doc_id, source, tokens, rate, repeats), (mix_name, source, target_share, budget_ratio, max_repeats, target_tokens, expected_tokens, tokens, available_tokens, reached_share, capped))."""
    members, mixes, _, total = prepare(docs, targets, path)
    kind = dict(docs.dtypes)["doc_id"]

    def make():
        def f(ids, sources, tokens, member):
            a = np.array(member, np.float64)
            out = [[], [], [], [], []]
            for m in mixes:
                r, _ = m.rates(sources, a)
                for k in np.flatnonzero(r > 0):
                    for c, v in zip(out, (m.name, ids[k], sources[k], tokens[k], float(r[k]))):
                        c.append(v)
            return out

        return f

    rated = map_batches(members.select("doc_id", "source", "tokens", "member"), make, f"mix_name string, doc_id {kind}, source string, tokens bigint, rate double")
    chance = F.pmod(F.xxhash64("mix_name", "doc_id"), F.lit(1_000_003)) / 1_000_003.0
    used = rated.withColumn("repeats", F.floor(F.col("rate") + chance).cast("int"))
    got = used.groupBy("mix_name", "source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("tokens"), F.sum(F.col("tokens") * F.col("rate")).alias("expected_tokens"))
    have = members.groupBy("source").agg(F.sum("tokens").alias("available_tokens"))
    # both sides have at most one row per row of the fixed table of targets
    want = targets.select("mix_name", "source", "target_share", "max_repeats", "budget_ratio", (F.col("target_share") * F.col("budget_ratio") * F.lit(total)).alias("target_tokens"))
    shares = (
        want.join(F.broadcast(got.join(want.select("mix_name", "source"), ["mix_name", "source"], "left_semi")), ["mix_name", "source"], "left")
        .join(F.broadcast(have.join(want.select("source").distinct(), "source", "left_semi")), "source", "left")
        .fillna(0, ["tokens", "expected_tokens", "available_tokens"])
        .withColumn("reached_share", F.col("tokens") / F.when(F.col("budget_ratio") * total > 0, F.col("budget_ratio") * total))
    )
    return used, shares


def unreachable(docs: DataFrame, targets: DataFrame, path: str | None = None) -> DataFrame:
    """(mix_name, source) whose expected tokens, with all the room that the limits leave, stay below their target."""
    _, mixes, domains, _ = prepare(docs, targets, path)
    short = [(m.name, d) for m in mixes for k, d in enumerate(domains) if m.inside[k] and m.expected[k] + m.room[k] < m.target[k]]
    # a part of the fixed table of targets
    return docs.sparkSession.createDataFrame(short, f"mix_name {dict(targets.dtypes)['mix_name']}, source {dict(targets.dtypes)['source']}")
