"""A character-level bidirectional LSTM with CRF transitions in numpy: scoring, decoding and gradients."""

from __future__ import annotations

import numpy as np

KINDS = ("email", "phone", "id_number", "address", "name")
#: O, then B and I of each kind.
TAGS = 1 + 2 * len(KINDS)


def classes() -> np.ndarray:
    """Class of every code point of the BMP: 0 padding, 1 unknown; figures but 7 and 8 are alike, wide forms as plain ones."""
    t = np.ones(0x10000, np.uint8)
    own = " \n!\"'()*+,-./:;<>@[]_{}|~^&=#%$?«»“”„’—–№…¬78éèêëîïåøáíóúñçßäöüÄÖÜЁёіІ"
    own += "".join(map(chr, range(0x41, 0x5B))) + "".join(map(chr, range(0x61, 0x7B))) + "".join(map(chr, range(0x410, 0x450)))
    for k, c in enumerate(dict.fromkeys(own)):
        t[ord(c)] = k + 3
    t[[ord(c) for c in "01234569"]] = 2
    top = len(dict.fromkeys(own)) + 3
    for o in (0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF, 0xAD, *range(0x300, 0x370)):
        t[o] = top
    for o in (0xA0, 0x2002, 0x2007, 0x2009, 0x202F, 0x3000, 9, 13):
        t[o] = t[32]
    for o in range(0xFF01, 0xFF5F):
        t[o] = t[o - 0xFEE0]
    t[0x2010] = t[0x2011] = t[ord("-")]
    return t


CLASSES = classes()
VOCABULARY = int(CLASSES.max()) + 1


def fresh(hidden: int, seed: int = 0) -> dict[str, np.ndarray]:
    """Parameters before training."""
    r = np.random.default_rng(seed)
    p = {}
    for d in "fb":
        p["x" + d] = r.normal(0, 0.15, (VOCABULARY, 4 * hidden)).astype(np.float32)
        p["h" + d] = (r.normal(0, 1, (hidden, 4 * hidden)) / np.sqrt(hidden)).astype(np.float32)
        b = np.zeros(4 * hidden, np.float32)
        b[hidden : 2 * hidden] = 1.0
        p["c" + d] = b
    p["o"] = r.normal(0, 0.1, (2 * hidden, TAGS)).astype(np.float32)
    p["ob"] = np.zeros(TAGS, np.float32)
    p["a"] = np.zeros((TAGS, TAGS), np.float32)
    return p


def forbidden() -> np.ndarray:
    """Transitions that can't be: I of a kind after anything but its B or I."""
    m = np.zeros((TAGS, TAGS), np.float32)
    for k in range(len(KINDS)):
        m[:, 2 + 2 * k] = -1e4
        m[1 + 2 * k, 2 + 2 * k] = m[2 + 2 * k, 2 + 2 * k] = 0
    return m


class Model:
    """Frozen parameters, laid out for speed: gates i, f, o scaled so that one tanh serves all."""

    def __init__(self, p: dict[str, np.ndarray]):
        self.hidden = p["hf"].shape[0]
        scale = np.ones(4 * self.hidden, np.float32)
        scale[: 3 * self.hidden] = 0.5
        self.side = [(np.ascontiguousarray((p["x" + d] + p["c" + d]) * scale, np.float32), np.ascontiguousarray(p["h" + d] * scale, np.float32)) for d in "fb"]
        self.o, self.ob = p["o"].astype(np.float32), p["ob"].astype(np.float32)
        self.a = (p["a"] + forbidden()).astype(np.float32)

    @staticmethod
    def load(path: str) -> "Model":
        with np.load(path) as z:
            return Model({k: z[k].astype(np.float32) for k in z.files})

    def states(self, ids: np.ndarray, side: int, out: np.ndarray) -> None:
        """Hidden states of one direction into out[L, B, H]."""
        x, w = self.side[side]
        ids = ids.astype(np.intp)
        n, b = ids.shape
        hid = self.hidden
        h, c = np.zeros((b, hid), np.float32), np.zeros((b, hid), np.float32)
        z, y = np.empty((b, 4 * hid), np.float32), np.empty((b, 4 * hid), np.float32)
        for t in range(n) if side == 0 else range(n - 1, -1, -1):
            np.dot(h, w, out=z)
            np.take(x, ids[t], axis=0, out=y)
            z += y
            np.tanh(z, out=z)
            s = z[:, : 3 * hid]
            s *= 0.5
            s += 0.5
            c *= z[:, hid : 2 * hid]
            c += z[:, :hid] * z[:, 3 * hid :]
            h = out[t]
            np.tanh(c, out=h)
            h *= z[:, 2 * hid : 3 * hid]

    def emissions(self, ids: np.ndarray) -> np.ndarray:
        """[L, TAGS, B] for ids [L, B]: whole batches lie side by side."""
        n, b = ids.shape
        e = None
        out = np.empty((n, b, self.hidden), np.float32)
        for side in (0, 1):
            self.states(ids, side, out)
            part = out.reshape(n * b, -1) @ self.o[side * self.hidden : (side + 1) * self.hidden]
            e = part if e is None else np.add(e, part, out=e)
        e += self.ob
        return np.ascontiguousarray(e.reshape(n, b, TAGS).transpose(0, 2, 1))

    def decode(self, e: np.ndarray) -> np.ndarray:
        """Best tags [L, B] of emissions [L, TAGS, B] by Viterbi."""
        n, k, b = e.shape
        others = np.r_[0, 1:k:2]
        into = self.a[:, others][:, :, None]
        own = self.a
        v = np.empty((n, k, b), np.float32)
        v[0] = e[0]
        v[0][2::2] -= 1e4
        for t in range(1, n):
            u = v[t - 1]
            v[t][others] = (u[:, None, :] + into).max(0)
            for i in range(2, k, 2):  # I only follows B or I of its kind
                np.maximum(u[i - 1] + own[i - 1, i], u[i] + own[i, i], out=v[t][i])
            v[t] += e[t]
        tags = np.empty((n, b), np.int8)
        tags[-1] = v[-1].argmax(0)
        at = np.ascontiguousarray(self.a.T)
        for t in range(n - 2, -1, -1):
            tags[t] = (v[t] + at[tags[t + 1]].T).argmax(0)
        return tags


def gradients(p: dict[str, np.ndarray], ids: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """(mean loss per character, gradients) of the CRF's negative log likelihood for ids and tags [L, B]."""
    n, b = ids.shape
    hid = p["hf"].shape[0]
    keep = {}
    hs = []
    for d in "fb":
        order = range(n) if d == "f" else range(n - 1, -1, -1)
        h, c = np.zeros((b, hid), np.float32), np.zeros((b, hid), np.float32)
        H = np.empty((n, b, hid), np.float32)
        G, C, HP, CP = np.empty((n, b, 4 * hid), np.float32), np.empty((n, b, hid), np.float32), np.empty((n, b, hid), np.float32), np.empty((n, b, hid), np.float32)
        for t in order:
            HP[t], CP[t] = h, c
            z = p["x" + d][ids[t]] + p["c" + d] + h @ p["h" + d]
            z[:, : 3 * hid] = 0.5 * np.tanh(0.5 * z[:, : 3 * hid]) + 0.5
            z[:, 3 * hid :] = np.tanh(z[:, 3 * hid :])
            c = z[:, hid : 2 * hid] * c + z[:, :hid] * z[:, 3 * hid :]
            C[t] = np.tanh(c)
            h = z[:, 2 * hid : 3 * hid] * C[t]
            G[t], H[t] = z, h
        keep[d] = (G, C, HP, CP)
        hs.append(H)
    both = np.concatenate(hs, 2)
    e = both @ p["o"] + p["ob"]
    A = np.exp(p["a"] + forbidden())
    top = e.max(2, keepdims=True)
    x = np.exp(e - top)
    start = np.ones(TAGS, np.float32)
    start[2::2] = 0
    alpha, norm = np.empty_like(x), np.empty((n, b, 1), np.float32)
    v = x[0] * start
    for t in range(n):
        if t:
            v = (alpha[t - 1] @ A) * x[t]
        norm[t] = v.sum(1, keepdims=True)
        alpha[t] = v / norm[t]
    beta = np.empty_like(x)
    beta[-1] = 1
    pair = np.zeros((TAGS, TAGS), np.float32)
    for t in range(n - 2, -1, -1):
        y = x[t + 1] * beta[t + 1] / norm[t + 1]
        beta[t] = y @ A.T
        pair += alpha[t].T @ y
    pair *= A
    m = alpha * beta
    m /= m.sum(2, keepdims=True)
    i, j = np.meshgrid(np.arange(n), np.arange(b), indexing="ij")
    gold = e[i, j, tags].sum() + (p["a"] + forbidden())[tags[:-1], tags[1:]].sum()
    loss = float(np.log(norm).sum() + top.sum() - gold)
    de = m
    de[i, j, tags] -= 1
    seen = np.zeros((TAGS, TAGS), np.float32)
    np.add.at(seen, (tags[:-1].ravel(), tags[1:].ravel()), 1)
    g = {"a": pair - seen, "o": both.reshape(-1, 2 * hid).T @ de.reshape(-1, TAGS), "ob": de.sum((0, 1))}
    dboth = de @ p["o"].T
    for s, d in enumerate("fb"):
        G, C, HP, CP = keep[d]
        dz = np.empty_like(G)
        dh, dc = np.zeros((b, hid), np.float32), np.zeros((b, hid), np.float32)
        for t in range(n - 1, -1, -1) if d == "f" else range(n):
            z, c = G[t], C[t]
            dh = dh + dboth[t, :, s * hid : (s + 1) * hid]
            i_, f_, o_, g_ = z[:, :hid], z[:, hid : 2 * hid], z[:, 2 * hid : 3 * hid], z[:, 3 * hid :]
            dc = dc + dh * o_ * (1 - c * c)
            q = dz[t]
            q[:, :hid] = dc * g_ * i_ * (1 - i_)
            q[:, hid : 2 * hid] = dc * CP[t] * f_ * (1 - f_)
            q[:, 2 * hid : 3 * hid] = dh * c * o_ * (1 - o_)
            q[:, 3 * hid :] = dc * i_ * (1 - g_ * g_)
            dc = dc * f_
            dh = q @ p["h" + d].T
        flat = dz.reshape(-1, 4 * hid)
        g["h" + d] = HP.reshape(-1, hid).T @ flat
        g["c" + d] = flat.sum(0)
        order = np.argsort(ids.ravel(), kind="stable")
        keys = ids.ravel()[order]
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        gx = np.zeros_like(p["x" + d])
        gx[keys[first]] = np.add.reduceat(flat[order], first, axis=0)
        g["x" + d] = gx
    for k in g:
        g[k] /= n * b
    return loss / (n * b), g


class Adam:
    def __init__(self, p: dict[str, np.ndarray]):
        self.m = {k: np.zeros_like(v) for k, v in p.items()}
        self.v = {k: np.zeros_like(v) for k, v in p.items()}
        self.t = 0

    def step(self, p: dict[str, np.ndarray], g: dict[str, np.ndarray], rate: float) -> None:
        self.t += 1
        size = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
        clip = min(1.0, 0.5 / (size + 1e-9))
        for k in p:
            d = g[k] * clip
            self.m[k] += 0.1 * (d - self.m[k])
            self.v[k] += 0.001 * (d * d - self.v[k])
            p[k] -= rate * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.999**self.t)) + 1e-8)
