"""Character classes of whole batches of texts, by table lookup in numpy: far cheaper than a regular expression at every place."""

from __future__ import annotations

import numpy as np


def codes(s: str) -> np.ndarray:
    """Code points; those beyond the BMP as U+FFFF."""
    return np.minimum(np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32), 0xFFFF)


def joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points of the texts, a line feed after each, start of each text)."""
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=starts[1:])
    return codes("\n".join(texts) + "\n"), starts


def texts_with(mask: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Which texts have a True place."""
    out = np.zeros(len(starts) - 1, bool)
    out[np.searchsorted(starts, np.flatnonzero(mask), "right") - 1] = True
    return out


def table(*classes: tuple[int, object]) -> np.ndarray:
    """Bits for code points: (bit, characters or ranges of code points)."""
    t = np.zeros(0x10000, np.uint8)
    for bit, what in classes:
        for c in what:
            if isinstance(c, tuple):
                t[c[0] : c[1] + 1] |= bit
            else:
                t[ord(c)] |= bit
    return t
