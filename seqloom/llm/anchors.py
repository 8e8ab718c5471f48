"""Content-defined anchors: any two equal windows of bytes have their anchors at the same place in them."""

from __future__ import annotations

import numpy as np

#: Bytes of the string that an anchor is the hash of.
GRAM = 64
_R = np.random.default_rng(20240501).integers(1, 1 << 63, 256, dtype=np.uint64)
_M = np.uint64(0x9E3779B97F4A7C15)
#: A position inside one buffer has so many bits in the values that are compared.
AT = np.uint64(26)


def gram_hashes(buf: np.ndarray) -> np.ndarray:
    """64-bit hash of the GRAM bytes from every position, by doubling."""
    h, width = _R[buf], 1
    while width < GRAM:
        h = h[:-width] * _M + (h[width:] ^ (h[width:] >> np.uint64(29)))
        h ^= h >> np.uint64(32)
        width *= 2
    return h


def sliding_least(x: np.ndarray, w: int) -> np.ndarray:
    """The smallest of each w values in a row."""
    n = len(x) - w + 1
    full = np.full(-(-len(x) // w) * w, np.iinfo(np.uint64).max, np.uint64)
    full[: len(x)] = x
    rows = full.reshape(-1, w)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[w - 1 : w - 1 + n])


def anchors(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """hash, text, position, first and last window start (all positions inside the text) of every anchor.

    The anchor of a window of `width` bytes is its gram with the smallest hash, the first of equal ones. Windows do not
    reach over a text's end, and each window of each text belongs to one anchor.
    """
    empty = np.zeros(0, np.int64)
    if len(buf) < width:
        return np.zeros(0, np.uint64), empty, empty, empty, empty
    h = gram_hashes(buf)
    mark = (h >> AT << AT) | np.arange(len(h), dtype=np.uint64)
    at = (sliding_least(mark, width - GRAM + 1) & np.uint64((1 << int(AT)) - 1)).astype(np.int64)
    text = np.repeat(np.arange(len(starts)), ends - starts)[: len(at)]
    inside = np.arange(len(at)) + width <= ends[text]
    new = np.r_[True, (at[1:] != at[:-1]) | (text[1:] != text[:-1])] & inside
    first = np.flatnonzero(new)
    end = np.r_[True, (at[:-1] != at[1:]) | (text[:-1] != text[1:]) | ~inside[1:]][1:] if len(at) > 1 else np.zeros(0, bool)
    end = np.r_[end, True] & inside
    last = np.flatnonzero(end)
    pos, own = at[first], text[first]
    return h[pos], own, pos - starts[own], first - starts[own], last - starts[own]
