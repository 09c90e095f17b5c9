"""Anchors of 50-byte windows: the sampled suffixes on which repeated strings meet.

Every window of WIDTH bytes has one anchor, the leftmost smallest of its k-gram hashes. It depends on
the window's bytes alone, so equal windows have equal anchors at equal distances.
"""

from __future__ import annotations

import numpy as np

WIDTH = 50
GRAM = 24
ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
BASE = np.uint64(0xD6E8FEB86659FD93)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
BYTE = np.random.default_rng(5).integers(0, 1 << 64, 256, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * ODD[1]
    return x ^ (x >> np.uint64(29))


def gram_hashes(data: bytes, k: int = GRAM) -> np.ndarray:
    """A hash of each k-gram, k a multiple of 8, from overlapping 8-byte words."""
    words = np.ndarray((len(data) - 7,), "<u8", data, 0, (1,))
    n = len(data) - k + 1
    h = words[:n] * ODD[0]
    for j in range(8, k, 8):
        h = mix(h) + words[j : j + n] * ODD[2]
    return mix(h)


def anchors(h: np.ndarray, width: int) -> np.ndarray:
    """For each window of width hashes the place of the leftmost smallest one."""
    low, at, span = h, np.arange(len(h), dtype=np.int32), 1
    while span * 2 <= width:
        left = low[:-span] <= low[span:]
        at = np.where(left, at[:-span], at[span:])
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if rest := width - span:
        at = np.where(low[:-rest] <= low[rest:], at[:-rest], at[rest:])
    return at


class Prefixes:
    """Hashes of any substring of a text from one pass over its bytes."""

    powers = np.ones(1, np.uint64)
    inverses = np.ones(1, np.uint64)

    def __init__(self, data: bytes):
        n = len(data) + 1
        if len(Prefixes.powers) < n:
            size = max(n, 2 * len(Prefixes.powers))
            Prefixes.powers = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size, BASE)]))
            Prefixes.inverses = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size, INVERSE)]))
        self.sums = np.zeros(n, np.uint64)
        np.cumsum(BYTE[np.frombuffer(data, np.uint8)] * Prefixes.powers[: n - 1], out=self.sums[1:])

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * Prefixes.inverses[start] + (end - start).astype(np.uint64))


def runs(texts: list[bytes], width: int = WIDTH, k: int = GRAM, passes: int = 1, number: int = 0) -> tuple[np.ndarray, ...]:
    """(text, gram hash, context hash, first window, last window) for each run of windows with one anchor;
    the context is the text from the first window's start to the last one's end. The texts are laid end
    to end, and windows across a border are left out. Of several passes, each has the runs of its
    share of the gram hashes."""
    data, sizes = b"".join(texts), np.array([len(t) for t in texts], np.int64)
    starts = np.cumsum(sizes) - sizes
    if len(data) < width:
        return (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    at = anchors(h := gram_hashes(data, k), width - k + 1)
    inside = np.zeros(len(at) + 1, np.int8)
    whole = sizes >= width
    np.add.at(inside, starts[whole], 1)
    np.add.at(inside, (starts + sizes - width + 1)[whole], -1)
    valid = np.cumsum(inside[:-1]) > 0
    border = np.zeros(len(at), bool)
    border[starts[whole]] = True
    change = np.flatnonzero((at[1:] != at[:-1]) | (valid[1:] != valid[:-1]) | border[1:])
    first = np.concatenate([[0], change + 1])
    last = np.concatenate([change, [len(at) - 1]])
    place = at[first]
    mine = valid[first]
    if passes > 1:
        mine &= (h[place] >> np.uint64(50)) % np.uint64(passes) == number
    first, last, place = first[mine], last[mine], place[mine]
    text = np.searchsorted(starts, first, "right") - 1
    # empty texts share a start with the next one; the last of equal starts is the one with bytes
    context = Prefixes(data).hashes(first, last + width) ^ (place - first).astype(np.uint64)
    return text, h[place], context, first - starts[text], last - starts[text]
