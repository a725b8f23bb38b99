"""Words of many texts at once: positions and 64-bit hashes, by array operations.

A word is a maximal run of bytes other than space, tab, line feed, vertical
tab, form feed and carriage return.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np

WHITE = b"\x20\x09\x0a\x0b\x0c\x0d"
BASE = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@functools.cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    white = np.zeros(256, bool)
    white[list(WHITE)] = True
    return white, mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


@functools.lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and its inverse, modulo 2 ** 64, for i below n."""
    inverse = pow(BASE, -1, 1 << 64)
    out = []
    for b in (BASE, inverse):
        p = np.full(n, b, np.uint64)
        p[0] = 1
        with np.errstate(over="ignore"):
            np.multiply.accumulate(p, out=p)
        out.append(p)
    return out[0], out[1]


@dataclass
class Words:
    """The words of a run of texts: byte ranges in ``data``, hashes, and the first word of each text (one more at the end)."""

    data: bytes
    start: np.ndarray
    end: np.ndarray
    hashes: np.ndarray
    first: np.ndarray


#: Bytes hashed at a time, whatever the length of a text or of a word.
PIECE = 1 << 18


def hashed(texts: list[bytes]) -> Words:
    """Finds and hashes the words of all ``texts``; equal words have equal hashes.

    A word's hash is a sum over its bytes, so a word that lies in several
    pieces is the sum of its parts, each moved to its place.
    """
    data = b"\n".join(texts) + b"\n"
    white, random = _tables()
    raw = np.frombuffer(data, np.uint8)
    power, inverse = _powers(PIECE)
    starts, ends, sums = [], [], []
    open_at, open_sum = -1, 0
    with np.errstate(over="ignore"):
        for at in range(0, len(raw), PIECE):
            part = raw[at : at + PIECE]
            edge = np.flatnonzero(np.diff(white[part], prepend=open_at < 0))
            total = np.empty(len(part) + 1, np.uint64)
            total[0] = 0
            np.cumsum(random[part] * power[: len(part)], out=total[1:])
            if open_at >= 0:
                upto = int(edge[0]) if len(edge) else len(part)
                open_sum = (open_sum + int(total[upto]) * pow(BASE, at - open_at, 1 << 64)) % (1 << 64)
                if not len(edge):
                    continue
                starts.append(np.array([open_at]))
                ends.append(np.array([at + upto]))
                sums.append(np.array([open_sum], np.uint64))
                edge, open_at = edge[1:], -1
            start, end = edge[0::2], edge[1::2]
            if len(start) > len(end):
                last = int(start[-1])
                start, open_at, open_sum = start[:-1], at + last, int((total[-1] - total[last]) * inverse[last])
            starts.append(start + at)
            ends.append(end + at)
            sums.append((total[end] - total[start]) * inverse[start])
        start, end = np.concatenate(starts), np.concatenate(ends)
        h = mix(np.concatenate(sums) + (end - start).astype(np.uint64))
    offsets = np.cumsum([0] + [len(t) + 1 for t in texts])
    return Words(data, start, end, h, np.searchsorted(start, offsets))


def windows(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words inside one text, and the first of each text (one more at the end)."""
    n = len(w.hashes) - size + 1
    first = np.concatenate([[0], np.cumsum(np.maximum(np.diff(w.first) - size + 1, 0))])
    if n <= 0:
        return np.empty(0, np.uint64), np.zeros(len(first), np.int64)
    h = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for a in range(0, n, PIECE):
            part = h[a : a + PIECE]
            for k in range(size):
                part *= np.uint64(0x100000001B3)
                part += w.hashes[a + k : a + k + len(part)] ^ np.uint64(k * 0x9E37)
                part ^= part >> np.uint64(29)
            part[:] = mix(part)
    inside = np.ones(n, bool)
    for k in range(1, size):  # windows that reach over the end of their text
        at = w.first[1:-1] - k
        inside[at[(at >= 0) & (at < n)]] = False
    return h if inside.all() else h[inside], first
