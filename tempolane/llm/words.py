"""Vectorised word positions and hashes over the UTF-8 bytes of whole texts.

Words are maximal runs of bytes other than space, tab, line feed, vertical tab, form feed and carriage return; as all other
bytes of a text belong to one of its characters, these are the matches of ``[^\\x20\\x09-\\x0D]+``.
"""

from __future__ import annotations

import numpy as np

_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
#: Bytes hashed at once; longer texts are cut between words.
WINDOW = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit mixing generator (xor-shift, multiply)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    table = np.full(max(n, 1), _BASE, np.uint64)
    table[0] = 1
    return np.multiply.accumulate(table)


class WordHasher:
    """Start, end and 64-bit hash of each word of a byte string."""

    def __init__(self):
        self.powers = _powers(256)

    def spans(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        space = np.concatenate(([True], _SPACE[data], [True]))
        edge = np.flatnonzero(space[1:] != space[:-1])
        return edge[::2], edge[1::2]

    def hashes(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        out = np.zeros(len(starts), np.uint64)
        if not len(starts):
            return out
        longest = int((ends - starts).max())
        if longest > len(self.powers):
            self.powers = _powers(2 * longest)
        a = 0
        while a < len(starts):
            b = max(a + 1, int(np.searchsorted(ends, starts[a] + WINDOW, side="right")))
            lo, hi = int(starts[a]), int(ends[b - 1])
            chunk = data[lo:hi].astype(np.uint64) + np.uint64(1)
            s, length = starts[a:b] - lo, ends[a:b] - starts[a:b]
            # Positions inside each word; bytes between words get whatever, their sums are not used.
            inside = np.arange(hi - lo) - np.repeat(s, np.diff(np.append(s, hi - lo)))
            np.minimum(inside, len(self.powers) - 1, out=inside)
            chunk *= self.powers[inside]
            chunk[_SPACE[data[lo:hi]]] = 0
            out[a:b] = mix(np.add.reduceat(chunk, s) + length.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
            a = b
        return out


def join_texts(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, parted by line feeds, and the place where each text starts (one more: the end)."""
    starts = np.cumsum([0, *(len(x) + 1 for x in raw)])
    return np.frombuffer(b"\n".join([*raw, b""]), np.uint8), starts


def window_hashes(hashes: np.ndarray, owner: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of ``size`` words of one text, and the place of its first word."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(owner[:n] == owner[size - 1 :])
    out = np.zeros(len(at), np.uint64)
    for k in range(size):
        out = mix(out * np.uint64(0x2545F4914F6CDD1D) + hashes[at + k])
    return out, at
