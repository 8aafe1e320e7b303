"""Counting quotient filter over 64-bit fingerprints, as numpy arrays.

A fingerprint splits into a quotient (its upper ``q`` bits) and a remainder (the rest). Slots hold remainders in order of
quotient; ``occupied`` marks quotients that have a run, ``run_end`` the last slot of each run, and ``is_count`` the slots that
hold a counter of the remainder before them instead of a remainder. Entries sit at their quotient's slot or, pushed on by
linear probing, after it; the table has room at its end, so nothing wraps. Quotient and remainder together keep all 64 bits:
filters of any sizes merge without loss by their sorted entries.
"""

from __future__ import annotations

import numpy as np

_HEAD = np.dtype("<i8")


def tally(fingerprints: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct fingerprints in order, with the sums of their counts."""
    counts = np.ones(len(fingerprints), np.int64) if counts is None else counts
    if not len(fingerprints):
        return fingerprints.astype(np.uint64), counts
    order = np.argsort(fingerprints, kind="stable")
    values = fingerprints[order]
    first = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))
    return values[first], np.add.reduceat(counts[order], first)


def build(fingerprints: np.ndarray, counts: np.ndarray) -> bytes:
    """Filter of distinct, ordered fingerprints and their counts; a count above one takes a counter slot."""
    n = len(fingerprints)
    q = max(6, int(np.ceil(np.log2(max(1, n) / 0.75))) + 1)
    quotient = (fingerprints >> np.uint64(64 - q)).astype(np.int64)
    many = counts > 1
    place = np.arange(n) + np.concatenate(([0], np.cumsum(many)[:-1])) if n else np.zeros(0, np.int64)
    width = 1 + many
    slot = place + (np.maximum.accumulate(quotient - place) if n else 0)
    size = max(1 << q, int(slot[-1] + width[-1]) if n else 0)
    remainders = np.zeros(size, np.uint64)
    occupied, run_end, is_count = (np.zeros(size, bool) for _ in range(3))
    remainders[slot] = fingerprints << np.uint64(q)
    remainders[slot[many] + 1] = counts[many]
    is_count[slot[many] + 1] = True
    occupied[quotient] = True
    last = np.flatnonzero(np.concatenate((quotient[1:] != quotient[:-1], [True]))) if n else np.zeros(0, np.int64)
    run_end[slot[last] + width[last] - 1] = True
    used = np.zeros(size, bool)
    used[slot] = True
    used |= is_count
    # Free slots are not stored: the kept ones and a bit vector of the used ones say the same.
    bits = [np.packbits(x).tobytes() for x in (occupied, run_end, is_count, used)]
    return np.array([q, size], _HEAD).tobytes() + b"".join(bits) + remainders[used].tobytes()


def entries(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The filter's fingerprints in order, and their counts."""
    q, size = (int(x) for x in np.frombuffer(data, _HEAD, 2))
    width, at, bits = (size + 7) // 8, 16, []
    for _ in range(4):
        bits.append(np.unpackbits(np.frombuffer(data, np.uint8, width, at), count=size).astype(bool))
        at += width
    occupied, run_end, is_count, used = bits
    slots = np.frombuffer(data, "<u8", offset=at)
    counter, ends = is_count[used], run_end[used]
    # The k-th run belongs to the k-th occupied quotient.
    run = np.cumsum(ends) - ends
    quotients = np.flatnonzero(occupied).astype(np.uint64)
    own = ~counter
    found = (quotients[run[own]] << np.uint64(64 - q)) | (slots[own] >> np.uint64(q))
    counts = np.ones(own.sum(), np.int64)
    where = np.cumsum(own) - 1
    counts[where[counter]] = slots[counter].astype(np.int64)
    return found, counts


def merge_entries(one: tuple[np.ndarray, np.ndarray], two: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The ordered entries of both, equal ones added: each entry of ``two`` finds its place in the order of ``one``."""
    (a, n), (b, m) = one, two
    at = np.searchsorted(a, b)
    same = np.zeros(len(b), bool)
    inside = at < len(a)
    same[inside] = a[at[inside]] == b[inside]
    n = n.copy()
    n[at[same]] += m[same]
    return np.insert(a, at[~same], b[~same]), np.insert(n, at[~same], m[~same])


def merge(filters: list[bytes]) -> bytes:
    """One filter with the sums of all counts: the sorted remainders of the filters are merged, two runs at a time."""
    runs = [entries(x) for x in filters] or [(np.zeros(0, np.uint64), np.zeros(0, np.int64))]
    while len(runs) > 1:  # neighbours first, so that each entry moves as often as the number of filters doubles
        runs = [merge_entries(*runs[k : k + 2]) if k + 1 < len(runs) else runs[k] for k in range(0, len(runs), 2)]
    return build(*runs[0])
