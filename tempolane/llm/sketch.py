"""ProbMinHash sketches of many weighted sets at once.

Each element of weight w is a Poisson process of rate w, driven by the element's hash alone. Every arrival falls into a random
register; a register keeps its earliest arrival and the element that made it. A set's registers agree with another's with the
probability Jaccard similarity of the two. An element stops as soon as its arrivals are later than the set's latest register:
no further arrival could change anything.
"""

from __future__ import annotations

import numpy as np

from tempolane.llm.words import mix

_STEP, _REGISTER = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)


def sketches(owner: np.ndarray, element: np.ndarray, weight: np.ndarray, sets: int, registers: int) -> np.ndarray:
    """sets x registers array of element hashes (0 where a set is empty). owner must be ascending."""
    earliest = np.full(sets * registers, np.inf)
    winner = np.zeros(sets * registers, np.uint64)
    at = np.flatnonzero(weight > 0)
    arrival = np.zeros(len(at))
    turn = np.uint64(0)
    with np.errstate(over="ignore"):
        while len(at):
            turn += np.uint64(1)
            seed = mix(element[at] + turn * _STEP)
            uniform = ((seed >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53
            arrival = arrival - np.log(uniform) / weight[at]
            cell = owner[at] * registers + (mix(seed ^ _REGISTER) % np.uint64(registers)).astype(np.int64)
            before = earliest[cell]
            better = np.flatnonzero(arrival < before)
            np.minimum.at(earliest, cell[better], arrival[better])
            won = better[earliest[cell[better]] == arrival[better]]
            winner[cell[won]] = element[at[won]]
            # Latest register of each set that is still at work.
            own = owner[at]
            first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
            last = earliest.reshape(sets, registers)[own[first]].max(1)
            on = arrival < np.repeat(last, np.diff(np.append(first, len(own))))
            at, arrival = at[on], arrival[on]
    return winner.reshape(sets, registers)


def bands(sketch: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key for each run of ``rows`` registers; equal runs at the same place have equal keys."""
    sets, registers = sketch.shape
    n = registers // rows
    parts = sketch[:, : n * rows].reshape(sets, n, rows)
    key = np.broadcast_to(mix(np.arange(1, n + 1, dtype=np.uint64) * _STEP), (sets, n)).copy()
    for k in range(rows):
        key = mix(key * np.uint64(0x2545F4914F6CDD1D) + parts[:, :, k])
    return key
