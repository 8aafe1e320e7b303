"""Numerics of a discrete hidden Markov model over many sequences at once.

Sequences are ordered by length, longest first, and their symbols by step: at each step the sequences still running are a
prefix and lie side by side, so a step is a few matrix operations on slices (a row for each state, a column for each sequence).
Whole sequences are used; what a pass over a long one needs is kept in blocks of steps, and the alphas before each block are
carried, so memory is bounded by the block, not by the sequence.
"""

from __future__ import annotations

import numpy as np

#: Symbols whose probabilities are worked on at once, and symbols whose alphas are kept for the way back (64 bytes each at eight
#: states); those of further blocks are computed again.
BLOCK, HELD = 100_000, 2_500_000


class Layout:
    """Symbols of ragged sequences by step: step t holds places offset[t]..offset[t + 1] for the first active[t] of ``order``."""

    def __init__(self, symbols: np.ndarray, starts: np.ndarray):
        lengths = np.diff(starts)
        self.order = np.argsort(-lengths, kind="stable")
        ordered = lengths[self.order]
        self.steps = int(ordered[0]) if len(ordered) else 0
        self.active = np.searchsorted(-ordered, -np.arange(self.steps), side="left")
        self.offset = np.concatenate(([0], np.cumsum(self.active)))
        rank = np.arange(self.offset[-1]) - np.repeat(self.offset[:-1], self.active)
        place = starts[:-1][self.order][rank]
        place += np.repeat(np.arange(self.steps), self.active)
        self.symbols = symbols[place]

    def at(self, t: int) -> np.ndarray:
        return self.symbols[self.offset[t] : self.offset[t + 1]]

    def blocks(self, size: int = BLOCK) -> list[tuple[int, int]]:
        """Ranges of steps with about ``size`` symbols each."""
        out, t = [], 0
        while t < self.steps:
            end = max(t + 1, int(np.searchsorted(self.offset, self.offset[t] + size, side="right")) - 1)
            out.append((t, end))
            t = end
        return out


def turned(start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The parameters as the recursions use them: a row for each state."""
    return start[:, None], np.ascontiguousarray(move.T), np.ascontiguousarray(emit.T)


def sweep(layout: Layout, span: tuple[int, int], before: np.ndarray | None, start: np.ndarray, back: np.ndarray, by_state: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scaled alphas and scales of a block of steps, and the last step's alphas; ``before`` are those of the step before."""
    cuts = (layout.offset[span[0] : span[1] + 1] - layout.offset[span[0]]).tolist()
    alphas = np.take(by_state, layout.symbols[layout.offset[span[0]] : layout.offset[span[1]]], axis=1)
    scales, now, one = np.empty(alphas.shape[1]), before, np.ones(len(by_state))
    for i, j in zip(cuts[:-1], cuts[1:], strict=True):
        here = alphas[:, i:j]
        here *= start if now is None else back @ now[:, : j - i]
        here /= np.matmul(one, here, out=scales[i:j])
        now = here
    return alphas, scales, now


def forward(layout: Layout, start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> np.ndarray:
    """log10 likelihood of each sequence by the scaled forward recursion. emit: symbol x state."""
    total, now, model = np.zeros(len(layout.order)), None, turned(start, move, emit)
    for span in layout.blocks():
        _, scales, now = sweep(layout, span, now, *model)
        active = layout.active[span[0] : span[1]]
        rank = np.arange(len(scales)) - np.repeat(np.cumsum(active) - active, active)
        total += np.bincount(rank, weights=np.log10(scales), minlength=len(total))
        now = now.copy()
    out = np.zeros_like(total)
    out[layout.order] = total
    return out


def expect(layout: Layout, start: np.ndarray, move: np.ndarray, emit: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Expected counts (starts, moves, emissions) by forward-backward over whole sequences, and the log10 likelihood."""
    k = len(start)
    starts, moves, emissions, total = np.zeros(k), np.zeros((k, k)), np.zeros_like(emit), 0.0
    model = turned(start, move, emit)
    spans, before, kept = layout.blocks(block), [None], {}
    for span in spans:
        alphas, scales, last = sweep(layout, span, before[-1], *model)
        before.append(last.copy())
        # The blocks nearest to the end are needed first, but any that stay save a sweep.
        if layout.offset[span[1]] <= HELD or span is spans[-1]:
            kept[span] = alphas, scales
    later = np.zeros((k, 0))  # beta times emission over scale, of the step after the block
    for span, first in zip(reversed(spans), reversed(before[:-1]), strict=True):
        alphas, scales = kept.pop(span, None) or sweep(layout, span, first, *model)[:2]
        symbols = layout.symbols[layout.offset[span[0]] : layout.offset[span[1]]]
        total += float(np.log10(scales).sum())
        ahead = np.take(model[2], symbols, axis=1)
        ahead /= scales
        betas = np.ones_like(alphas)
        active = layout.active[span[0] : span[1]]
        ends = np.cumsum(active).tolist()
        now = later
        for i, j in zip([0, *ends[:-1]][::-1], ends[::-1], strict=True):
            n = now.shape[1]
            if n:
                betas[:, i : i + n] = move @ now
            now = ahead[:, i:j]
            now *= betas[:, i:j]
        # A symbol's predecessor lies as many places before it as sequences ran at the step before.
        inner = np.arange(ends[0], alphas.shape[1])
        moves += np.take(alphas, inner - np.repeat(active[:-1], active[1:]), axis=1) @ ahead[:, ends[0] :].T
        if later.shape[1]:
            last = alphas.shape[1] - active[-1]
            moves += alphas[:, last : last + later.shape[1]] @ later.T
        alphas *= betas
        for s in range(k):
            emissions[:, s] += np.bincount(symbols, weights=alphas[s], minlength=len(emit))
        if span[0] == 0:
            starts = alphas[:, : active[0]].sum(1)
        later = now.copy()
    return starts, moves * move, emissions, total


def normalise(starts: np.ndarray, moves: np.ndarray, emissions: np.ndarray, prior: float = 0.01) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Parameters from expected counts; ``prior`` of a count for each outcome, so that nothing has probability zero."""
    a, b, c = starts + prior, moves + prior, emissions + prior
    return a / a.sum(), b / b.sum(1, keepdims=True), c / c.sum(0, keepdims=True)


def seeded(frequency: np.ndarray, states: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First parameters: symbol frequencies disturbed for each state, and states that tend to stay."""
    rng = np.random.default_rng(seed)
    emit = frequency[:, None] * rng.gamma(0.7, size=(len(frequency), states)) + 1e-9
    move = np.full((states, states), 0.1 / states) + 0.9 * np.eye(states)
    return np.full(states, 1 / states), move / move.sum(1, keepdims=True), emit / emit.sum(0)
