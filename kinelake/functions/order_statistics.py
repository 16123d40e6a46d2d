"""Extremes, ranks and medians of all frames of a series at once, at a cost that doesn't depend on their width."""

from __future__ import annotations

import numpy as np


def sliding_extreme(values: np.ndarray, width: int, op: np.ufunc) -> np.ndarray:
    """``op`` (np.fmin or np.fmax) over each ``width`` neighbours; NaN are gaps.

    The series is cut into pieces of the width. A frame lies in two pieces at
    most: it is the tail of one and the head of the next, whose running
    extremes from either end are made once.
    """
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0)
    pieces = np.concatenate([values, np.full(-len(values) % width, np.nan)]).reshape(-1, width)
    heads, tails = op.accumulate(pieces, axis=1).ravel(), op.accumulate(pieces[:, ::-1], axis=1)[:, ::-1].ravel()
    return op(tails[:n], heads[width - 1 : width - 1 + n])


class WaveletMatrix:
    """Values in order of their bits, from the highest: how many of any run are smaller than a value, or which is its k-th.

    A value is its place among the distinct ones. For each bit the places are
    dealt stably to zeros and ones; the running number of zeros says where a
    run goes, so a question is one step a bit, for all runs at once.
    """

    def __init__(self, values: np.ndarray):
        self.distinct, codes = np.unique(values, return_inverse=True)
        self.bits = max(int(len(self.distinct) - 1).bit_length(), 1)
        self.zeros = []
        for bit in reversed(range(self.bits)):
            one = (codes >> bit) & 1 == 1
            self.zeros.append(np.concatenate([[0], np.cumsum(~one)]))
            codes = np.concatenate([codes[~one], codes[one]])

    def below(self, lo: np.ndarray, hi: np.ndarray, code: np.ndarray) -> np.ndarray:
        """How many of the values lo..hi (its end excluded) have a place under ``code``, up to the number of places."""
        out, every = np.zeros(len(lo), np.int64), hi - lo
        for bit, zeros in zip(reversed(range(self.bits)), self.zeros):
            a, b, one = zeros[lo], zeros[hi], (code >> bit) & 1 == 1
            out += np.where(one, b - a, 0)
            lo, hi = np.where(one, zeros[-1] + lo - a, a), np.where(one, zeros[-1] + hi - b, b)
        return np.where(code >> self.bits > 0, every, out)

    def kth(self, lo: np.ndarray, hi: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The k-th smallest (from 0) of the values lo..hi; each run must have more than k."""
        code = np.zeros(len(lo), np.int64)
        for bit, zeros in zip(reversed(range(self.bits)), self.zeros):
            a, b = zeros[lo], zeros[hi]
            one = k >= b - a
            k, code = np.where(one, k - (b - a), k), code | (one.astype(np.int64) << bit)
            lo, hi = np.where(one, zeros[-1] + lo - a, a), np.where(one, zeros[-1] + hi - b, b)
        return self.distinct[code]


def sliding_ranks(values: np.ndarray, width: int, back: int, median: bool) -> np.ndarray:
    """The median of each frame's values, or the average rank of a frame's own row (``back`` rows after its start) as a share of their count.

    ``values`` has the padding of the first and last frames; NaN are gaps.
    """
    n = len(values) - width + 1
    known = ~np.isnan(values)
    seen = np.concatenate([[0], np.cumsum(known)])
    lo, hi, out = seen[:n], seen[width:], np.full(n, np.nan)
    ask = hi > lo if median else known[back : back + n]
    if not ask.any():
        return out
    tree, lo, hi = WaveletMatrix(values[known]), lo[ask], hi[ask]
    count = hi - lo
    if median:
        low = tree.kth(lo, hi, (count - 1) // 2)
        out[ask] = low + (tree.kth(lo, hi, count // 2) - low) / 2
    else:
        own = np.searchsorted(tree.distinct, values[back : back + n][ask])
        under = tree.below(lo, hi, own)
        out[ask] = (under + (tree.below(lo, hi, own + 1) - under + 1) / 2) / count
    return out
