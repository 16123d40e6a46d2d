"""Sliding extremes, medians and ranks against every frame on its own."""

import numpy as np
import pytest

from kinelake.functions.order_statistics import WaveletMatrix, sliding_extreme, sliding_ranks


def series(seed, n, gaps=0.2, distinct=None):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=n) if distinct is None else rng.integers(0, distinct, n).astype(float)
    x[rng.random(n) < gaps] = np.nan
    return x


@pytest.mark.parametrize("width", [1, 2, 5, 30, 200])
@pytest.mark.parametrize("distinct", [None, 1, 3])
def test_all_frames(width, distinct):
    for n in (width - 1, width, 137, 400):
        x = series(n, n, distinct=distinct)
        frames = np.lib.stride_tricks.sliding_window_view(x, width) if n >= width else np.zeros((0, width))
        known = [f[~np.isnan(f)] for f in frames]
        back = width // 3
        np.testing.assert_array_equal(sliding_extreme(x, width, np.fmax), [f.max() if len(f) else np.nan for f in known])
        np.testing.assert_array_equal(sliding_extreme(x, width, np.fmin), [f.min() if len(f) else np.nan for f in known])
        if n >= width:
            np.testing.assert_allclose(sliding_ranks(x, width, back, True), [np.median(f) if len(f) else np.nan for f in known])
            rank = [np.nan if np.isnan(w[back]) else ((f < w[back]).sum() + ((f == w[back]).sum() + 1) / 2) / len(f) for w, f in zip(frames, known)]
            np.testing.assert_allclose(sliding_ranks(x, width, back, False), rank)


def test_runs_of_any_kind():
    x = series(3, 500, 0.0, 40)
    tree, rng = WaveletMatrix(x), np.random.default_rng(1)
    lo = rng.integers(0, 500, 300)
    hi = np.minimum(lo + 1 + rng.integers(0, 90, 300), 500)
    k, code = rng.integers(0, hi - lo), rng.integers(0, len(tree.distinct) + 1, 300)
    assert tree.kth(lo, hi, k).tolist() == [sorted(x[a:b])[i] for a, b, i in zip(lo, hi, k)]
    places = np.searchsorted(tree.distinct, x)
    assert tree.below(lo, hi, code).tolist() == [int((places[a:b] < c).sum()) for a, b, c in zip(lo, hi, code)]
