"""Ranks of a cross-section in NumPy, for kernels that rank many columns of one date."""

from __future__ import annotations

import numpy as np


def share_ranks(x: np.ndarray) -> np.ndarray:
    """Average ranks over each column's values by their number, nan where there is none.

    Values that agree in 40 of their 53 bits tie: equal sums, whatever order they were added in.
    """
    x = x * 8193.0 - (x * 8193.0 - x)
    order = np.argsort(x, axis=0, kind="stable")  # nan last
    s = np.take_along_axis(x, order, axis=0)
    n = len(x)
    place = np.broadcast_to(np.arange(n)[:, None], s.shape)
    starts = np.ones(s.shape, bool)
    starts[1:] = s[1:] != s[:-1]
    first = np.maximum.accumulate(np.where(starts, place, 0), axis=0)
    ends = np.ones(s.shape, bool)
    ends[:-1] = starts[1:]
    last = np.minimum.accumulate(np.where(ends, place, n)[::-1], axis=0)[::-1]
    out = np.empty(x.shape)
    np.put_along_axis(out, order, (first + last) / 2 + 1, axis=0)
    return np.where(np.isnan(x), np.nan, out / np.maximum((~np.isnan(x)).sum(axis=0), 1))
