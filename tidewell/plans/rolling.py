"""Statistics over frames of consecutive values in one task.

A frame is answered by merging two runs that meet inside it. Counts, means and squared distances are
merged, never subtracted, so that a value leaves no trace in a frame that does not hold it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pandas.api.indexers import BaseIndexer


@dataclass
class Summary:
    """Finite values of frames: number, mean, squared distance from it, extremes; and numbers of infinite ones."""

    n: np.ndarray
    mean: np.ndarray
    m2: np.ndarray
    low: np.ndarray
    high: np.ndarray
    plus: np.ndarray
    minus: np.ndarray


def moments(n: np.ndarray, reference: np.ndarray, s1: np.ndarray, s2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and squared distance from sums of differences to a reference inside the frame."""
    share = s1 / n
    return reference + share, np.maximum(s2 - s1 * share, 0.0)


def summarise(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> Summary:
    """The frames ``values[first..last]``; NaN is missing.

    A frame of two finite values or more is parted at the multiple of the largest power of two inside it.
    Frames parted at one place share the running sums from there to both sides, taken from the value at that
    place, which lies in all of them.
    """
    finite = np.isfinite(values)
    before = np.concatenate([[0], np.cumsum(finite)])
    infinite = [np.concatenate([[0], np.cumsum(values == x)]) for x in (np.inf, -np.inf)]
    plus, minus = (c[last + 1] - c[first] for c in infinite)
    x = values[finite]
    lo, hi = before[first], before[last + 1] - 1
    n = hi - lo + 1
    out = Summary(n, *(np.full(len(n), np.nan) for _ in range(4)), plus, minus)
    single = np.flatnonzero(n == 1)
    out.mean[single] = out.low[single] = out.high[single] = x[lo[single]]
    out.m2[single] = 0.0
    many = np.flatnonzero(n > 1)
    if not len(many):
        return out
    level = np.frexp((lo[many] ^ hi[many]).astype(float))[1] - 1
    order = np.argsort(level, kind="stable")
    borders = np.flatnonzero(np.diff(level[order])) + 1
    for frames in np.split(order, borders):
        at, size = many[frames], 1 << int(level[frames[0]])
        middle = hi[at] // size * size
        places, which = np.unique(middle, return_inverse=True)
        left, right = middle - lo[at], hi[at] - middle + 1
        sides = []
        for reach, step, start in ((left, -1, places - 1), (right, 1, places)):
            index = start[:, None] + step * np.arange(int(reach.max()))[None]
            held = x[np.clip(index, 0, len(x) - 1)]
            away = held - x[places][:, None]
            sides.append((which, reach - 1, held, away))
        with np.errstate(over="ignore", invalid="ignore"):
            s1, s2 = (
                sum(np.cumsum(away**power, axis=1)[row, end] for row, end, _, away in sides) for power in (1, 2)
            )
            out.mean[at], out.m2[at] = moments(n[at], x[middle], s1, s2)
        lows, highs = (
            [pick.accumulate(held, axis=1)[row, end] for row, end, held, _ in sides] for pick in (np.minimum, np.maximum)
        )
        out.low[at], out.high[at] = np.minimum(*lows), np.maximum(*highs)
    return out


def result(kind: str, s: Summary) -> np.ndarray:
    """A statistic of frames, NaN where it is not defined."""
    plus, minus = s.plus > 0, s.minus > 0
    if kind == "mean":
        return np.where(plus & minus, np.nan, np.where(plus, np.inf, np.where(minus, -np.inf, s.mean)))
    if kind == "std":
        with np.errstate(invalid="ignore", divide="ignore"):
            return np.where(plus | minus | (s.n < 2), np.nan, np.sqrt(s.m2 / (s.n - 1)))
    if kind == "min":
        return np.where(minus, -np.inf, np.where((s.n == 0) & plus, np.inf, s.low))
    return np.where(plus, np.inf, np.where((s.n == 0) & minus, -np.inf, s.high))


class _Frames(BaseIndexer):
    def get_window_bounds(self, num_values=0, min_periods=None, center=None, closed=None, step=None):
        return self.starts, self.ends


def medians(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Medians of frames whose ends never go back, by the ranks of the values: ranks are finite."""
    known = np.unique(values[~np.isnan(values)])
    if not len(known) or not len(first):
        return np.full(len(first), np.nan)
    ranks = pd.Series(np.where(np.isnan(values), np.nan, np.searchsorted(known, values).astype(float)))
    starts, ends = np.zeros(len(values), np.int64), np.zeros(len(values), np.int64)
    out = np.empty(len(first))
    # pandas takes as many frames as there are values.
    for at in range(0, len(first), len(values)):
        part = slice(at, at + len(values))
        count = len(first[part])
        starts[:count], ends[:count] = first[part], last[part] + 1
        starts[count:], ends[count:] = starts[count - 1], ends[count - 1]
        rolled = ranks.rolling(_Frames(starts=starts, ends=ends), min_periods=1)
        one, two = (rolled.quantile(0.5, interpolation=side).to_numpy()[:count] for side in ("lower", "higher"))
        low, high = (known[np.nan_to_num(m).astype(int)] for m in (one, two))
        with np.errstate(invalid="ignore", over="ignore"):
            middle = np.where(np.isinf(low + high), low / 2 + high / 2, (low + high) / 2)
            out[part] = np.where(np.isnan(one), np.nan, np.where(low == high, low, middle))
    return out


def statistics(values: np.ndarray, first: np.ndarray, last: np.ndarray, kinds: set[str]) -> dict[str, np.ndarray]:
    """Statistics over ``values[first..last]``, whose ends never go back; NaN where there is none."""
    out = {"median": medians(values, first, last)} if "median" in kinds else {}
    if kinds - {"median"}:
        summary = summarise(values, first, last)
        out.update((kind, result(kind, summary)) for kind in kinds - {"median"})
    return out


def time_bounds(ticks: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last position of each row's frame ``(tick - width, tick]`` in sorted ticks."""
    return np.searchsorted(ticks, ticks - width, side="right"), np.searchsorted(ticks, ticks, side="right") - 1
