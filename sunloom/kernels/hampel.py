"""Readings that a power source can't have measured: NumPy kernel over one source and some weeks.

Three tests, each against the source's own behaviour:

* Hampel filter: a reading is off by its distance from a rolling median in rolling
  median absolute deviations (MADs), and every distance is measured so:
  upwards from the usual high, and downwards on the logarithm, at about the same time of
  day over the days before and the days after, where both sides must agree; and
  downwards from both neighbouring readings.  The deviation that counts is at least a
  stated part of the level, so that steady weather makes no filter of the noise;
* run lengths: equal readings in a row where the source would vary;
* physical bounds: below what the source draws at night, or beyond any power.

All statistics are over days near to a reading (``LOOKS_DAYS`` at most), so it does not
matter with which other weeks it comes, as long as those days are among them.
"""

from __future__ import annotations

import numpy as np

STEPS = np.array([5, 10, 15, 30, 60])
DAY_US = 86_400_000_000
#: Days before and after, minutes on either side that count as the same time of day; days around for the peak, a ceiling and the neighbours' usual difference.
SPAN_DAYS, SPAN_MIN, NEAR_DAYS = 6, 15, 7
#: Days that a result looks to either side: neighbours of the days around, whose own flags look at the days around them.
LOOKS_DAYS = 2 * NEAR_DAYS + 1
#: Scaled MADs that a reading must be off; a MAD in standard deviations.
MADS, SCALE = 3.0, 1.4826
#: Least deviations: upwards a part of the usual high and of the peak, downwards one on the logarithm (a tenth of the level is as many MADs away).
LEAST_UP, MARGIN, LEAST_DOWN = 1 / MADS, 0.05, np.log(10) / MADS
#: Quantile of the readings at a time of day that is the usual high.
HIGH = 0.85
#: Parts of the source's peak: least median for a test downwards, the most that a steady night shows, draw at night; least reading on the logarithm.
LIT, NIGHT, DRAW, DARK = 0.08, 0.03, 0.03, 1e-3
#: Times the peak that no source reaches; shortest run; readings elsewhere that make a value a ceiling.
BEYOND, RUN, CEILING = 8.0, 6, 3
#: Readings whose windows are in memory at once.
TOGETHER = 1 << 16


def _middle(s: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Median of each sorted row of ``s`` whose first ``n`` entries are known."""
    rows, last = np.arange(len(s)), np.maximum(n - 1, 0)
    return (s[rows, last // 2] + s[rows, (last + 1) // 2]) / 2


def _window_stats(x: np.ndarray, dark: np.ndarray) -> tuple[np.ndarray, ...]:
    """(count, median, MAD, usual high, MAD of the logarithm) of each row of ``x``; NaN counts as absent, NaN where a row is empty."""
    s = np.sort(x, axis=1)
    n = (~np.isnan(s)).sum(axis=1)
    med = _middle(s, n)
    mad = _middle(np.sort(np.abs(s - med[:, None]), axis=1), n)
    high = s[np.arange(len(s)), np.floor(HIGH * np.maximum(n - 1, 0) + 0.5).astype(int)]
    # The logarithm keeps the order, so its median is that of the median, but for even counts.
    logs = np.log(np.maximum(s, dark[:, None]))
    mad_log = _middle(np.sort(np.abs(logs - _middle(logs, n)[:, None]), axis=1), n)
    return n, med, mad, high, mad_log


def step_minutes(t: np.ndarray) -> int:
    """The usual distance of sorted times in microseconds, as the nearest step."""
    gaps = np.diff(t)
    gaps = gaps[gaps > 60_000_000]
    if len(gaps) == 0:
        return 60
    return int(STEPS[np.argmin(np.abs(np.log(STEPS * 60e6 / np.median(gaps))))])


def _cell_medians(cell: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct cells and the median of all finite readings of each."""
    ok = np.isfinite(v)
    order = np.lexsort((v[ok], cell[ok]))
    c, x = cell[ok][order], v[ok][order]
    start = np.flatnonzero(np.r_[True, c[1:] != c[:-1]]) if len(c) else np.zeros(0, int)
    n = np.diff(np.r_[start, len(c)])
    return c[start], (x[start + (n - 1) // 2] + x[start + n // 2]) / 2


def _near(day: np.ndarray, x: np.ndarray, f) -> np.ndarray:
    """``f`` of the entries of ``x`` on the days around each entry's day; day rises."""
    out = np.full(len(day), np.nan)
    days, start = np.unique(day, return_index=True)
    ends = np.r_[start[1:], len(day)]
    for k, d in enumerate(days):
        a, b = np.searchsorted(day, (d - NEAR_DAYS, d + NEAR_DAYS + 1))
        out[start[k] : ends[k]] = f(x[a:b])
    return out


def _lower_quantile(q: float):
    """The reading that a part ``q`` of the finite ones does not exceed, never between two; NaN without any."""

    def pick(x: np.ndarray) -> float:
        x = x[np.isfinite(x)]
        k = int(q * (len(x) - 1)) if len(x) else 0
        return float(np.partition(x, k)[k]) if len(x) else np.nan

    return pick


def power_flags(t: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Mask of the readings of one source that it can't have measured.

    t: microseconds in time order (equal ones allowed), v: readings without NaN.
    """
    n = len(v)
    if n == 0:
        return np.zeros(0, bool)
    day, minute = t // DAY_US, (t % DAY_US) / 60e6
    step = step_minutes(t)
    slots = 1440 // step
    d, s = (day - day[0]).astype(int), np.floor(minute / step + 0.5).astype(int) % slots
    peak = np.nan_to_num(_near(d, v, _lower_quantile(0.95)))
    peak = np.maximum(peak, np.finfo(float).tiny)
    reach = max(1, SPAN_MIN // step)
    # All readings of a slot count, by their median.
    cell, middle = _cell_medians(d * slots + s, v)
    grid = np.full((d[-1] + 1 + 2 * SPAN_DAYS, slots + 2 * reach), np.nan)
    grid[cell // slots + SPAN_DAYS, cell % slots + reach] = middle
    grid[:, :reach], grid[:, slots + reach :] = grid[:, slots : slots + reach], grid[:, reach : 2 * reach]
    views = np.lib.stride_tricks.sliding_window_view(grid, (SPAN_DAYS, 2 * reach + 1))
    # The windows of some readings at a time, so that memory doesn't grow with a dense source.
    each = [
        [_window_stats(views[d[a : a + TOGETHER] + k, s[a : a + TOGETHER]].reshape(-1, SPAN_DAYS * (2 * reach + 1)), DARK * peak[a : a + TOGETHER]) for k in (0, SPAN_DAYS + 1)]
        for a in range(0, n, TOGETHER)
    ]
    (n_b, med_b, mad_b, high_b, log_b), (n_a, med_a, mad_a, high_a, log_a) = (tuple(np.concatenate([e[side][i] for e in each]) for i in range(5)) for side in (0, 1))
    few = 2 * (2 * reach + 1)
    use_b, use_a = (n_b > few) | (n_b >= n_a), (n_a > few) | (n_a >= n_b)
    pick = lambda b, a, how: how(np.where(use_b, b, a), np.where(use_a, a, b))
    high, low = np.maximum(pick(high_b, high_a, np.fmax), 0), pick(med_b, med_a, np.fmin)
    up = np.fmax(SCALE * pick(mad_b, mad_a, np.fmin), LEAST_UP * (high + MARGIN * peak))
    above = v - high > MADS * up
    down = np.fmax(SCALE * pick(log_b, log_a, np.fmin), LEAST_DOWN)
    drop = np.log(np.maximum(low, DARK * peak)) - np.log(np.maximum(v, DARK * peak))
    off = above | (low > LIT * peak) & (drop > MADS * down)
    draw = np.nan_to_num(_near(d, v, _lower_quantile(0.02)))
    off |= ~np.isfinite(v) | (v < -DRAW * peak) & (v < 2 * draw - DRAW * peak) | (v < -LIT * peak) | (v > BEYOND * peak) & (above | np.isnan(high))
    # Next to each other, weather takes no such part of the power away and gives it back at once.
    left, right = _neighbours(t, v, off)
    both = np.fmin(left, right)
    lit = both > LIT * peak
    fall = np.where(lit, np.log(np.maximum(both, DARK * peak)) - np.log(np.maximum(v, DARK * peak)), np.nan)
    usual = _near(d, np.abs(fall), lambda x: np.nanmedian(x) if np.isfinite(x).any() else 0.0)
    off |= lit & (np.fmax(left, right) > 2 * LIT * peak) & (fall > MADS * np.fmax(SCALE * usual, LEAST_DOWN))
    return off | stuck_flags(v, peak, day)


def _neighbours(t: np.ndarray, v: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest reading within a day before and after each one, other times and readings in order only; NaN where there is none."""
    good = np.flatnonzero(~off)
    if len(good) == 0:
        return np.full(len(v), np.nan), np.full(len(v), np.nan)
    i, j = np.searchsorted(t[good], t, "left") - 1, np.searchsorted(t[good], t, "right")
    before, after = good[np.maximum(i, 0)], good[np.minimum(j, len(good) - 1)]
    left = np.where((i >= 0) & (t - t[before] <= DAY_US), v[before], np.nan)
    right = np.where((j < len(good)) & (t[after] - t <= DAY_US), v[after], np.nan)
    return left, right


def stuck_flags(v: np.ndarray, peak: np.ndarray, day: np.ndarray) -> np.ndarray:
    """Mask of runs of equal readings where the source would vary."""
    n = len(v)
    start = np.flatnonzero(np.r_[True, v[1:] != v[:-1]])
    length = np.diff(np.r_[start, n])
    out = np.zeros(n, bool)
    for a, k in zip(start[length >= RUN], length[length >= RUN]):
        if abs(v[a]) <= NIGHT * peak[a]:
            continue  # a steady night
        lo, hi = np.searchsorted(day, (day[a] - NEAR_DAYS, day[a + k - 1] + NEAR_DAYS + 1))
        if (v[lo:hi] == v[a]).sum() - k >= CEILING:
            continue  # its ceiling: reached at other times too
        out[a : a + k] = True
    return out


#: Weekly fits: weeks before and after for the median and for the MAD, scaled MADs that a fit must be off, least deviations as parts of the median (each, and as a whole).
FIT_SPAN, FIT_AROUND, FIT_MADS, FIT_LEAST, FIT_PART = 4, 26, 8.0, 0.002, 0.07


def _rolling_median(x: np.ndarray, half: int) -> np.ndarray:
    """Centred median of the known entries, NaN without any."""
    w = np.sort(np.lib.stride_tricks.sliding_window_view(np.pad(x, half, constant_values=np.nan), 2 * half + 1), axis=1)
    return _middle(w, (~np.isnan(w)).sum(axis=1))


def fit_flags(t: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Mask of the fits of one positive parameter that the source can't have had, in time order."""
    n = len(v)
    if n == 0:
        return np.zeros(0, bool)
    # A repeated row must not count as two weeks in the rolling median.
    first = np.r_[True, (t[1:] != t[:-1]) | (v[1:] != v[:-1])]
    u = np.where(np.isfinite(v), v, np.nan)[first]
    med = _rolling_median(u, FIT_SPAN)
    rest = np.abs(u - med)
    usual = np.fmax(SCALE * _rolling_median(rest, FIT_AROUND), FIT_LEAST * np.abs(med))
    off = (~np.isfinite(u)) | (u <= 0) | (rest > np.fmax(FIT_MADS * usual, FIT_PART * np.abs(med)))
    off = off[np.cumsum(first) - 1]
    start = np.flatnonzero(np.r_[True, v[1:] != v[:-1]])
    length = np.diff(np.r_[start, n])
    return off | np.repeat(length >= RUN, length)
