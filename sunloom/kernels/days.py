"""One system's readings as a matrix of days by slots of the day, NaN where nothing was read: daytime, filling, daily statistics.

A regular series has at most 288 slots a day, however dense the readings were, so a
system's matrix grows with its years only.
"""

from __future__ import annotations

import numpy as np

from sunloom.kernels import detect


def matrix(days: np.ndarray, slots: list[np.ndarray], values: list[np.ndarray], m: int) -> tuple[np.ndarray, np.ndarray]:
    """(days, matrix): all days from the first to the last with a value; ``days`` are whole numbers."""
    kept = [i for i, v in enumerate(values) if np.isfinite(np.asarray(v, float)).any()]
    if not kept:
        return np.zeros(0, int), np.zeros((0, m))
    first, last = int(days[kept].min()), int(days[kept].max())
    out = np.full((last - first + 1, m), np.nan)
    for i in kept:
        out[int(days[i]) - first, np.asarray(slots[i], int)] = values[i]
    return np.arange(first, last + 1), out


def average_day_shift(x: np.ndarray) -> int:
    """Whole hours that move the middle of the average day's bright half to noon; 0 within four hours."""
    with np.errstate(all="ignore"):
        mean = np.nanmean(x, axis=0) if len(x) else np.zeros(0)
        scaled = (mean - np.nanmin(mean)) / (np.nanmax(mean) - np.nanmin(mean)) if np.isfinite(mean).any() else mean
        bright = np.flatnonzero(scaled > 0.5)
    if len(bright) == 0:
        return 0
    off = 12 - bright.mean() * 24 / x.shape[1]
    return int(np.rint(off)) if abs(off) > 4 else 0


def moved(x: np.ndarray, slots: int) -> np.ndarray:
    """The series moved by so many slots, over the days' borders; what comes in from outside is NaN."""
    if slots == 0:
        return x
    flat = np.full(x.size, np.nan)
    if slots > 0:
        flat[slots:] = x.ravel()[:-slots]
    else:
        flat[:slots] = x.ravel()[-slots:]
    return flat.reshape(x.shape)


def rolled(x: np.ndarray, roll: np.ndarray) -> np.ndarray:
    """Each day rolled by its slots around its own border."""
    m = x.shape[1]
    return np.take_along_axis(x, (np.arange(m)[None, :] - np.asarray(roll, int)[:, None]) % m, axis=1)


def rough_sun_times(x: np.ndarray, thresholds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hours of the first and last slot above each threshold (rows) of each day, NaN where there is none or it is the day's border."""
    n, m = x.shape
    known = x[np.isfinite(x)]
    rises, falls = np.full((len(thresholds), n), np.nan), np.full((len(thresholds), n), np.nan)
    if len(known) == 0 or (top := np.quantile(known, 0.99)) == 0:
        return rises, falls
    scaled = np.nan_to_num((x - max(known.min(), -0.005 * top)) / top, nan=-np.inf)
    for k, t in enumerate(thresholds):
        lit = scaled > t
        any_lit, first, last = lit.any(axis=1), lit.argmax(axis=1), m - 1 - lit[:, ::-1].argmax(axis=1)
        rises[k] = np.where(any_lit & (first > 0), first * 24 / m, np.nan)
        falls[k] = np.where(any_lit & (last < m - 1), last * 24 / m, np.nan)
    return rises, falls


def daytime(n: int, m: int, sunrise: np.ndarray, sunset: np.ndarray) -> np.ndarray:
    """Slots between sunrise and sunset; all of a day without them."""
    hour = np.arange(m)[None, :] * 24 / m
    unknown = ~(np.isfinite(sunrise) & np.isfinite(sunset))[:, None]
    with np.errstate(invalid="ignore"):
        return ((hour >= sunrise[:, None]) & (hour < sunset[:, None])) | unknown


def filled(x: np.ndarray, lit: np.ndarray) -> np.ndarray:
    """Negative values and missing ones at night as 0, gaps by day linear, the end of a day by its last value, its start 0."""
    out = np.where(x < 0, 0.0, np.where(~lit & np.isnan(x), 0.0, x))
    at = np.arange(x.shape[1])
    for i in np.flatnonzero(np.isnan(out).any(axis=1)):
        ok = np.isfinite(out[i])
        out[i] = np.interp(at, at[ok], out[i][ok], left=0.0) if ok.any() else 0.0
    return out


def statistics(x: np.ndarray, full: np.ndarray) -> dict[str, np.ndarray]:
    """Daily density, energy, bends, linearity, top, stat1 and stat2, and the system's capacity, of the matrix as read and filled."""
    n, m = x.shape
    known = x[np.isfinite(x)]
    capacity = float(np.quantile(known, 0.95)) if len(known) else 0.0
    top = full.max(axis=1)
    lit = np.where(full >= 0.005 * capacity, full, np.nan)
    steps = np.round(np.diff(lit, axis=1), 4)
    most = np.zeros(n)
    for i in range(n):
        s = steps[i][np.isfinite(steps[i])]
        most[i] = np.unique(s, return_counts=True)[1].max() if len(s) else 0
    energy = full.sum(axis=1)
    with np.errstate(all="ignore"):
        return {
            "density": (np.nan_to_num(x) > 0.02 * capacity).mean(axis=1),
            "energy": energy * 24 / m,
            "bends": np.abs(np.diff(full, 2, axis=1)).sum(axis=1),
            "linearity": most / (m - 1),
            "top": top,
            "stat1": np.nan_to_num(top / top.max()) if n else top,
            "stat2": np.nan_to_num(np.where(full > 0.995 * top[:, None], full, 0).sum(axis=1) / energy),
            "capacity": np.full(n, capacity),
        }


def sun_fits(x: np.ndarray, threshold: float | None = None):
    """Smooth sunrise and sunset of all days, and the noons, by the best threshold, or by a given one, as a generator that yields its fits."""
    if threshold is None:
        return (yield from detect.sun_times_fits(*rough_sun_times(x, detect.SUN_THRESHOLDS)))
    rise, fall = rough_sun_times(x, np.array([threshold]))
    up, down = yield from detect.smooth_times_fits(rise[0], fall[0])
    return {"threshold": threshold, "sunrise": up, "sunset": down, "noon": (rise[0] + fall[0]) / 2}
