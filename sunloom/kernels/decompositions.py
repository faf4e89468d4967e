"""Signal decompositions of daily series, in NumPy.

Each function takes a signal of one system (NaN or a mask tells unknown days) and
returns its components.  Seasons are Fourier sums of the year's first harmonics.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from sunloom.kernels import many
from sunloom.kernels.admm import Term, at_most, dense_term, difference_gram, difference_term, norm2, pinball, smooth_pinball, soft, solve, within

YEAR = 365.2425
#: Bends of a signal that linear pieces start from at most.
FEW_BENDS = 200
#: Days times days of a year times problems of a call of the soiling fit, gap at its end as a part of the spread, days of a block.
SOILING_CELLS, SOILING_TOLERANCE, BAND_BLOCK = 1_000_000, 1e-6, 32
#: Fits of a call of the loss factors times their teeth, or days squared; pairs of days times teeth of a table; steps at most.
LOSS_CELLS, LOSS_PAIRS, LOSS_STEPS = 60_000, 4_000_000, 60


def fourier(n: int, harmonics: int, period: float = YEAR, constant: bool = True) -> np.ndarray:
    """Columns 1, cos, sin, cos, sin, ... of the harmonics 1, 2, ..."""
    t = np.arange(n)[:, None] * 2 * np.pi / period * np.arange(1, harmonics + 1)[None, :]
    waves = np.stack([np.cos(t), np.sin(t)], axis=2).reshape(n, 2 * harmonics)
    return np.hstack([np.ones((n, 1)), waves]) if constant else waves


def fourier_weights(harmonics: int, weight: float, period: float = YEAR, constant: bool = True) -> np.ndarray:
    """Roughness of each column: weight times frequency, per root of the period; 0 for the constant."""
    w = np.repeat(np.arange(1, harmonics + 1), 2) * weight * 2 * np.pi / np.sqrt(period)
    return np.r_[0.0, w] if constant else w


def known(signal: np.ndarray, use: np.ndarray | None) -> np.ndarray:
    ok = np.isfinite(signal)
    return ok if use is None else ok & np.asarray(use, bool)


def smooth_quantile(signal: np.ndarray, tau: float = 0.75, weight: float = 1.0, use: np.ndarray | None = None, harmonics: int = 3) -> np.ndarray:
    """A smooth yearly quantile: weight * pinball of the residual + 1/2 |roughness|^2."""
    return quantiles([([(signal, tau, use)], weight, harmonics)])[0][0]


def quantiles(asked: list[tuple]) -> list[list[np.ndarray]]:
    """``smooth_quantile`` of each (signal, tau, use) of each (list of these, weight, harmonics), all together; equal ones are fitted once."""
    todo: dict[tuple, list[tuple[int, int]]] = {}
    out: list[list] = [[None] * len(fits) for fits, *_ in asked]
    of: dict[int, list[tuple]] = {}
    for i, (fits, weight, harmonics) in enumerate(asked):
        for j, (signal, tau, use) in enumerate(fits):
            ok = known(signal, use)
            if not ok.any():
                out[i][j] = np.full(len(signal), np.nan)
                continue
            key = (np.where(ok, signal, 0.0).tobytes(), ok.tobytes(), tau, weight)
            if (harmonics, key) not in todo:
                of.setdefault(harmonics, []).append((key, signal, ok, tau, weight))
            todo.setdefault((harmonics, key), []).append((i, j))
    for harmonics, fits in of.items():
        penalty = fourier_weights(harmonics, 1e-3) ** 2 + 1e-12
        for at in many.chunks([len(f[1]) for f in fits]):
            some = [fits[k] for k in at]
            tau, weight = (np.array([f[c] for f in some], float) for c in (3, 4))
            y, ok = many.columns([f[1] for f in some]), many.columns([f[2] for f in some], False)
            wide = fourier(len(y), harmonics)
            fit = wide @ many.solve(y, ok, wide, np.tile(penalty, (len(some), 1)), low=weight * (tau - 1), high=weight * tau)[1].T
            for k, f in enumerate(some):
                for i, j in todo[harmonics, f[0]]:
                    out[i][j] = fit[: len(f[1]), k]
    return out


def steps_and_season(signal: np.ndarray, step_weight: float = 1.0, season_weight: float = 1e-3, use: np.ndarray | None = None, transitions: list[int] | None = None, periodic: bool = False, harmonics: int = 3, passes: int = 1, factors: dict[float, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(piecewise constant, season): |r|^2 + w1 |differences|_1 + 1/2 |roughness|^2; the season has no constant.

    ``factors`` is for calls that differ in the step weight only.  With several ``passes`` each difference is weighted by 1 / (0.1 + its size in the pass before).

    With ``transitions`` the pieces are given and the weight is 0; ``periodic`` makes the
    piecewise constant part repeat after 365 days.
    """
    n, ok = len(signal), known(signal, use)
    b = fourier(n, harmonics, constant=False)
    w = fourier_weights(harmonics, season_weight, constant=False)
    k = b.shape[1]
    y = np.where(ok, signal, 0.0)
    if transitions is not None:
        piece = np.zeros(n, int)
        piece[np.asarray(sorted(transitions), int)] = 1
        e = np.eye(len(transitions) + 1)[np.cumsum(piece)]
        a = np.hstack([e, b])[ok]
        h = 2 * a.T @ a + np.diag(np.r_[np.full(e.shape[1], 1e-10), w**2])
        x = np.linalg.solve(h, 2 * a.T @ signal[ok])
        return e @ x[: e.shape[1]], b @ x[e.shape[1] :]
    if not periodic:
        return many.alone(steps_and_season_fits(signal, step_weight, season_weight, use, harmonics, passes))
    m = min(n, 365)
    fold = np.arange(n) % m
    h = np.zeros((m + k, m + k))
    q = np.zeros(m + k)
    np.add.at(h, (fold, fold), 2.0 * ok)
    cross = np.zeros((m, k))
    np.add.at(cross, fold, 2 * ok[:, None] * b)
    h[:m, m:], h[m:, :m] = cross, cross.T
    h[m:, m:] = 2 * (b * ok[:, None]).T @ b + np.diag(w**2)
    np.add.at(q, fold, -2 * y * ok)
    q[m:] = -2 * b.T @ (y * ok)
    # Each difference occurs once a year; the one across the year's end too.
    times = np.bincount(fold[1:], minlength=m)[np.r_[1:m, 0]].astype(float)
    d = np.roll(np.eye(m), 1, axis=1) - np.eye(m)
    d = np.hstack([d * times[:, None], np.zeros((m, k))])
    x, weight = None, step_weight
    for _ in range(passes):
        term = dense_term(d, soft(weight))
        x = solve(h, q, [term], rho=10.0, iterations=3000, tolerance=1e-7, x0=x, factors=factors)
        weight = step_weight / (0.1 + np.abs(term.apply(x)))
    return x[:m][fold], b @ x[m:]


def steps_and_season_fits(signal: np.ndarray, step_weight: float, season_weight: float = 1e-3, use: np.ndarray | None = None, harmonics: int = 3, passes: int = 1):
    """``steps_and_season`` of pieces that are sought, as a generator that yields its fits."""
    n, ok = len(signal), known(signal, use)
    penalty = fourier_weights(harmonics, season_weight, constant=False) ** 2
    weight = np.full(n - 1, float(step_weight))
    for _ in range(passes):
        s, z = yield squared_steps, (signal, ok, harmonics, penalty, weight)
        weight = step_weight / (0.1 + np.abs(np.diff(s)))
    return s, fourier(n, harmonics, constant=False) @ z


def squared_steps(asked: list[tuple]) -> list[tuple[np.ndarray, np.ndarray]]:
    return _steps(asked, False)


def absolute_steps(asked: list[tuple]) -> list[tuple[np.ndarray, np.ndarray]]:
    return _steps(asked, True)


def _steps(asked: list[tuple], absolute: bool) -> list[tuple[np.ndarray, np.ndarray]]:
    """Minimisers (s, z) of |y - s - Wz|^2, or of |y - s - Wz|_1, + |weights * differences of s|_1 + 1/2 z'diag(p)z.

    Each (signal, ok, harmonics, p, weights); W are the season's waves and, where p has one entry more, the years.
    """
    out: list = [None] * len(asked)
    for kind in {(a[2], len(a[3])) for a in asked}:
        mine = [i for i, a in enumerate(asked) if (a[2], len(a[3])) == kind]
        for at in many.chunks([len(asked[i][0]) for i in mine]):
            some = [asked[mine[k]] for k in at]
            y, ok, tv = many.columns([a[0] for a in some]), many.columns([a[1] for a in some], False), many.columns([a[4] for a in some])
            wide = fourier(len(y), kind[0], constant=False)
            if kind[1] > wide.shape[1]:
                wide = np.hstack([wide, np.arange(len(y))[:, None] / 365])
            ones = np.ones(len(some))
            s, z = many.solve(y, ok, wide, np.array([a[3] for a in some]), tv, -ones if absolute else None, ones if absolute else None)
            for k, i in enumerate(at):
                out[mine[i]] = (s[: len(asked[mine[i]][0]), k], z[k])
    return out


def steps_season_trend(signal: np.ndarray, step_weight: float = 20.0, season_weight: float = 1.0, trend_weight: float = 10.0, use: np.ndarray | None = None, passes: int = 2, harmonics: int = 6) -> dict[str, np.ndarray]:
    """Mean |residual| + w2 mean |tv o differences| + |season roughness|^2 + w4 T slope^2, one pass of reweighting.

    The slope lies between -20 % and +5 % a year; the trend starts at 0.  The minimiser of
    the first pass need not be unique.
    """
    return many.alone(steps_season_trend_fits(signal, step_weight, season_weight, trend_weight, use, passes, harmonics))


def steps_season_trend_fits(signal: np.ndarray, step_weight: float = 20.0, season_weight: float = 1.0, trend_weight: float = 10.0, use: np.ndarray | None = None, passes: int = 2, harmonics: int = 6):
    """``steps_season_trend`` as a generator that yields its fits."""
    n, ok = len(signal), known(signal, use)
    b = fourier(n, harmonics, constant=False)
    years = np.arange(n, dtype=float) / 365
    scale = float(max(ok.sum(), 1))
    # All terms times the number of days.
    p = 2 * scale * np.r_[fourier_weights(harmonics, season_weight, constant=False) ** 2, trend_weight * n / 365**2]
    tv = np.ones(n - 1)
    for _ in range(passes):
        weights = scale * step_weight * tv / max(n - 1, 1)
        s, z = yield absolute_steps, (signal, ok, harmonics, p, weights)
        bound = float(np.clip(z[-1], -0.2, 0.05))
        if bound != z[-1]:
            # Outside its bounds the slope stays at the bound, and the rest is solved again.
            s, z = yield absolute_steps, (signal - bound * years, ok, harmonics, p[:-1], weights)
            z = np.r_[z, bound]
        tv = 1 / (0.1 + np.abs(np.diff(s)))
    return {"steps": s, "season": b @ z[:-1], "trend": years * z[-1]}


def _pentadiagonal(d0: np.ndarray, d1: np.ndarray, d2: np.ndarray, rhs: np.ndarray) -> np.ndarray:
    """Solution of a symmetric positive definite system of five bands, by LDL'."""
    n = len(d0)
    a, b1, b2, r = d0.tolist(), [0.0] * n, [0.0] * n, rhs.tolist()
    e1, e2 = d1.tolist(), d2.tolist()
    for i in range(n):
        if i + 1 < n:
            f = e1[i] / a[i]
            b1[i] = f
            a[i + 1] -= f * e1[i]
            r[i + 1] -= f * r[i]
            if i + 2 < n:
                e1[i + 1] -= f * e2[i]
        if i + 2 < n:
            g = e2[i] / a[i]
            b2[i] = g
            a[i + 2] -= g * e2[i]
            r[i + 2] -= g * r[i]
    x = [0.0] * n
    for i in range(n - 1, -1, -1):
        s = r[i] / a[i]
        if i + 1 < n:
            s -= b1[i] * x[i + 1]
        if i + 2 < n:
            s -= b2[i] * x[i + 2]
        x[i] = s
    return np.array(x)


def _knot_heights(at: list[int], sign: list[float], sums: list[float], moments: list[float], ends: tuple[float, float], n: int, weight: float) -> tuple[list[float], list[float]]:
    """Heights of the knots 0, ``at``, n - 1 of the least squares pieces for bends at ``at`` whose signs are given, and the bends; few numbers, so plain ones."""
    t = [0, *at, n - 1]
    w = [b - a for a, b in zip(t, t[1:])]
    # Sums over the points after each knot up to the next one, of y and of y times the part of the way.
    whole = [sums[b] - sums[a] for a, b in zip(t, t[1:])]
    rise = [(moments[b] - moments[a] - a * x) / d for a, b, x, d in zip(t, t[1:], whole, w)]
    # Sums of products of the hats' sides over the same points.
    product = [(d * d - 1) / (6 * d) for d in w]
    k = len(at)
    main = [(w[i] + 1) * (2 * w[i] + 1) / (6 * w[i]) + (w[i + 1] - 1) * (2 * w[i + 1] - 1) / (6 * w[i + 1]) for i in range(k)]
    right = [rise[i] + whole[i + 1] - rise[i + 1] + weight / 2 * sign[i] * (1 / w[i] + 1 / w[i + 1]) for i in range(k)]
    for i in range(k - 1):
        right[i] -= weight / 2 * sign[i + 1] / w[i + 1]
        right[i + 1] -= weight / 2 * sign[i] / w[i + 1]
    right[0] -= product[0] * ends[0]
    right[-1] -= product[-1] * ends[1]
    for i in range(1, k):
        f = product[i] / main[i - 1]
        main[i] -= f * product[i]
        right[i] -= f * right[i - 1]
    h = [0.0] * k
    h[-1] = right[-1] / main[-1]
    for i in range(k - 2, -1, -1):
        h[i] = (right[i] - product[i + 1] * h[i + 1]) / main[i]
    h = [ends[0], *h, ends[1]]
    slope = [(b - a) / d for a, b, d in zip(h, h[1:], w)]
    return h, [b - a for a, b in zip(slope, slope[1:])]


def _pieces_between(y: np.ndarray, weight: float) -> np.ndarray:
    """``linear_pieces`` with both ends given: pieces between a working set of bends, joined by those at which the dual is beyond its bound."""
    n = len(y)
    grid, ends = np.arange(n), (float(y[0]), float(y[-1]))
    sums, moments = np.cumsum(y).tolist(), np.cumsum(grid * y).tolist()
    # From the signal's own bends, if they are few.
    own = np.diff(y, 2)
    size = np.abs(own)
    first = 1 + np.flatnonzero((size > 1e-9) & (size >= np.concatenate([[0.0], size[:-1]])) & (size > np.concatenate([size[1:], [0.0]])))
    at = first.tolist() if len(first) <= FEW_BENDS else []
    bend = own[np.array(at, int) - 1].tolist()
    sign = [1.0 if x > 0 else -1.0 for x in bend]
    few, new = False, list(at)
    for _ in range(2000):
        h = list(ends)
        while at:
            h, goal = _knot_heights(at, sign, sums, moments, ends, n, weight)
            # As far towards the solution as no bend changes its sign; those that reach 0 leave.
            part = [abs(x) / (abs(x) + abs(g) + 1e-300) if g * s < 0 else 2.0 for x, g, s in zip(bend, goal, sign)]
            step = min(part)
            if step == 2.0:
                bend = goal
                break
            kept = [(a, s, x + step * (g - x)) for a, s, x, g, p in zip(at, sign, bend, goal, part) if p > step]
            at, sign, bend = ([c[i] for c in kept] for i in range(3))
            h = list(ends)
        few = few or len(new) > 0 and not set(new) & set(at)
        x = np.interp(grid, [0, *at, n - 1], h)
        v = np.zeros(n)
        v[2:] = 2 * np.cumsum(np.cumsum((y - x)[1:-1]))
        v -= grid * (v[-1] / (n - 1))
        size = np.abs(v)
        size[at] = 0.0
        size[size <= weight * (1 + 1e-7) + 1e-12] = 0.0
        if not size.any():
            break
        # The largest of each run beyond the bound; one at a time, once all that came left again.
        new = [int(size.argmax())] if few else (1 + np.flatnonzero((size[1:-1] >= size[:-2]) & (size[1:-1] > size[2:]))).tolist()
        both = sorted([*zip(at, sign, bend), *((j, 1.0 if v[j] > 0 else -1.0, 0.0) for j in new)])
        at, sign, bend = ([c[i] for c in both] for i in range(3))
    return x


def linear_pieces(signal: np.ndarray, weight: float = 5.0, first: float | None = None, last: float | None = None, iterations: int = 60) -> np.ndarray:
    """|y - x|^2 + w |second differences|_1, with given end points if stated: interior point on the dual, five bands a step."""
    n = len(signal)
    if n < 3:
        return signal.astype(float).copy()
    if first is not None and last is not None:
        return _pieces_between(np.r_[first, signal[1:-1], last], weight)
    y = signal.astype(float).copy()
    free = np.ones(n)
    if first is not None:
        y[0], free[0] = first, 0.0
    if last is not None:
        y[-1], free[-1] = last, 0.0
    # Bands of D F D' / 2, with F the mask of the free points.
    f0, f1, f2 = free[:-2], free[1:-1], free[2:]
    k0 = (f0 + 4 * f1 + f2) / 2
    k1 = (-2 * f1[:-1] - 2 * f2[:-1]) / 2
    k2 = f2[:-2] / 2
    m = n - 2
    c = np.diff(y, 2)

    def times(v):
        out = k0 * v
        out[:-1] += k1 * v[1:]
        out[1:] += k1 * v[:-1]
        out[:-2] += k2 * v[2:]
        out[2:] += k2 * v[:-2]
        return out

    v = np.zeros(m)
    up, low = np.ones(m), np.ones(m)
    mu = 10.0
    for _ in range(iterations):
        fu, fl = v - weight, -v - weight
        gap = -(fu @ up + fl @ low)
        residual = times(v) - c + up - low
        if gap < 1e-9 * m * max(weight, 1) and np.abs(residual).max() < 1e-8:
            break
        t = mu * 2 * m / max(gap, 1e-300)
        rhs = -(times(v) - c + (-1 / t / fu) - (-1 / t / fl))
        dv = _pentadiagonal(k0 - up / fu - low / fl, k1, np.r_[k2], rhs) if m > 2 else np.linalg.solve(np.diag(k0 - up / fu - low / fl) + np.diag(k1, 1) + np.diag(k1, -1), rhs)
        du, dl = -up - (1 / t + up * dv) / fu, -low - (1 / t - low * dv) / fl
        step = 1.0
        for value, move in ((up, du), (low, dl)):
            neg = move < 0
            if neg.any():
                step = min(step, 0.99 * float((-value[neg] / move[neg]).min()))
        base = np.sqrt(((times(v) - c + up - low) ** 2).sum() + ((up * fu + 1 / t) ** 2).sum() + ((low * fl + 1 / t) ** 2).sum())
        while step > 1e-12:
            nv, nu, nl = v + step * dv, up + step * du, low + step * dl
            if (np.abs(nv) < weight).all():
                now = np.sqrt(((times(nv) - c + nu - nl) ** 2).sum() + ((nu * (nv - weight) + 1 / t) ** 2).sum() + ((nl * (-nv - weight) + 1 / t) ** 2).sum())
                if now <= (1 - 0.01 * step) * base:
                    break
            step *= 0.5
        v, up, low = v + step * dv, up + step * du, low + step * dl
    x = y.copy()
    x[:-2] -= free[:-2] * v / 2
    x[1:-1] += free[1:-1] * v
    x[2:] -= free[2:] * v / 2
    return x


def periodic_threshold(signal: np.ndarray, tau: float = 0.9, stiffness: float = 1e6) -> np.ndarray:
    """A smooth periodic quantile over one year of days of the year: pinball + stiffness |second differences|^2, the ends joined."""
    n, ok = len(signal), known(signal, None)
    d = np.roll(np.eye(n), -1, axis=1) - 2 * np.eye(n) + np.roll(np.eye(n), 1, axis=1)
    rows = np.flatnonzero(ok)
    a = np.eye(n)[rows]
    start = np.full(n, np.quantile(signal[rows], tau)) if len(rows) else np.full(n, np.nan)
    return smooth_pinball(a, signal[rows], tau, 2 * stiffness * d.T @ d + 1e-12 * np.eye(n), start, least=1e-6) if len(rows) else start


def soiling(signal: np.ndarray, tau: float = 0.85, w1: float = 2.0, w2: float = 1e-3, w3: float = 0.5, w4: float = 2e-2, passes: int = 5) -> dict[str, np.ndarray]:
    """Soiling (at most 0, piecewise linear), season (365-periodic, smooth) and a line from 0, of a normalised log-like energy signal."""
    return many.alone(soiling_fits(signal, tau, w1, w2, w3, w4, passes))


def soiling_fits(signal: np.ndarray, tau: float = 0.85, w1: float = 2.0, w2: float = 1e-3, w3: float = 0.5, w4: float = 2e-2, passes: int = 5):
    """``soiling`` as a generator that yields its fits; in each pass every bend is weighted by 1 / (0.01 + 100 times its size in the pass before)."""
    n = len(signal)
    weights = np.ones(max(n - 2, 0))
    for _ in range(passes):
        s, season, slope = yield soiling_passes, (signal, tau, w1 * weights, w2, 0.9 * w3, w4 * n)
        weights = 1 / (0.01 + 100 * np.abs(np.diff(s, 2)))
    return {"soiling": np.minimum(s, 0), "season": season[np.arange(n) % len(season)], "trend": np.arange(n) / 365 * slope}


def soiling_passes(asked: list[tuple]) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """Minimisers (s, c, slope) of pinball(y - s - c[day % 365] - slope day / 365) + weights |bends of s| - w2 s + w3 |differences of s| + w4 |circular bends of c|, s at most 0.

    Each (signal, tau, weights, w2, w3, w4); c has a year's days, or those of a shorter signal.
    """
    out: list = [None] * len(asked)
    for at in many.chunks([len(a[0]) for a in asked]):
        n = max(len(asked[i][0]) for i in at)
        size = max(1, SOILING_CELLS // (n * min(n, 365)))
        for k in range(0, len(at), size):
            for i, found in zip(at[k : k + size], _soiling_passes([asked[i] for i in at[k : k + size]])):
                out[i] = found
    return out


def _five_bands(d0: np.ndarray, d1: np.ndarray, d2: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Solutions of symmetric systems of five bands, (problems, n), (problems, n - 1), (problems, n - 2), for right sides (problems, n, k): elimination by blocks of days."""
    size, n, k = right.shape
    width = n if n <= 2 * BAND_BLOCK else BAND_BLOCK
    held, out = [], np.empty_like(right)
    start = np.arange(0, n, width)
    less, r = None, right[:, :width]
    for a in start:
        b = min(a + width, n)
        i = np.arange(b - a)
        h = np.zeros((size, b - a, b - a))
        h[:, i, i] = d0[:, a:b]
        h[:, i[:-1], i[1:]] = h[:, i[1:], i[:-1]] = d1[:, a : b - 1]
        h[:, i[:-2], i[2:]] = h[:, i[2:], i[:-2]] = d2[:, a : max(b - 2, a)]
        if less is not None:
            h[:, : less.shape[1], : less.shape[1]] -= less
        # The next block's first two days hang on the last two of this one.
        c = min(2, n - b)
        over = np.zeros((size, b - a, c))
        if c:
            over[:, -1, 0] = d1[:, b - 1]
            if b - a > 1:
                over[:, -2, 0] = d2[:, b - 2]
            if c > 1:
                over[:, -1, 1] = d2[:, b - 1]
        x = np.linalg.solve(h, np.concatenate([over, r], axis=2))
        held.append((a, b, x[:, :, :c], x[:, :, c:]))
        if c:
            less = over.transpose(0, 2, 1) @ x[:, :, :c]
            r = right[:, b : b + width].copy()
            r[:, :c] -= over.transpose(0, 2, 1) @ x[:, :, c:]
    after = None
    for a, b, by_next, x in reversed(held):
        out[:, a:b] = x if after is None else x - by_next @ after[:, : by_next.shape[2]]
        after = out[:, a:b]
    return out


def _soiling_passes(asked: list[tuple]) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """``soiling_passes`` of one call: an interior point on (u, c, slope) with u = -s > 0, the days of u eliminated by their five bands."""
    lengths = np.array([len(a[0]) for a in asked])
    n, size = int(lengths.max()), len(asked)
    m, day = min(n, 365), np.arange(n)
    tau, w2, w3, w4 = (np.array([a[c] for a in asked], float) for c in (1, 3, 4, 5))
    signal = many.columns([a[0] for a in asked], np.nan)
    ok, inside = np.isfinite(signal), day[:, None] < lengths
    y, t, fold, years = np.where(ok, signal, 0.0), day[:, None] / 365.0, day % m, -(-n // m)
    level = np.array([np.quantile(signal[ok[:, i], i], tau[i]) if ok[:, i].any() else 0.0 for i in range(size)])
    count, size_of = np.maximum(ok.sum(axis=0), 1), 1 + np.abs(y).max(axis=0)
    spread = np.maximum((np.abs(y - level) * ok).sum(axis=0) / count, 1e-6 * size_of)
    # Circular bends of the season, of each problem over its own days of a year.
    bends = np.zeros((size, m, m))
    for i, k in enumerate(np.minimum(lengths, 365)):
        bends[i, :k, :k] = np.roll(np.eye(k), -1, axis=1) - 2 * np.eye(k) + np.roll(np.eye(k), 1, axis=1)
    square = bends.transpose(0, 2, 1) @ bends
    first = many._Sided(y - level, np.where(ok, tau - 1, 0.0), np.where(ok, tau, 0.0), spread)
    near = np.where(inside[1:], w3, 0.0)
    turn = many.columns([np.r_[a[2], np.zeros(n - 2 - len(a[2]))] if n > 2 else np.zeros(0) for a in asked])
    steps, turns = many._Sided(np.zeros(near.shape), -near, near, spread), many._Sided(np.zeros(turn.shape), -turn, turn, spread)
    u, nu = np.where(inside, 1e-2 * spread, 1.0), np.where(inside, 0.1, 0.0)
    c, slope, v = np.tile(level, (m, 1)), np.zeros(size), np.zeros((m, size))
    cells = 2.0 * (first.on.sum(axis=0) + steps.on.sum(axis=0) + turns.on.sum(axis=0)) + lengths + 1
    found: list = [None] * size
    at, last = np.arange(size), np.zeros(size)
    sides = (first, steps, turns)
    over = lambda x: np.einsum("bij,jb->ib", bends, x)
    back = lambda x: np.einsum("bji,jb->ib", bends, x)

    def folded(x: np.ndarray) -> np.ndarray:
        """Sums over the years, of (n, ...)."""
        if years == 1:
            return x
        return np.concatenate([x, np.zeros((years * m - n, *x.shape[1:]))]).reshape(years, m, *x.shape[1:]).sum(axis=0)

    def down(b1: np.ndarray, b2: np.ndarray) -> np.ndarray:
        x = many._down(b1)
        if len(b2):
            x[:-2] += b2
            x[1:-1] -= 2 * b2
            x[2:] += b2
        return x

    for turn_no in range(many.STEPS):
        r, d1, d2 = y + u - c[fold] - slope * t, np.diff(u, axis=0), np.diff(u, 2, axis=0)
        z = over(c)
        length = np.sqrt((z * z).sum(axis=0))
        gap = sum(x.gap() for x in sides) + (u * nu).sum(axis=0) + w4 * length - (v * z).sum(axis=0)
        primal = np.max([np.where(x.on, np.abs(w - x.up + x.down), 0.0).max(axis=0, initial=0.0) for x, w in zip(sides, (r, d1, d2))], axis=0)
        force, along = np.where(first.on, first.dual, 0.0), down(*(np.where(x.on, x.dual, 0.0) for x in (steps, turns)))
        rest = np.maximum(np.abs(np.where(inside, force + w2 + along - nu, 0.0)).max(axis=0), np.abs(folded(force) - back(v)).max(axis=0))
        rest = np.maximum(rest, np.abs((t * force).sum(axis=0)) / (1 + (t * np.abs(force)).sum(axis=0)))
        done = (gap <= SOILING_TOLERANCE * count * spread) & (primal <= 1e-6 * spread) & (rest <= 1e-5) | (turn_no == many.STEPS - 1) | ~np.isfinite(last)
        if done.any():
            for i in np.flatnonzero(done):
                k = lengths[i]
                found[at[i]] = (-u[:k, i], c[: min(k, 365), i], float(slope[i]))
            left = np.flatnonzero(~done)
            if len(left) == 0:
                break
            y, ok, inside, u, nu, c, v, r, d1, d2, z = (x[:, left] for x in (y, ok, inside, u, nu, c, v, r, d1, d2, z))
            lengths, slope, count, spread, w2, w4, cells, at, last, gap, length, bends, square = (x[left] for x in (lengths, slope, count, spread, w2, w4, cells, at, last, gap, length, bends, square))
            for x in sides:
                x.keep(left)
        target = gap / cells * np.clip((1 - last) ** 2, 0.02, 0.5)
        (theta, a), (g1, b1), (g2, b2) = (x.newton(w, target) for x, w in zip(sides, (r, d1, d2)))
        eta = np.sqrt(length**2 + (target / w4) ** 2)
        main = np.where(inside, theta + nu / u + 1e-8, 1.0)
        main[:-1] += g1
        main[1:] += g1
        one, two = -g1, g2
        if n > 2:
            main[:-2] += g2
            main[1:-1] += 4 * g2
            main[2:] += g2
            one = one.copy()
            one[:-1] -= 2 * g2
            one[1:] -= 2 * g2
        to_u = np.where(inside, -(a + w2 + down(b1, b2) - target / u + 1e-8 * u), 0.0)
        to_c, to_slope = folded(a) - back(w4 / eta * z) - 1e-8 * c, (t * a).sum(axis=0) - 1e-8 * slope
        # Columns of the right sides: -d(gradient of u) by the season's days and the slope, and the step of u alone.
        size = len(at)
        right = np.zeros((size, n, m + 2))
        right[:, day, fold] = -theta.T
        right[:, :, m], right[:, :, m + 1] = -(theta * t).T, to_u.T
        solved = _five_bands(main.T, one.T, two.T, right)
        weighted = folded((theta.T[:, :, None] * solved).transpose(1, 0, 2))
        h = np.zeros((size, m + 1, m + 1))
        p, q = back(v / w4), back(z / eta)
        h[:, :m, :m] = weighted[:, :, :m].transpose(1, 0, 2) + (w4 / eta)[:, None, None] * (square - 0.5 * (p.T[:, :, None] * q.T[:, None, :] + q.T[:, :, None] * p.T[:, None, :]))
        i = np.arange(m)
        h[:, i, i] += folded(theta).T
        tt = np.einsum("nb,bnk->bk", theta * t, solved)
        h[:, m, :m] = tt[:, :m] + folded(theta * t).T
        h[:, :m, m] = h[:, m, :m]
        h[:, m, m] = tt[:, m] + (theta * t * t).sum(axis=0)
        i = np.arange(m + 1)
        h[:, i, i] += 1e-8
        rhs = np.concatenate([to_c.T + weighted[:, :, m + 1].T, (to_slope + tt[:, m + 1])[:, None]], axis=1)
        move = many._solved(h, rhs)
        du = (solved[:, :, m + 1] - np.einsum("bnk,bk->bn", solved[:, :, : m + 1], move)).T
        dc, d_slope = move[:, :m].T, move[:, m]
        dz = over(dc)
        dv = w4 / eta * (z + dz) - v * (z * dz).sum(axis=0) / eta**2 - v
        d_nu = np.where(inside, target / u - nu - nu / u * du, 0.0)
        most = np.max([first.moves(du - dc[fold] - d_slope * t), steps.moves(np.diff(du, axis=0)), turns.moves(np.diff(du, 2, axis=0)), np.where(inside, np.maximum(-du / u, -d_nu / np.where(inside, nu, 1.0)), 0.0).max(axis=0)], axis=0)
        last = np.minimum(1.0, 0.995 / np.maximum(most, 1e-300))
        lost = ~(np.isfinite(most) & np.isfinite(du).all(axis=0) & np.isfinite(move).all(axis=1))
        go = np.where(lost, 0.0, last)
        u, nu, c, slope, v = (x + np.where(lost, 0.0, go * d) for x, d in ((u, du), (nu, d_nu), (c, dc), (slope, d_slope), (v, dv)))
        # The season's multiplier stays in its ball without holding up the others.
        v = v * np.minimum(1.0, 0.999999 * w4 / np.maximum(np.sqrt((v * v).sum(axis=0)), 1e-300))
        for x in sides:
            x.step(go)
        last = np.where(lost, np.nan, last)
    return found


def sawteeth(n: int, waves: int = 12) -> np.ndarray:
    """Falling teeth of several lengths and two phases, one column a tooth, from 0 down to -1."""
    columns = []
    for k in range(1, waves + 1):
        length = max(2, n // k)
        for phase in (0, length // 2):
            for a in range(-phase, n, length):
                lo, hi = max(a, 0), min(a + length, n)
                if hi - lo > 1:
                    c = np.zeros(n)
                    c[lo:hi] = -np.linspace(0, 1, hi - lo)
                    columns.append(c)
    return np.array(columns).T


def bounded_pinball(a: np.ndarray, y: np.ndarray, tau: float, p: np.ndarray, q: np.ndarray, low: np.ndarray, high: np.ndarray, tolerance: float = 1e-6, most: int = 100) -> np.ndarray:
    """Minimiser of pinball(y - A x) + q'x + 1/2 x'diag(p)x, each x free, fixed (low = high), at least 0 or at most 0, by an interior point.

    Its systems have as many unknowns as there are rows, or columns if those are fewer.
    """
    size = a.shape[1]
    fixed = low == high
    x = np.where(fixed, low, 0.0)
    if len(y) == 0:
        return x
    y = y - a @ x
    side = np.where(np.isneginf(low), np.where(np.isposinf(high), 0.0, -1.0), 1.0)
    free, one = np.flatnonzero(~fixed & (side == 0)), np.flatnonzero(~fixed & (side != 0))
    fa, ea = a[:, free], a[:, one] * side[one]
    fp, ep, eq = p[free], p[one], q[one] * side[one]
    n, k = len(y), len(one)
    level = float(np.quantile(y, tau))
    spread = max(float(np.abs(y - level).mean()), 1e-6 * (1 + float(np.abs(y).max())))
    f = np.zeros(len(free))
    if len(free) and fp[0] == 0:
        f[0] = level
    u, nu = np.full(k, 1e-2 * spread), np.full(k, 0.1)
    r = y - fa @ f - ea @ u
    up, down, dual = np.maximum(r, 0) + spread, np.maximum(-r, 0) + spread, np.full(n, tau - 0.5)
    last = 0.0
    for _ in range(most):
        r = y - fa @ f - ea @ u
        # What rounding took from the balance of both parts goes to the larger side.
        off = r - up + down
        up, down = up + np.maximum(off, 0), down + np.maximum(-off, 0)
        above, below = tau - dual, dual - (tau - 1)
        gap = up @ above + down @ below + u @ nu
        rest = max(np.abs(fp * f - fa.T @ dual + q[free]).max(initial=0.0), np.abs(ep * u + eq - ea.T @ dual - nu).max(initial=0.0))
        if gap <= tolerance * n * spread and rest <= 1e-7 * n:
            break
        mu = gap / (2 * n + k) * min(max((1 - last) ** 2, 0.02), 0.5)
        slack = np.maximum(up / above + down / below, 1e-12 * spread)
        shift = r - mu / above + mu / below
        d, g = ep + nu / u, mu / u - eq - ep * u
        if n <= k + len(free):
            wide = ea / d
            kernel = wide @ ea.T
            kernel[np.arange(n), np.arange(n)] += slack + 1e-15 * np.trace(kernel)
            solved = np.linalg.solve(kernel, np.column_stack([fa, slack * dual + shift - wide @ g]))
            h = fa.T @ solved[:, :-1] + np.diag(fp + 1e-11)
            h[np.arange(len(free)), np.arange(len(free))] += 1e-15 * np.trace(h)
            df = np.linalg.solve(h, fa.T @ solved[:, -1] - fp * f - q[free])
            to = solved[:, -1] - solved[:, :-1] @ df
            du = (ea.T @ to + g) / d
        else:
            both = np.hstack([fa, ea])
            h = (both / slack[:, None]).T @ both + np.diag(np.r_[fp + 1e-11, d])
            move = np.linalg.solve(h, both.T @ (dual + shift / slack) + np.r_[-fp * f - q[free], g])
            df, du = move[: len(free)], move[len(free) :]
            to = dual + (shift - both @ move) / slack
        dd = to - dual
        d_up, d_down = mu / above - up + up / above * dd, mu / below - down - down / below * dd
        d_nu = mu / u - nu - nu / u * du
        reach = max(float((-m / v).max(initial=0.0)) for m, v in ((d_up, up), (d_down, down), (-dd, above), (dd, below), (du, u), (d_nu, nu)))
        last = min(1.0, 0.995 / max(reach, 1e-300))
        if not np.isfinite(last) or not np.isfinite(df).all():
            break
        f, u, nu, up, down, dual = f + last * df, u + last * du, nu + last * d_nu, up + last * d_up, down + last * d_down, dual + last * dd
    x[free], x[one] = f, side[one] * u
    return x


@lru_cache(maxsize=64)
def soiling_teeth(n: int) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """(columns, their first and last rows + 1): the constant -1, and 2 to 31 falling teeth from 0 to -1 over the series in two phases, cut at their peaks; equal columns once."""
    columns, spans = [-np.ones(n)], [(0, n)]
    for k in range(2, 32):
        for phase in (0, 1):
            # Fractions of a period in halves of the series' steps, as whole numbers.
            period = 2 * max(n - 1, 1)
            wave = -((2 * k * np.arange(n) - phase * (period // 2)) % period) / period
            # The middles of all tops that both sides are below.
            starts = np.flatnonzero(np.r_[True, np.diff(wave) != 0])
            ends = np.r_[starts[1:], n] - 1
            level = wave[starts]
            top = np.r_[False, (level[1:-1] > level[:-2]) & (level[1:-1] > level[2:]), False][: len(level)]
            cuts = np.r_[0, (starts[top] + ends[top]) // 2, n]
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                if wave[lo:hi].any():
                    columns.append(np.r_[np.zeros(lo), wave[lo:hi], np.zeros(n - hi)])
                    spans.append((int(lo), int(hi)))
    first = sorted(dict(reversed([(c.tobytes(), i) for i, c in enumerate(columns)])).values())
    return np.array([columns[i] for i in first]).T, [spans[i] for i in first]


class _Teeth:
    """``soiling_teeth`` with what the Gram matrices of the days need."""

    def __init__(self, n: int):
        self.b, self.spans = soiling_teeth(n)
        self.back = np.ascontiguousarray(self.b.T)
        self.rows, self.columns = np.triu_indices(n)
        self.pairs = np.ascontiguousarray((self.b[self.rows] * self.b[self.columns]).T) if len(self.rows) * self.b.shape[1] <= LOSS_PAIRS else None

    def gram(self, w: np.ndarray) -> np.ndarray:
        """(problems, n, n): B diag(w) B' of each problem; by single teeth where the table of all pairs would be large."""
        n = len(self.b)
        out = np.zeros((len(w), n, n))
        if self.pairs is not None:
            out[:, self.rows, self.columns] = out[:, self.columns, self.rows] = w @ self.pairs
        else:
            for j, (lo, hi) in enumerate(self.spans):
                t = self.b[lo:hi, j]
                out[:, lo:hi, lo:hi] += w[:, j, None, None] * (t[:, None] * t[None, :])
        return out


def loss_problem(energy: np.ndarray, labels: np.ndarray | None = None, harmonics: int = 4, season_weight: float = 0.1, kind: str = "linear", rate: float | None = None, use: np.ndarray | None = None) -> dict[str, object]:
    """What all fits of a series' log energy share: its columns but the soiling's, their squared weights and costs, which are at most 0, and the known days."""
    log_e = np.log(np.where(energy > 0.1, energy, np.nan))
    n, ok = len(log_e), known(log_e, use)
    if not ok.any():
        raise ValueError("no usable days")
    b, w = fourier(n, harmonics), fourier_weights(harmonics, season_weight)
    years = (np.arange(n) / 365.0)[:, None]
    levels = np.zeros((n, 0))
    if labels is not None and len(set(labels.tolist())) > 1:
        base = max(set(labels.tolist()), key=lambda g: np.nanmedian(log_e[labels == g]) if np.isfinite(log_e[labels == g]).any() else -np.inf)
        levels = np.array([(labels == g).astype(float) for g in sorted(set(labels.tolist())) if g != base]).T
    held = kind == "linear" and rate is not None
    trend = years if kind == "linear" else np.zeros((n, 0)) if kind == "none" else np.maximum(0, years - np.arange(0, max(1, n // 365))[None, :])
    free = np.zeros((n, 0)) if held else trend
    parts = {"baseline": b, "degradation": free, "capacity": levels}
    sizes = [x.shape[1] for x in parts.values()]
    return {
        "log": log_e, "ok": ok, "f": np.hstack(list(parts.values())), "p": np.r_[w**2, np.full(sizes[1] + sizes[2], 1e-8)], "q": np.r_[np.zeros(sizes[0] + sizes[1]), np.full(sizes[2], -1e-6)],
        "below": np.r_[np.zeros(sizes[0], bool), np.full(sizes[1], kind == "monotone"), np.ones(sizes[2], bool)], "edges": np.cumsum([0, *sizes]), "held": years[:, 0] * rate if held else np.zeros(n),
    }


def loss_fits(asked: list[tuple]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(coefficients, soiling) of the fits of each (problem, levels, stiffnesses, known days of each fit, sparsity, with soiling): rows are fits.

    Least pinball(y - F f - s) + stiffness |z|_1 - sparsity sum(s) + 1/2 f'diag(p)f + q'f, with s = B z at most 0
    and B the ``soiling_teeth``.  Fits of all series of a length are solved together.
    """
    out: list = [None] * len(asked)
    groups: dict[tuple[int, int, bool], list[int]] = {}
    for i, (problem, *_, soils) in enumerate(asked):
        groups.setdefault((*problem["f"].shape, soils), []).append(i)
    for (n, size, soils), at in groups.items():
        teeth = _Teeth(n) if soils else None
        of = np.repeat(at, [len(asked[i][1]) for i in at])
        row = np.concatenate([np.arange(len(asked[i][1])) for i in at])
        for i in at:
            out[i] = (np.zeros((len(asked[i][1]), size)), np.zeros((len(asked[i][1]), n)))
        step = max(1, LOSS_CELLS // max(n * n, teeth.b.shape[1] if soils else 1))
        for k in range(0, len(of), step):
            mine, rows = of[k : k + step], row[k : k + step]
            take = lambda c: np.array([asked[i][0][c] for i in mine])  # noqa: E731, B023
            each = lambda c: np.array([asked[i][c][r] for i, r in zip(mine, rows)])  # noqa: E731, B023
            f, s = _loss_fits(take("log") - take("held"), take("ok") & each(3), take("f"), take("p"), take("q"), take("below"), each(1), each(2), np.array([asked[i][4] for i in mine], float), teeth)
            for i, r, x, y in zip(mine, rows, f, s):
                out[i][0][r], out[i][1][r] = x, y
    return out


def _loss_fits(y: np.ndarray, ok: np.ndarray, f: np.ndarray, p: np.ndarray, q: np.ndarray, below: np.ndarray, tau: np.ndarray, stiff: np.ndarray, sparse: np.ndarray, teeth: _Teeth | None, tolerance: float = 1e-7) -> tuple[np.ndarray, np.ndarray]:
    """``loss_fits`` of some (problems first) of a length, by an interior point whose systems have as many unknowns as days; NaN where it did not settle."""
    (size, n), cols = y.shape, f.shape[2]
    b = teeth.b if teeth else np.zeros((n, 0))
    k = b.shape[1]
    y = np.where(ok, y, 0.0)
    count = np.maximum(ok.sum(axis=1), 1)
    level = y.sum(axis=1) / count
    spread = np.maximum((np.abs(y - level[:, None]) * ok).sum(axis=1) / count, 1e-6 * (1 + np.abs(y).max(axis=1)))
    wide = spread[:, None]
    c = np.where(below, -0.1 * wide, 0.0)
    c[:, 0] = level
    v = dict(
        at=np.arange(size), y=y, ok=ok * 1.0, f=f, p=p, q=q, below=below, tau=tau[:, None], stiff=stiff[:, None], sparse=sparse[:, None], wide=wide, count=count, c=c, nc=np.where(below, 0.1, 0.0),
        s=np.full((size, n), -0.1) * wide, ns=np.full((size, n), 0.1), zu=np.full((size, k), 0.1) * wide, zd=np.full((size, k), 0.1) * wide, m=np.zeros((size, k)),
        dual=(tau[:, None] - 0.5) * ok, last=np.zeros((size, 1)), best=np.full(size, 1e-4), since=np.zeros(size, int),
    )
    if not teeth:
        v["s"] = np.zeros((size, n))
    r = y - np.einsum("bnk,bk->bn", f, c) - v["s"]
    v["up"], v["down"] = np.maximum(r, 0) + wide, np.maximum(-r, 0) + wide
    out_c, out_s = np.full((size, cols), np.nan), np.full((size, n), np.nan)
    eye = np.arange(n)
    for turn in range(LOSS_STEPS):
        y, on, f, c, s, wide = (v[x] for x in ("y", "ok", "f", "c", "s", "wide"))
        r = y - np.einsum("bnk,bk->bn", f, c) - s
        # What rounding took from the balance of both parts goes to the larger side.
        gone = r - v["up"] + v["down"]
        v["up"], v["down"] = v["up"] + np.maximum(gone, 0), v["down"] + np.maximum(-gone, 0)
        above, under = v["tau"] - v["dual"], v["dual"] - v["tau"] + 1
        high, low = v["stiff"] - v["m"], v["m"] + v["stiff"]
        gap = (on * (v["up"] * above + v["down"] * under)).sum(axis=1) - (c * v["nc"]).sum(axis=1)
        cells = 2 * v["count"] + v["below"].sum(axis=1)
        off = np.zeros(len(y))
        rest = np.abs(v["p"] * c + v["q"] + v["nc"] - np.einsum("bnk,bn->bk", f, on * v["dual"])).max(axis=1)
        if teeth:
            gap += np.einsum("bk,bk->b", v["zu"], high) + np.einsum("bk,bk->b", v["zd"], low) - (s * v["ns"]).sum(axis=1)
            cells = cells + 2 * k + n
            # The coefficients are the differences of their parts.
            z = v["zu"] - v["zd"]
            bz = z @ teeth.back
            off = np.abs(s - bz).sum(axis=1)
            rest = np.maximum(rest, np.abs((on * v["dual"] - v["ns"] + v["sparse"]) @ b - v["m"]).max(axis=1))
        full = v["count"] * wide[:, 0]
        done = (gap <= tolerance * full) & (off <= tolerance * full) & (rest <= 1e-6 * v["count"])
        # Where rounding stops a fit near its end, the nearest that it came is the answer; one that stays far from it has none.
        score = np.maximum(np.maximum(gap, off) / full, rest / v["count"])
        better = done | (score < v["best"])
        out_c[v["at"][better]], out_s[v["at"][better]] = c[better], s[better]
        v["best"], v["since"] = np.where(better, score, v["best"]), np.where(better, 0, v["since"] + 1)
        lost = ~np.isfinite(score) | ((v["since"] >= 5) & (v["best"] < 1e-4))
        if done.any() or lost.any() or turn == LOSS_STEPS - 1:
            left = np.flatnonzero(~(done | lost))
            if len(left) == 0 or turn == LOSS_STEPS - 1:
                break
            v = {name: x[left] for name, x in v.items()}
            y, on, f, c, s, wide = (v[x] for x in ("y", "ok", "f", "c", "s", "wide"))
            r, above, under, high, low, gap, cells = (x[left] for x in (r, above, under, high, low, gap, cells))
            z, bz = (z[left], bz[left]) if teeth else (None, None)
        # After a short step the parts are brought back to the middle first.
        t = (gap / cells)[:, None] * np.clip((1 - v["last"]) ** 2, 0.02, np.where(v["last"] < 0.3, 1.0, 0.5) if turn else 0.5)
        theta = on / np.maximum(v["up"] / above + v["down"] / under, 1e-12 * wide)
        shift = r - t / above + t / under
        a = on * v["dual"] + theta * shift
        bar = np.where(v["below"], v["nc"] / np.where(v["below"], -c, 1.0), 0.0)
        push = np.where(v["below"], t / np.where(v["below"], -c, 1.0), 0.0)
        if teeth:
            high, low = 1 / high, 1 / low
            spring = v["zu"] * high + v["zd"] * low
            # The multiplier to come is m + (move of z + bend) / spring.
            bend = z + t * (low - high)
            kernel = teeth.gram(spring)
            e, h = t / -s, v["ns"] / -s
            inverse = 1 / (theta + h)
            g = a + v["sparse"] - e
            start = bz - s - (spring * v["m"] + bend) @ teeth.back
            kernel[:, eye, eye] += inverse
            ft = (theta * inverse)[:, :, None] * f
            right = np.concatenate([(inverse * g - start)[:, :, None], ft], axis=2)
            try:
                found = np.linalg.solve(kernel, right)
            except np.linalg.LinAlgError:
                kernel[:, eye, eye] += 1e-14 * np.einsum("bii->b", kernel)[:, None] / n
                found = np.linalg.solve(kernel, right)
            lam0 = a - theta * inverse * (g - found[:, :, 0])
            lam = (theta * inverse)[:, :, None] * (h[:, :, None] * f + found[:, :, 1:])
        else:
            lam0, lam = a, theta[:, :, None] * f
        hess = np.matmul(f.transpose(0, 2, 1), lam)
        hess[:, np.arange(cols), np.arange(cols)] += v["p"] + bar + 1e-16 * np.einsum("bii->b", hess)[:, None] / cols + 1e-12
        dc = many._solved(hess, np.einsum("bnk,bn->bk", f, lam0) - v["p"] * c - v["q"] - push)
        d_nc = np.where(v["below"], push + bar * dc - v["nc"], 0.0)
        d_dual = on * (lam0 - np.einsum("bnk,bk->bn", lam, dc) - v["dual"])
        moves = {"c": dc, "nc": d_nc, "dual": d_dual}
        moves["up"], moves["down"] = t / above - v["up"] + v["up"] / above * d_dual, t / under - v["down"] - v["down"] / under * d_dual
        ratios = [(-moves["up"] / v["up"]) * on, (-moves["down"] / v["down"]) * on, d_dual / above * on, -d_dual / under * on, np.where(v["below"], np.maximum(dc / np.where(v["below"], -c, 1.0), -d_nc / np.where(v["below"], v["nc"], 1.0)), 0.0)]
        if teeth:
            pi = found[:, :, 0] - np.einsum("bnk,bk->bn", found[:, :, 1:], dc)
            d_m = pi @ b - v["m"]
            ds = inverse * (g - theta * np.einsum("bnk,bk->bn", f, dc) - pi)
            moves |= {"s": ds, "ns": e + h * ds - v["ns"], "m": d_m}
            to_high, to_low = d_m * high, d_m * low
            moves["zu"], moves["zd"] = t * high + v["zu"] * (to_high - 1), t * low - v["zd"] * (to_low + 1)
            ratios += [ds / -s, -moves["ns"] / v["ns"], -moves["zu"] / v["zu"], -moves["zd"] / v["zd"], to_high, -to_low]
        most = np.max([x.max(axis=1) for x in ratios], axis=0)
        v["last"] = np.minimum(1.0, 0.995 / np.maximum(most, 1e-300))[:, None]
        for name, d in moves.items():
            v[name] = v[name] + v["last"] * d
    return out_c, out_s


def loss_factors(energy: np.ndarray, labels: np.ndarray | None = None, tau: float = 0.9, stiffness: float = 0.5, sparsity: float = 0.02, with_soiling: bool = True, **options) -> dict[str, np.ndarray]:
    """Components of log energy: baseline, degradation, soiling, capacity, weather; ``options`` are those of ``loss_problem``."""
    return many.alone(loss_factors_fits(energy, labels, tau, stiffness, sparsity, with_soiling, **options))


def loss_factors_fits(energy: np.ndarray, labels: np.ndarray | None = None, tau: float = 0.9, stiffness: float = 0.5, sparsity: float = 0.02, with_soiling: bool = True, **options):
    """``loss_factors`` as a generator that yields its fit.

    Pinball weather residual, capacity steps by label (at most 0), soiling (at most 0) by sawteeth with
    absolute costs, linear or monotone degradation from 0, a Fourier baseline.
    """
    problem = loss_problem(energy, labels, **options)
    x, s = yield loss_fits, (problem, np.array([tau]), np.array([stiffness]), problem["ok"][None, :], sparsity, with_soiling)
    if not np.isfinite(x).all():
        raise ValueError("the fit of the loss factors did not settle")
    part = lambda i: problem["f"][:, problem["edges"][i] : problem["edges"][i + 1]] @ x[0, problem["edges"][i] : problem["edges"][i + 1]]
    out = {"baseline": part(0), "degradation": part(1) + problem["held"], "soiling": np.minimum(s[0], 0.0), "capacity": part(2)}
    out["weather"] = problem["log"] - sum(out.values())
    rate, first = options.get("rate"), problem["edges"][1]
    out["rate"] = np.array([rate if problem["held"].any() and rate is not None else x[0, first] if problem["edges"][2] > first else 0.0 if rate is None else rate])
    return out


def pvpro_components(signal: np.ndarray, period: int = 52, known_lambda2: float = 0.1, smooth: float = 10.0, trend: str = "linear", rising: bool = False) -> dict[str, np.ndarray]:
    """Residual, sparse outliers, constant, smooth season and trend of a scaled parameter series."""
    n, ok = len(signal), known(signal, None)
    m = min(period, n)
    fold = np.arange(n) % m
    t = np.arange(n, dtype=float) / m
    shapes = t[:, None] if trend == "linear" else np.maximum(0, t[:, None] - np.arange(0, max(1, int(t[-1]) + 1))[None, :])
    k = shapes.shape[1]
    season = np.zeros((n, m))
    season[np.arange(n), fold] = 1
    rows = np.flatnonzero(ok)
    # Unknowns: outliers of known rows, level, season, trend.
    size = len(rows) + 1 + m + k
    fit = np.hstack([np.eye(len(rows)), np.ones((len(rows), 1)), season[rows], shapes[rows]])
    p = 2 * fit.T @ fit / n
    d = np.roll(np.eye(m), -1, axis=1) - 2 * np.eye(m) + np.roll(np.eye(m), 1, axis=1)
    at = len(rows) + 1
    p[at : at + m, at : at + m] += 2 * smooth * d.T @ d + 100.0 * np.ones((m, m)) / m
    q = -2 * fit.T @ signal[rows] / n
    sparse = np.hstack([np.eye(len(rows)), np.zeros((len(rows), size - len(rows)))])
    terms = [dense_term(sparse, soft(known_lambda2 / n))]
    if trend != "linear":
        last = np.hstack([np.zeros((k, size - k)), np.eye(k)])
        terms.append(dense_term(last, within(0.0, np.inf) if rising else at_most(0.0)))
    x = solve(p + 1e-9 * np.eye(size), q, terms, rho=0.1 / n, iterations=1500, tolerance=1e-6)
    out = np.full(n, np.nan)
    out[rows] = x[: len(rows)]
    level, s, tr = np.full(n, x[len(rows)]), season @ x[at : at + m], shapes @ x[at + m :]
    return {"outliers": out, "level": level, "season": s, "trend": tr, "residual": signal - np.nan_to_num(out) - level - s - tr}


def _day_waves(n: int, day_length: int, harmonics: int) -> np.ndarray:
    return np.sin(np.outer((np.arange(n) % day_length) / day_length, np.pi * np.arange(1, harmonics + 1)))


def multi_periodic_basis(n: int, day_length: int, harmonics: tuple[int, int] = (16, 3)) -> tuple[np.ndarray, np.ndarray]:
    """Standing waves over a day of ``day_length`` points, waves of the year, their products; and each column's frequency."""
    day = _day_waves(n, day_length, harmonics[0])
    year = fourier(n, harmonics[1], YEAR * day_length)
    columns = [np.ones(n)] + [day[:, i] * year[:, j] for i in range(day.shape[1]) for j in range(year.shape[1])]
    weight = [0.0] + [float(i + 1 + (j + 1) // 2) for i in range(day.shape[1]) for j in range(year.shape[1])]
    return np.array(columns).T, np.array(weight)


def smooth_quantiles(signal: np.ndarray, levels: list[float], day_length: int, harmonics: tuple[int, int] = (16, 3), regularization: float = 0.1) -> dict[float, np.ndarray]:
    """Quantiles of a dilated signal that don't cross: each level is fitted and kept at or above the one below."""
    out: dict[float, np.ndarray] = {}
    below = None
    for level, q in zip(sorted(levels), multi_periodic_quantiles([(signal, level, day_length, harmonics, regularization) for level in sorted(levels)])):
        below = q if below is None else np.maximum(q, below)
        out[level] = below
    return out


def multi_periodic_quantiles(asked: list[tuple]) -> list[np.ndarray]:
    """The minimiser of pinball + 1/2 |regularization * frequency * x|^2 over the columns of ``multi_periodic_basis``, at all points.

    Each (signal, level, day length, harmonics, regularization), all together; the columns are products and not written out.
    """
    out: list = [None] * len(asked)
    for kind in {a[2:] for a in asked}:
        length, harmonics, regularization = kind
        mine = [i for i, a in enumerate(asked) if a[2:] == kind]
        weight = multi_periodic_basis(1, length, harmonics)[1]
        penalty = (regularization * weight) ** 2 + 1e-9
        day = np.hstack([np.ones((length, 1)), _day_waves(length, length, harmonics[0])])
        for at in many.chunks([len(asked[i][0]) for i in mine]):
            some = [asked[mine[k]] for k in at]
            days = -(-max(len(a[0]) for a in some) // length)
            y = np.full((len(some), days * length), np.nan)
            for k, a in enumerate(some):
                y[k, : len(a[0])] = a[0]
            # By point of the day, then by day.
            y = y.reshape(-1, days, length).transpose(2, 1, 0).reshape(length * days, -1)
            year = fourier(days * length, harmonics[1], YEAR * length).reshape(days, length, -1).transpose(1, 0, 2)
            wide, level = many.Products(day, year), np.array([a[1] for a in some])
            z = many.solve(y, np.isfinite(y), wide, np.tile(penalty, (len(some), 1)), low=level - 1, high=level, tolerance=1e-8)[1]
            fit = wide.times(z).reshape(length, days, -1).transpose(2, 1, 0).reshape(len(some), -1)
            for k, i in enumerate(at):
                out[mine[i]] = fit[k, : len(some[k][0])]
    return out
