"""Detectors over one system's daily rows: daytime, quality clusters, clear days, clipping, capacity steps, clock shifts."""

from __future__ import annotations

from bisect import insort

import numpy as np

from sunloom.kernels import admm, many
from sunloom.kernels import decompositions as dc

#: Thresholds for daytime that are tried.
SUN_THRESHOLDS = np.logspace(-5, -1, 21)
CAPACITY_WEIGHTS, SHIFT_WEIGHTS = np.logspace(-0.5, 2.5, 13), np.logspace(-1, 2, 11)
CDF_POINTS = 5000
#: A step lies between two usable days, so with fewer there is nothing to decide.
LEAST_DAYS = 2


def split(ok: np.ndarray, share: float, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Masks of a random part of the known entries and of the others."""
    at = rng.permutation(np.flatnonzero(ok))
    first = np.zeros(len(ok), bool)
    first[at[: int(share * len(at))]] = True
    return first, ok & ~first


def sun_times(rise: np.ndarray, fall: np.ndarray, seed: int = 0) -> dict[str, np.ndarray | float]:
    """Smooth sunrise and sunset from the rough times at each threshold (rows: thresholds).

    The smallest threshold whose error on held-out days is within 10 % of the least one;
    thresholds with fewer than 60 % of the days or a seasonal range up to a quarter hour don't count.
    """
    return many.alone(sun_times_fits(rise, fall, seed))


def sun_times_fits(rise: np.ndarray, fall: np.ndarray, seed: int = 0):
    """``sun_times`` as a generator that yields its fits."""
    errors = np.full(len(rise), 100.0)
    # Neighbouring thresholds often show the same times.
    equal: dict[tuple[bytes, bytes], list[int]] = {}
    for i, (a, b) in enumerate(zip(rise, fall)):
        if min(np.isfinite(a).mean(), np.isfinite(b).mean()) > 0.6:
            equal.setdefault((a.tobytes(), b.tobytes()), []).append(i)
    asked, tests, parts = [], [], {}
    for i, *_ in equal.values():
        for x, tau in ((rise[i], 0.1), (fall[i], 0.9)):
            ok = np.isfinite(x)
            if ok.tobytes() not in parts:
                parts[ok.tobytes()] = split(ok, 0.8, np.random.default_rng(seed))
            train, test = parts[ok.tobytes()]
            asked.append((x, tau, train))
            tests.append(test)
    fits = (yield dc.quantiles, (asked, 1.0, 3)) if asked else []
    for k, same in enumerate(equal.values()):
        both = range(2 * k, 2 * k + 2)
        if all(np.ptp(fits[j]) > 0.25 for j in both):
            errors[same] = float(np.mean(np.concatenate([np.abs(asked[j][0] - fits[j])[tests[j]] for j in both])))
    best = int(np.flatnonzero(errors < 1.1 * errors.min())[0])
    up, down = yield from smooth_times_fits(rise[best], fall[best])
    return {"threshold": float(SUN_THRESHOLDS[best]), "sunrise": up, "sunset": down, "noon": (rise[best] + fall[best]) / 2}


def smooth_times(rise: np.ndarray, fall: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smooth low quantile of the sunrises and high quantile of the sunsets; NaN where none is known."""
    return many.alone(smooth_times_fits(rise, fall))


def smooth_times_fits(rise: np.ndarray, fall: np.ndarray):
    up, down = yield dc.quantiles, ([(rise, 0.1, None), (fall, 0.9, None)], 1.0, 3)
    return up, down


def dbscan(points: np.ndarray, eps: float = 0.03, least: int = 3) -> np.ndarray:
    """Labels of density clusters, -1 for noise; labels in the order of each cluster's first core point."""
    n = len(points)
    near = [np.zeros(0, int)] * n
    for a in range(0, n, 512):
        d = ((points[a : a + 512, None, :] - points[None, :, :]) ** 2).sum(axis=2)
        for i, row in enumerate(d <= eps * eps):
            near[a + i] = np.flatnonzero(row)
    core = np.array([len(x) >= least for x in near])
    labels, k = np.full(n, -1), 0
    for i in range(n):
        if labels[i] >= 0 or not core[i]:
            continue
        labels[i], todo = k, [i]
        while todo:
            for j in near[todo.pop()]:
                if labels[j] < 0:
                    labels[j] = k
                    if core[j]:
                        todo.append(j)
        k += 1
    return labels


def quality(density: np.ndarray, linearity: np.ndarray, low: float = 0.6, high: float = 1.05, linear: float = 0.1) -> dict[str, np.ndarray | bool]:
    """Density and linearity scores against the seasonal density; flags; clusters of days; whether the scores cluster within the limits."""
    return many.alone(quality_fits(density, linearity, low, high, linear))


def quality_fits(density: np.ndarray, linearity: np.ndarray, low: float = 0.6, high: float = 1.05, linear: float = 0.1):
    """``quality`` as a generator that yields its fits."""
    usable = (density > 0.2) & (density < 0.8)
    (fit,) = yield dc.quantiles, ([(density, 0.85, usable if usable.any() else None)], 1.0, 3)
    scores = np.divide(density, fit, out=np.zeros_like(density), where=fit > 0)
    lines = np.divide(linearity, fit, out=np.zeros_like(density), where=fit > 0)
    labels = dbscan(np.c_[scores, lines], 0.03, int(max(0.01 * len(scores), 3)))
    outside = (lines > linear) | (scores < low) | (scores > high)
    normal = any(outside[labels == k].sum() <= max(5e-3 * len(scores), 1) for k in set(labels.tolist()))
    return {"density_score": scores, "density_fit": fit, "linearity_score": lines, "cluster": labels, "normal": bool(normal), "no_errors": (scores > low) & (scores < high) & (lines < linear)}


def clear_days(bends: np.ndarray, energy: np.ndarray, density: np.ndarray, smooth: float = 0.9, sunny: float = 0.8) -> np.ndarray:
    """Weights of clear days: smooth and sunny against the season's best, and of usual density."""
    return many.alone(clear_days_fits(bends, energy, density, smooth, sunny))


def clear_days_fits(bends: np.ndarray, energy: np.ndarray, density: np.ndarray, smooth: float = 0.9, sunny: float = 0.8):
    """``clear_days`` as a generator that yields its fits."""
    top = np.nanmax(bends) or 1.0
    tc = 1 - np.nan_to_num(bends / top, nan=1.0)
    de = np.nan_to_num(energy / (np.nanmax(energy) or 1.0))
    usable = (density > 0.2) & (density < 0.8)
    tops = yield dc.quantiles, ([(tc, 0.9, None), (de, 0.9, None), (density, 0.85, usable if usable.any() else None)], 1.0, 3)
    tc, de, rest = np.clip(tc / tops[0], 0, None), np.clip(de / tops[1], 0, 1), density - tops[2]
    q1, q3 = np.quantile(rest, [0.25, 0.75])
    usual = (rest >= q1 - 5 * (q3 - q1)) & (rest <= q3 + 5 * (q3 - q1))
    return np.where((tc > smooth) & (de > sunny) & usual, np.sqrt(tc * de), 0.0)


def point_masses(ratios: np.ndarray, drop: float = -0.35, weight: float = 5.0) -> np.ndarray:
    """Values at which the distribution of the daily maxima (0 to 1) has a point mass: its slope falls by more than a part at once."""
    x = np.sort(ratios[ratios > 0])
    x = np.concatenate([[0.0], x, [1.0]])
    grid = np.linspace(0, 1, CDF_POINTS)
    fit = dc.linear_pieces(np.interp(grid, x, np.linspace(0, 1, len(x))), weight, 0.0, 1.0)
    slope, curve = np.diff(fit), np.diff(fit, 2)
    padded = np.r_[curve, 0.0, 0.0]
    with np.errstate(divide="ignore", invalid="ignore"):
        # The fall over one, two and three points.
        falls = np.min([(np.sum([padded[j : j + len(curve)] for j in range(k)], axis=0)) / slope[:-1] for k in (1, 2, 3)], axis=0)
    hit = np.r_[False, (falls <= drop) & (slope[:-1] > 3e-4), False]
    if slope[-1] > 1e-3 or np.isclose(slope[-1], slope.max()):
        hit[-2] = True
    starts = np.flatnonzero(hit & ~np.r_[False, hit[:-1]])
    ends = np.flatnonzero(hit & ~np.r_[hit[1:], False])
    strength = np.r_[falls, 0.0, 0.0]
    picks = [a + int(np.argmax(strength[a : b + 1])) for a, b in zip(starts, ends)]
    return grid[picks]


def clipping(top: np.ndarray, near_top: np.ndarray, no_errors: np.ndarray) -> dict[str, np.ndarray | bool]:
    """Clipped days from the daily maximum's ratio to the largest and the share of energy near it."""
    masses = point_masses(top)
    days = (top > 0.05) & (near_top > 0.1) & no_errors
    days &= (np.abs(top[:, None] - masses[None, :]) < 0.0075).any(axis=1) if len(masses) else False
    clips = bool(days.sum() > 0.01 * len(days))
    return {"days": days, "inverter_clipping": clips, "points": masses if clips else np.zeros(0)}


def capacity_steps(top: np.ndarray, use: np.ndarray) -> np.ndarray | None:
    """Labels of days by level of the log daily maximum: the smallest step weight that improves the fit by 2 % with under five steps, none small.

    None with fewer than ``LEAST_DAYS`` usable days.
    """
    return many.alone(capacity_steps_fits(top, use))


def capacity_steps_fits(top: np.ndarray, use: np.ndarray):
    """``capacity_steps`` as a generator that yields its fits, those of all weights together."""
    metric = np.log(np.where(top > 0, top, np.nan))
    use = use & np.isfinite(metric)
    if use.sum() < LEAST_DAYS:
        return None
    fits, errors, counts, least = [], [], [], []
    for f in (yield many.each, [dc.steps_season_trend_fits(metric, w, 1.0, 10.0, use) for w in CAPACITY_WEIGHTS]):
        d = np.abs(np.diff(f["steps"]))
        jumps = d[d > 1e-3]
        fits.append(f["steps"])
        errors.append(float(np.abs(metric - f["steps"] - f["season"] - f["trend"])[use].mean()))
        counts.append(len(jumps))
        least.append(float(jumps.min()) if len(jumps) else 0.0)
    fine = (np.array(errors) / max(max(errors), 1e-300) <= 0.98) & (np.array(counts) < 5) & (np.array(least) >= 0.075)
    steps = fits[int(np.flatnonzero(fine)[0]) if fine.any() else -1]
    bucket = np.round((steps - steps[0]) / 0.05).astype(int)
    order = {b: i for i, b in enumerate(dict.fromkeys(bucket.tolist()))}
    return np.array([order[b] for b in bucket.tolist()])


def clock_shifts(noon: np.ndarray, use: np.ndarray, slots: int, to_hours: bool = True, periodic: bool = False, seed: int = 0) -> dict[str, np.ndarray | bool] | None:
    """Slots by which each day must be rolled, from steps in the solar noon signal.

    The weight is the last before the held-out error's outlying rise; the steps found are
    solved again without a penalty, and rounded.  None where it cannot decide: with fewer than
    ``LEAST_DAYS`` usable days, or if none is found but neither would be one of an hour in the
    middle (in short series the season takes it up).
    """
    return many.alone(clock_shifts_fits(noon, use, slots, to_hours, periodic, seed))


def clock_shifts_fits(noon: np.ndarray, use: np.ndarray, slots: int, to_hours: bool = True, periodic: bool = False, seed: int = 0):
    """``clock_shifts`` as a generator that yields its fits."""
    use = use & np.isfinite(noon)
    if use.sum() < LEAST_DAYS:
        return None
    out = yield from _clock_shifts(noon, use, slots, to_hours, periodic, seed)
    # The season of a whole year can't take up a lasting step.
    if not out["roll"].any() and use.sum() < 365:
        planted = noon + (np.arange(len(noon)) >= np.flatnonzero(use)[use.sum() // 2])
        if not (yield from _clock_shifts(planted, use, slots, to_hours, periodic, seed))["roll"].any():
            return None
    return out


def _clock_shifts(noon: np.ndarray, use: np.ndarray, slots: int, to_hours: bool, periodic: bool, seed: int):
    train, test = split(use, 0.85, np.random.default_rng(seed))
    if periodic:
        factors: dict[float, np.ndarray] = {}
        fits = [dc.steps_and_season(noon, w, use=train, periodic=True, factors=factors) for w in SHIFT_WEIGHTS]
    else:
        fits = yield many.each, [dc.steps_and_season_fits(noon, w, use=train) for w in SHIFT_WEIGHTS]
    error = [float(((noon - s - z)[test] ** 2).mean()) for s, z in fits]
    error = np.array(error)
    best = len(error) - 1
    if (error.max() - error.min()) / max(error.mean(), 1e-300) > 0.2 and error[-1] > error[0]:
        rise = np.diff(error)
        q1, q3 = np.quantile(rise, [0.25, 0.75])
        out = np.flatnonzero(rise > q3 + 1.5 * (q3 - q1))
        if len(out):
            best = int(out[0])
        else:
            near = error <= max(error.min() + max(0.02 * np.ptp(error), 0.02 * error.min()), 5e-3)
            best = int(np.flatnonzero(near)[-1])
    if periodic:
        s, z = dc.steps_and_season(noon, SHIFT_WEIGHTS[best], use=use, periodic=True)
    else:
        s, z = yield from dc.steps_and_season_fits(noon, SHIFT_WEIGHTS[best], use=use)
    d = np.where(np.abs(np.diff(s)) > 1e-4, np.diff(s), 0.0)
    # Steps over neighbouring days count as one at their last day.
    ends = np.flatnonzero((d != 0) & np.r_[d[1:] == 0, True])
    starts = np.flatnonzero((d != 0) & np.r_[True, d[:-1] == 0])
    at = [int(b) + 1 for a, b in zip(starts, ends) if abs(d[a : b + 1].sum()) >= 0.05]
    if at and not periodic:
        s, z = dc.steps_and_season(noon, use=use, transitions=at)
    base = s[0]
    if abs(base - 12) > 0.9 or np.isclose(s, base).mean() < 0.02:
        base = s[np.argmin(np.abs(s - 12))]
    shift = base - s
    roll = np.round((np.round(shift) if to_hours else shift) * slots / 24)
    if np.abs(roll).mean() < 0.01:
        roll[:] = 0
    return {"roll": roll, "shifted": bool((np.diff(roll) != 0).any()), "season_rms": float(np.sqrt((z**2).mean()))}


def clear_sky_labels(power: np.ndarray, clear: np.ndarray, low: float = 0.75, high: float = 1.2, cost: float = 0.1, change: float = 4.0) -> np.ndarray:
    """Clear times of one signal in order: inside the band around the clear-sky model, by the two-state forward costs."""
    with np.errstate(invalid="ignore"):
        inside = (power >= low * clear) & (power <= high * clear)
    unknown = ~np.isfinite(power) | ~np.isfinite(clear)
    cost_out = np.where(unknown, 1.0, np.where(inside, 1.0, cost))
    cost_in = np.where(unknown, 1.0, np.where(inside, cost, 1.0))
    out = np.zeros(len(power), bool)
    a = b = 0.0
    for i, (x, y) in enumerate(zip(cost_out.tolist(), cost_in.tolist())):
        a, b = min(a, b + change) + x, min(b, a + change) + y
        out[i] = b < a
    return out


#: Least and most samples, and changes that count as settled: of the last sample for the median and for both bounds, and of the last ten on average.
MC_LEAST, MC_MOST, MC_SETTLED, MC_WINDOW = 20, 500, (5e-3, 1e-2, 1e-2), 10
#: Samples that are fitted together after the first.
MC_AT_ONCE = 60


def unbiased_quantiles(x: np.ndarray, levels: tuple[float, ...]) -> np.ndarray:
    """Approximately median-unbiased quantiles of a sample."""
    n = len(x)
    return np.interp((n + 1 / 3) * np.array(levels) + 1 / 3 - 1, np.arange(n), np.sort(x))


def _quantiles_in_order(x: list[float], levels: tuple[float, ...]) -> list[float]:
    """``unbiased_quantiles`` of a sample in order."""
    out = []
    for level in levels:
        at = min(max((len(x) + 1 / 3) * level - 2 / 3, 0.0), len(x) - 1.0)
        i = min(int(at), max(len(x) - 2, 0))
        out.append(x[i] + (at - i) * (x[min(i + 1, len(x) - 1)] - x[i]))
    return out


def settled(states: np.ndarray) -> bool:
    """Whether median and 95 % bounds (percent a year), a row for each number of samples, moved by at most their limits with the last sample and, on average, with the last ten."""
    moves = np.abs(np.diff(states[-MC_WINDOW - 1 :], axis=0))
    limits = np.array(MC_SETTLED)
    return len(moves) >= MC_WINDOW and bool((moves[-1] <= limits).all() and (moves.mean(axis=0) <= limits).all())


def yearly_percent(rate: np.ndarray | float) -> np.ndarray | float:
    """The change of a year as a percentage of its end, from the slope of the logarithm."""
    return -100 * np.expm1(-rate)


def monte_carlo_rates(energy: np.ndarray, labels: np.ndarray, **options) -> dict[str, float]:
    """``monte_carlo_fits`` of one series."""
    return many.alone(monte_carlo_fits(energy, labels, **options))


def monte_carlo_fits(energy: np.ndarray, labels: np.ndarray, seed: int = 0, least: int = MC_LEAST, most: int = MC_MOST, use_days: np.ndarray | None = None, sparsity: float = 0.02, with_soiling: bool = True, **options):
    """Median and 95 % range of the degradation rate (of the logarithm, a year) over random quantile levels, soiling weights and held-out fifths of the days, and the number of samples; stops once they settle.

    A generator that yields its fits, some at a time: those after the sample that settles are not counted.
    ``use_days`` are the days that may be used at all; ``options`` are those of ``loss_problem``, the same for each sample.
    """
    rng = np.random.default_rng(seed)
    problem = dc.loss_problem(energy, labels, use=use_days, **options)
    good = np.flatnonzero(problem["ok"])
    rates: list[float] = []
    states: list[list[float]] = []
    while len(rates) < most:
        count = min(MC_AT_ONCE if rates else max(least, 1), most - len(rates))
        taus, weights, use = np.zeros(count), np.zeros(count), np.tile(problem["ok"], (count, 1))
        for i in range(count):
            taus[i], weights[i] = rng.uniform(0.85, 0.95), rng.uniform(0.1, 1.0)
            use[i, rng.choice(good, len(good) // 5, replace=False)] = False
        x, _ = yield dc.loss_fits, (problem, taus, weights, use, sparsity, with_soiling)
        first, end = problem["edges"][1:3]
        if not np.isfinite(x).all():
            raise ValueError("a fit of the degradation rate did not settle")
        for rate in (x[:, first] if end > first else np.zeros(count)).tolist():
            insort(rates, rate)
            states.append(_quantiles_in_order(rates, (0.5, 0.025, 0.975)))
            if len(rates) >= least and settled(yearly_percent(np.array(states[-MC_WINDOW - 1 :]))):
                break
        else:
            continue
        break
    middle, low, high = states[-1]
    return {"rate": float(middle), "low": float(low), "high": float(high), "samples": float(len(rates))}


def incidence_weights(latitude: np.ndarray, tilt: np.ndarray, azimuth: np.ndarray) -> np.ndarray:
    """Weights of sin(d), cos(d) cos(w) and cos(d) sin(w) in the cosine of incidence; angles in degrees."""
    la, b, g = np.radians(latitude), np.radians(tilt), np.radians(azimuth)
    return np.stack([np.sin(la) * np.cos(b) - np.cos(la) * np.sin(b) * np.cos(g), np.cos(la) * np.cos(b) + np.sin(la) * np.sin(b) * np.cos(g), np.sin(b) * np.sin(g)], axis=-1)


def best_angles(a: np.ndarray, b: np.ndarray, known: dict[str, float], bounds: dict[str, tuple[float, float]], points: int = 19, rounds: int = 60) -> dict[str, float]:
    """The unknown angles within their bounds whose incidence, times the best amplitude, has the least squared error, from the sums a (3 x 3) and b.

    A grid over all of them, then the best neighbour on ever finer ones.
    """
    free = [k for k in ("latitude", "tilt", "azimuth") if k not in known]
    low, high = (np.array([bounds[k][i] for k in free]) for i in (0, 1))

    def gain(x: np.ndarray) -> np.ndarray:
        at = {k: np.full(len(x), known[k]) if k in known else x[:, free.index(k)] for k in ("latitude", "tilt", "azimuth")}
        c = incidence_weights(at["latitude"], at["tilt"], at["azimuth"])
        fit = np.maximum(c @ b, 0)
        return fit**2 / np.maximum(np.einsum("ni,ij,nj->n", c, a, c), 1e-300)

    if not free:
        return dict(known)
    mesh = np.stack(np.meshgrid(*[np.linspace(lo, hi, points) for lo, hi in zip(low, high)], indexing="ij"), axis=-1).reshape(-1, len(free))
    best, step = mesh[int(np.argmax(gain(mesh)))], (high - low) / (points - 1)
    moves = np.stack(np.meshgrid(*[[-1, 0, 1]] * len(free), indexing="ij"), axis=-1).reshape(-1, len(free))
    for _ in range(rounds):
        near = np.clip(best + moves * step, low, high)
        values = gain(near)
        top = int(np.argmax(values))
        if values[top] > values[len(near) // 2]:
            best = near[top]
        else:
            step = step / 2
    return {**known, **{k: float(v) for k, v in zip(free, best)}}


def longitude(noon_minutes: np.ndarray, eot: np.ndarray, gmt_offset: float, loss: str = "l1") -> float:
    """Longitude from solar noons: median (l1), mean (l2) or Huber fit of the daily estimates."""
    each = (720 - noon_minutes - eot) / 4 + 15 * gmt_offset
    each = each[np.isfinite(each)]
    if len(each) == 0:
        return float("nan")
    if loss == "l1":
        return float(np.median(each))
    x = float(each.mean())
    if loss == "huber":
        for _ in range(100):
            # One hour of noon is fifteen degrees: the loss turns linear there.
            w = np.minimum(1, 15.0 / np.maximum(np.abs(each - x), 1e-12))
            new = float((w * each).sum() / w.sum())
            if abs(new - x) < 1e-12:
                break
            x = new
    return x


def huber_line(x: np.ndarray, y: np.ndarray, epsilon: float = 1.35, rounds: int = 50) -> tuple[float, float]:
    """Slope and intercept of the Huber line of y over x, by reweighting."""
    a = np.c_[x, np.ones(len(x))]
    beta = np.linalg.lstsq(a, y, rcond=None)[0]
    for _ in range(rounds):
        r = y - a @ beta
        s = 1.4826 * np.median(np.abs(r - np.median(r))) or 1e-12
        w = np.minimum(1, epsilon * s / np.maximum(np.abs(r), 1e-300))
        new = np.linalg.solve((a * w[:, None]).T @ a + 1e-12 * np.eye(2), (a * w[:, None]).T @ y)
        if np.abs(new - beta).max() < 1e-10:
            break
        beta = new
    return float(beta[0]), float(beta[1])


#: Rows (declinations) and columns (points of the daylight) for which the weights of the shade problem are stated.
SHADE_GRID = (47, 256)


def shade_components(matrix: np.ndarray, tau: float = 0.95, fit: float = 20.0, stiff: float = 1e3, smooth: float = 500.0, sparse: float = 0.3, mean: np.ndarray | None = None, prior: tuple[np.ndarray, np.ndarray] | None = None, iterations: int = 1500) -> tuple[np.ndarray, np.ndarray]:
    """(clear, loss) of a declination-by-time matrix, NaN where nothing is known: one joint problem.

    Least fit * pinball(x - clear + loss) + stiff |second differences of clear over declination|^2
    + smooth |second differences of loss along both axes|^2 + sparse sum(loss), with clear at
    least 0, concave over the declination and 0 at both ends of the day, loss at least 0.
    The weights hold for ``SHADE_GRID``; second differences of a coarser grid count by the
    fourth power of its width.  With a class prior, ``mean`` of a row and (eigenvalues,
    vectors), clear - mean is a sum of the vectors and 1/2 of its squares over the eigenvalues is added.
    """
    rows, cols = matrix.shape
    n = rows * cols
    scale = float(np.nanmax(np.abs(matrix))) or 1.0
    x, ok = np.nan_to_num(matrix / scale), np.isfinite(matrix)
    coarse = [(a / b) ** 4 for a, b in zip((rows, cols), SHADE_GRID)]
    bends = [np.diff(np.eye(k), 2, axis=0) if k > 2 else np.zeros((0, k)) for k in (rows, cols)]
    down, across = np.kron(bends[0].T @ bends[0], np.eye(cols)), np.kron(np.eye(rows), bends[1].T @ bends[1])
    p = np.zeros((2 * n, 2 * n))
    p[:n, :n] = 2 * stiff * coarse[0] * down
    p[n:, n:] = 2 * smooth * (coarse[0] * down + coarse[1] * across)
    q = np.r_[np.zeros(n), np.full(n, sparse)]
    if mean is not None and prior is not None:
        values, vectors = prior
        # What the vectors don't span is held at 0, what they do costs by their eigenvalues.
        each = vectors @ np.diag(1 / np.maximum(values, 1e-12)) @ vectors.T + 1e4 * (np.eye(cols) - vectors @ vectors.T)
        p[:n, :n] += np.kron(np.eye(rows), each)
        q[:n] -= np.kron(np.ones(rows), each @ (mean / scale))
    known = np.flatnonzero(ok.ravel())
    ends = np.zeros((rows, cols), bool)
    ends[:, [0, -1]] = True
    high = np.r_[np.where(ends.ravel(), 0.0, np.inf), np.full(n, np.inf)]

    def to_both(z: np.ndarray) -> np.ndarray:
        out = np.zeros(2 * n)
        out[known], out[n + known] = z, -z
        return out

    def bent(z: np.ndarray) -> np.ndarray:
        return np.r_[(bends[0].T @ z.reshape(-1, cols)).ravel(), np.zeros(n)]

    seen = np.zeros(n)
    seen[known] = 1.0
    apart, whole = np.kron(np.array([[1, -1], [-1, 1]]), np.diag(seen)), np.eye(2 * n)
    terms = [
        admm.Term(lambda v: v[known] - v[n + known], to_both, apart, admm.pinball(tau, fit, x.ravel()[known]), len(known)),
        admm.Term(lambda v: v, lambda z: z, whole, admm.within(0.0, high), 2 * n),
    ]
    if rows > 2:
        concave = np.zeros((2 * n, 2 * n))
        concave[:n, :n] = down
        terms.append(admm.Term(lambda v: (bends[0] @ v[:n].reshape(rows, cols)).ravel(), bent, concave, admm.at_most(0.0), (rows - 2) * cols))
    start = np.r_[np.where(ok, x, 0).ravel(), np.zeros(n)]
    both = admm.solve(p + 1e-9 * np.eye(2 * n), q, terms, rho=10.0, iterations=iterations, tolerance=1e-5, x0=start)
    clear, loss = np.clip(both[:n], 0, high[:n]).reshape(rows, cols), np.maximum(both[n:], 0).reshape(rows, cols)
    return clear * scale, loss * scale
