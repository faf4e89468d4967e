"""Fits of many systems at once: as good as each for itself, at their optimum, and fast enough for fleets of short series."""

from __future__ import annotations

import time

import numpy as np

from sunloom.kernels import admm, detect, many
from sunloom.kernels import decompositions as dc
from sunloom.plans import pipeline


def fleet(count: int, m: int = 24):
    rng = np.random.default_rng(3)
    day = np.clip(np.sin((np.arange(m) * 24 / m - 6) / 12 * np.pi), 0, None)
    for i in range(count):
        n = int(rng.integers(3, 25))
        yield np.arange(n), [np.arange(m)] * n, [50 * day * (1 - rng.random() * rng.random(m) * 0.6) for _ in range(n)], m


def test_together_gives_what_each_system_gives_alone():
    systems = list(fleet(25))
    with np.errstate(all="ignore"):
        both = many.together([pipeline.analyse_fits(*s) for s in systems])
        for s, f in zip(systems[::6], both[::6]):
            one = many.alone(pipeline.analyse_fits(*s))
            assert np.allclose(one["sunrise"], f["sunrise"], atol=1e-5, equal_nan=True)
            assert all(np.array_equal(one.get(c), f.get(c)) for c in ("roll", "capacity_label", "clipped", "is_clear", "no_errors")) and one["undecided"] == f["undecided"]


def test_many_short_systems_take_little_time_each():
    systems = list(fleet(150))
    began = time.process_time()
    with np.errstate(all="ignore"):
        found = many.together([pipeline.analyse_fits(*s) for s in systems])
    assert not any(isinstance(f, Exception) for f in found)
    # Each for itself took seconds.
    assert (time.process_time() - began) / len(systems) < 0.3


def test_one_failure_does_not_end_the_others():
    def job(x):
        (fit,) = yield dc.quantiles, ([(np.array(x), 0.5, None)], 1.0, 3)
        return float(fit.mean())

    good, bad = many.together([job([1.0, 1.0, 1.0]), job("no numbers")])
    assert abs(good - 1) < 1e-6 and isinstance(bad, Exception)


def test_fits_are_at_their_optimum_in_short_series_with_gaps():
    rng = np.random.default_rng(1)
    b, p = dc.fourier(12, 3, constant=False), dc.fourier_weights(3, 1e-3, constant=False) ** 2
    for k in range(5):
        y, ok = 12 + np.r_[np.zeros(6), np.ones(6)] + 0.1 * rng.standard_normal(12), rng.random(12) < 0.8
        h = np.zeros((18, 18))
        h[:12, :12], h[:12, 12:] = 2 * np.diag(ok * 1.0), 2 * ok[:, None] * b
        h[12:, :12], h[12:, 12:] = h[:12, 12:].T, 2 * (b * ok[:, None]).T @ b + np.diag(p)
        q = np.r_[-2 * y * ok, -2 * b.T @ (y * ok)]
        value = lambda s, z: ((y - s - b @ z)[ok] ** 2).sum() + np.abs(np.diff(s)).sum() + 0.5 * (p * z * z).sum()
        s, z = dc.squared_steps([(y, ok, 3, p, np.ones(11))])[0]
        x = admm.solve(h, q, [admm.difference_term(12, 1, 0, 18, admm.soft(1.0))], rho=10.0, iterations=3000, tolerance=1e-7)
        # Splitting stops short of it: the waves of a year are almost the same over some days.
        assert value(s, z) <= value(x[:12], x[12:]) + 1e-9


def test_network_is_the_tridiagonal_solution():
    rng = np.random.default_rng(0)
    for n in (1, 2, 7, 50):
        c, g, r = rng.random((n, 3)), rng.random((n - 1, 3)) * 10, rng.random((n, 3, 2))
        d = np.diff(np.eye(n), axis=0)
        got = many.network(c, g, r)
        for k in range(3):
            assert np.allclose(got[:, k], np.linalg.solve(np.diag(c[:, k]) + d.T @ np.diag(g[:, k]) @ d, r[:, k]))


def test_pieces_between_given_ends_are_optimal():
    top = np.r_[np.random.default_rng(2).random(30) * 0.9, np.full(10, 0.9)]
    x = np.concatenate([[0.0], np.sort(top), [1.0]])
    y = np.interp(np.linspace(0, 1, detect.CDF_POINTS), x, np.linspace(0, 1, len(x)))
    fit = dc.linear_pieces(y, 5.0, 0.0, 1.0)
    # The dual: the residual's double sum is within the weight and at it where the fit bends.
    v = np.r_[0.0, 0.0, 2 * np.cumsum(np.cumsum((y - fit)[1:-1]))]
    v -= np.arange(len(y)) * v[-1] / (len(y) - 1)
    bends = np.diff(fit, 2)
    assert np.abs(v).max() <= 5 * (1 + 1e-5)
    assert np.allclose(v[1:-1][np.abs(bends) > 1e-9], 5 * np.sign(bends[np.abs(bends) > 1e-9]), atol=1e-3)


def test_bounded_pinball_is_at_its_optimum():
    rng = np.random.default_rng(5)
    for n in (4, 12, 40, 300):
        a = np.hstack([dc.fourier(n, 2), dc.sawteeth(n, 6)])
        y = 1 + 0.1 * rng.standard_normal(n)
        p, q = np.r_[0.0, np.full(4, 1e-2), np.full(a.shape[1] - 5, 1e-8)], np.r_[np.zeros(5), np.full(a.shape[1] - 5, 0.05)]
        low, high = np.r_[np.full(5, -np.inf), np.zeros(a.shape[1] - 5)], np.full(a.shape[1], np.inf)
        value = lambda x: (np.maximum(0.9 * (r := y - a @ x), -0.1 * r)).sum() + q @ x + 0.5 * (p * x * x).sum()  # noqa: E731, B023
        x = dc.bounded_pinball(a, y, 0.9, p, q, low, high)
        split = admm.solve(np.diag(p), q, [admm.dense_term(a, admm.pinball(0.9, 1.0, y)), admm.dense_term(np.eye(len(p)), admm.within(low, high))], rho=2.0, iterations=700, tolerance=2e-5)
        assert (x >= low).all() and value(x) <= value(np.clip(split, low, high)) + 1e-5


def test_products_are_their_columns():
    length, days = 9, 5
    basis, _ = dc.multi_periodic_basis(length * days, length, (3, 2))
    day = np.hstack([np.ones((length, 1)), basis[:length, 1::5]])
    wide = many.Products(day, dc.fourier(length * days, 2, dc.YEAR * length).reshape(days, length, -1).transpose(1, 0, 2))
    full = basis[np.arange(length * days).reshape(days, length).T.ravel()]
    rng = np.random.default_rng(0)
    z, v = rng.random((4, basis.shape[1])), rng.random((length * days, 4))
    assert np.allclose(wide.times(z), full @ z.T)
    assert np.allclose(wide.back(v), v.T @ full)
    assert np.allclose(wide.gram(v), np.einsum("nb,ni,nj->bij", v, full, full))
    assert (wide.top >= np.abs(full).max(axis=1) - 1e-12).all()


def test_quantiles_of_dilated_days_are_at_their_optimum_and_fast():
    rng = np.random.default_rng(4)
    length, bump = 101, np.sin(np.linspace(0, np.pi, 101))
    asked = []
    for n in rng.integers(1, 25, 60):
        y = (50 * bump * (1 - 0.7 * rng.random((n, length)) ** 3)).ravel()
        y[rng.random(len(y)) < 0.05] = np.nan
        asked.append((y, 0.9, length, (8, 2), 0.1))
    began = time.process_time()
    found = dc.multi_periodic_quantiles(asked)
    took, earlier = time.process_time() - began, 0.0
    for (y, level, *_), fit in list(zip(asked, found))[::6]:
        basis, weight = dc.multi_periodic_basis(len(y), length, (8, 2))
        ok, p = np.isfinite(y), (0.1 * weight) ** 2 + 1e-9
        began = time.process_time()
        x = admm.smooth_pinball(basis[ok], y[ok], level, np.diag(p), np.r_[np.quantile(y[ok], level), np.zeros(len(p) - 1)], least=1e-4)
        earlier += 6 * (time.process_time() - began)
        z = np.linalg.solve(basis.T @ basis + 1e-9 * np.diag(p), basis.T @ fit)
        value = lambda f, x: np.maximum(level * (r := (y - f)[ok]), (level - 1) * r).sum() + 0.5 * p @ (x * x)  # noqa: E731, B023
        assert value(fit, z) <= value(basis @ x, x) * (1 + 1e-6) + 1e-9
    assert took < earlier / 1.5


def test_soiling_is_at_the_optimum_of_each_pass_and_fast():
    rng = np.random.default_rng(6)
    signals = [1 - 0.01 * (np.arange(n) % 9) + 0.02 * rng.standard_normal(n) for n in (1, 2, 3, 5, 8, 17, 40, 70, *rng.integers(4, 30, 30))]
    signals[6][10:14] = np.nan

    def value(y, w, s, c, slope):
        n, bends = len(y), np.roll(c, -1) - 2 * c + np.roll(c, 1)
        r = y - s - c[np.arange(n) % len(c)] - slope * np.arange(n) / 365
        return np.nansum(np.maximum(0.85 * r, -0.15 * r)) + 0.02 * n * np.linalg.norm(bends) - 1e-3 * s.sum() + 0.45 * np.abs(np.diff(s)).sum() + (w * np.abs(np.diff(s, 2))).sum()

    def split(y, w, iterations):
        n, ok = len(y), np.isfinite(y)
        size = 2 * n + 1
        a = np.hstack([np.eye(n), np.eye(n), np.arange(n)[:, None] / 365])[ok]
        season = np.hstack([np.zeros((n, n)), np.roll(np.eye(n), -1, axis=1) - 2 * np.eye(n) + np.roll(np.eye(n), 1, axis=1), np.zeros((n, 1))])
        terms = [admm.dense_term(a, admm.pinball(0.85, 1.0, y[ok])), admm.dense_term(season, admm.norm2(0.02 * n)), admm.dense_term(np.eye(n, size), admm.at_most(0.0))]
        terms += [admm.difference_term(n, 1, 0, size, admm.soft(0.45)), admm.difference_term(n, 2, 0, size, admm.soft(w))]
        x = admm.solve(1e-8 * np.eye(size), np.r_[np.full(n, -1e-3), np.zeros(n + 1)], terms, iterations=iterations, tolerance=1e-9, x0=np.r_[np.zeros(n), np.full(n, np.nanquantile(y, 0.85)), 0.0])
        return np.minimum(x[:n], 0), x[n:-1], x[-1]

    for y in signals[3:7]:
        w = np.full(len(y) - 2, 2.0)
        for _ in range(2):
            found = dc.soiling_passes([(y, 0.85, w, 1e-3, 0.45, 0.02 * len(y))])[0]
            assert (found[0] <= 0).all() and value(y, w, *found) <= value(y, w, *split(y, w, 2000)) + 1e-5 * len(y)
            w = 2 / (0.01 + 100 * np.abs(np.diff(found[0], 2)))
    began = time.process_time()
    both = many.together([dc.soiling_fits(y) for y in signals])
    # Each took a third of a second.
    assert (time.process_time() - began) / len(signals) < 0.08
    for y, f in list(zip(signals, both))[::7]:
        one = dc.soiling(y)
        assert all(np.isfinite(f[k]).all() and len(f[k]) == len(y) for k in f)
        assert np.allclose(one["soiling"] + one["season"] + one["trend"], f["soiling"] + f["season"] + f["trend"], atol=2e-3)


def test_five_bands_by_blocks_are_the_solution():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 64, 65, 97, 130):
        d0, d1, d2, right = 6 + rng.random((2, n)), rng.random((2, n - 1)), rng.random((2, max(n - 2, 0))), rng.random((2, n, 3))
        for k, x in enumerate(dc._five_bands(d0, d1, d2, right)):
            h = np.diag(d0[k]) + np.diag(d1[k], 1) + np.diag(d1[k], -1) + (np.diag(d2[k], 2) + np.diag(d2[k], -2) if n > 2 else 0)
            assert np.allclose(x, np.linalg.solve(h, right[k]))


def test_soiling_teeth_are_those_of_30_waves_in_two_phases():
    b, spans = dc.soiling_teeth(730)
    # The constant, and k teeth of k periods, cut at their tops; half a period more in the other phase.
    assert (b[:, 0] == -1).all() and b.max() <= 0 and b.min() == -1
    assert 2 * sum(range(2, 32)) <= b.shape[1] <= 1 + 2 * sum(range(2, 32)) + 60
    assert all((b[:lo, j] == 0).all() and (b[hi:, j] == 0).all() for j, (lo, hi) in enumerate(spans))
    whole = b[:, [lo == 0 and 360 < hi < 370 for lo, hi in spans]]
    assert whole.shape[1] == 1 and np.allclose(np.diff(whole[:364, 0]), -2 / 729)


def test_loss_fits_are_at_their_optimum_alone_and_together():
    rng = np.random.default_rng(8)
    asked = []
    for n in (1, 4, 9, 9, 16, 25):
        energy = np.exp(3 + 0.1 * rng.standard_normal(n) - 0.03 * (np.arange(n) % 7))
        labels = (np.arange(n) >= 5).astype(int) * (n > 4)
        use = rng.random((3, n)) < 0.8
        use[:, 0] = True
        asked.append((dc.loss_problem(energy, labels), rng.uniform(0.85, 0.95, 3), rng.uniform(0.1, 1.0, 3), use, 0.02, True))
    found = dc.loss_fits(asked)
    for a, (x, s) in zip(asked, found):
        problem, n = a[0], len(a[0]["log"])
        b, f = dc.soiling_teeth(n)[0], problem["f"]
        k, m = b.shape[1], f.shape[1]
        assert (s <= 0).all() and (x[:, problem["below"]] <= 0).all()
        for i in range(3):
            ok = a[3][i]
            size = k + m
            p, q = np.r_[np.zeros(k), problem["p"]], np.r_[-0.02 * b.sum(axis=0), problem["q"]]
            terms = [admm.dense_term(np.hstack([b, f])[ok], admm.pinball(a[1][i], 1.0, problem["log"][ok])), admm.dense_term(np.eye(k, size), admm.soft(a[2][i])), admm.dense_term(np.hstack([b, np.zeros((n, m))]), admm.at_most(0.0))]
            if problem["below"].any():
                terms.append(admm.dense_term(np.eye(m, size, k)[problem["below"]], admm.at_most(0.0)))
            v = admm.solve(np.diag(p + 1e-12), q, terms, rho=1.0, iterations=4000, tolerance=1e-9)
            z, c = v[:k], v[k:]
            c[problem["below"]] = np.minimum(c[problem["below"]], 0)
            over = max((b @ z).max(), 0.0)
            z = z + np.r_[over, np.zeros(k - 1)]
            tail = lambda r, i=i: np.maximum(a[1][i] * r, (a[1][i] - 1) * r).sum()  # noqa: E731, B023
            split = tail((problem["log"] - b @ z - f @ c)[ok]) + a[2][i] * np.abs(z).sum() - 0.02 * (b @ z).sum() + 0.5 * problem["p"] @ (c * c) + problem["q"] @ c
            lone = tail((problem["log"] - s[i] - f @ x[i])[ok]) - 0.02 * s[i].sum() + 0.5 * problem["p"] @ (x[i] ** 2) + problem["q"] @ x[i]
            # The cheapest teeth that make the soiling that was found.
            z = admm.solve(1e-9 * np.eye(k), np.zeros(k), [admm.dense_term(b, admm.within(s[i] - 1e-6, s[i] + 1e-6)), admm.dense_term(np.eye(k), admm.soft(1.0))], rho=10.0, iterations=6000, tolerance=1e-9)
            assert np.abs(b @ z - s[i]).max() < 1e-6 and lone + a[2][i] * np.abs(z).sum() <= split + 1e-6
        alone = dc.loss_fits([a])[0]
        assert np.allclose(alone[1], s, atol=1e-4)


def test_monte_carlo_rates_settle_as_one_by_one():
    rng = np.random.default_rng(2)
    energy = np.exp(3 + 0.001 * rng.standard_normal(24) - 0.3 * np.arange(24) / 365)
    got = detect.monte_carlo_rates(energy, np.zeros(24, int), most=70)
    one, rates = np.random.default_rng(0), []
    problem = dc.loss_problem(energy)
    states = []
    while len(rates) < 70:
        tau, weight, use = one.uniform(0.85, 0.95), one.uniform(0.1, 1.0), np.ones((1, 24), bool)
        use[0, one.choice(24, 4, replace=False)] = False
        rates.append(dc.loss_fits([(problem, np.array([tau]), np.array([weight]), use, 0.02, True)])[0][0][0, problem["edges"][1]])
        states.append(detect.unbiased_quantiles(np.array(rates), (0.5, 0.025, 0.975)))
        moves = np.abs(np.diff(detect.yearly_percent(np.array(states)), axis=0))
        if len(rates) >= 20 and (moves[-1] <= [5e-3, 1e-2, 1e-2]).all() and (moves[-10:].mean(axis=0) <= [5e-3, 1e-2, 1e-2]).all():
            break
    assert got["samples"] == len(rates) and np.allclose([got["rate"], got["low"], got["high"]], states[-1], atol=1e-4)
    # Of the value at the year's end.
    assert abs(detect.yearly_percent(np.log(0.98)) + 100 * 0.02 / 0.98) < 1e-9


def test_many_loss_fits_take_little_time_each():
    rng = np.random.default_rng(3)
    asked = [(dc.loss_problem(np.exp(3 + 0.1 * rng.standard_normal(n))), rng.uniform(0.85, 0.95, 60), rng.uniform(0.1, 1.0, 60), rng.random((60, n)) < 0.8, 0.02, True) for n in rng.integers(4, 25, 20)]
    began = time.process_time()
    found = dc.loss_fits(asked)
    assert (time.process_time() - began) / (60 * len(found)) < 0.01
    assert all(np.isfinite(x).all() and np.isfinite(s).all() for x, s in found)
