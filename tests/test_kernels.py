import numpy as np
import pytest

from sunloom.kernels import admm, detect
from sunloom.kernels import decompositions as dc


def pinball(r, tau):
    return float(np.sum(np.where(r > 0, tau * r, (tau - 1) * r)))


def test_smooth_quantile_is_optimal():
    rng = np.random.default_rng(0)
    y = 5 + np.cos(np.arange(400) * 2 * np.pi / 365) + rng.standard_normal(400)
    y[10:20] = np.nan
    ok = np.isfinite(y)
    q = dc.smooth_quantile(y, 0.8)
    b, w = dc.fourier(400, 3), dc.fourier_weights(3, 1e-3)
    z = np.linalg.lstsq(b, q, rcond=None)[0]
    value = lambda z: pinball(y[ok] - b[ok] @ z, 0.8) + 0.5 * ((w * z) ** 2).sum()
    for _ in range(200):
        assert value(z) <= value(z + rng.standard_normal(7) * 10.0 ** rng.uniform(-5, -1)) + 1e-7
    assert abs((y[ok] < q[ok]).mean() - 0.8) < 0.03


def test_steps_and_season_recovers_planted_steps():
    rng = np.random.default_rng(1)
    n = 500
    s = np.where(np.arange(n) < 180, 12.0, np.where(np.arange(n) < 320, 13.0, 12.0))
    y = s + 0.2 * np.cos(np.arange(n) * 2 * np.pi / dc.YEAR) + 0.03 * rng.standard_normal(n)
    y[rng.choice(n, 40, replace=False)] = np.nan
    got, season = dc.steps_and_season(y, 5.0)
    # A step next to an unknown day may lie on either side of it.
    at = np.flatnonzero(np.abs(np.diff(got)) > 0.2)
    assert {179, 319} <= set(at) | {i - 1 for i in at} and set(at) <= {178, 179, 180, 318, 319, 320}
    assert got[250] > got[100] + 0.3 and got[250] > got[400] + 0.3
    exact, season = dc.steps_and_season(y, transitions=[180, 320])
    assert np.allclose(exact - exact[0], s - s[0], atol=0.05)
    p, _ = dc.steps_and_season(np.tile(np.r_[np.zeros(100), np.ones(265)], 2) + 0.01 * rng.standard_normal(730), 1.0, periodic=True)
    assert np.allclose(p[:365], p[365:])


def test_linear_pieces_is_optimal_and_keeps_its_ends():
    rng = np.random.default_rng(2)
    y = np.sort(rng.random(60))
    x = dc.linear_pieces(y, 0.3, 0.0, 1.0)
    assert x[0] == 0 and x[-1] == 1
    value = lambda x: ((np.r_[0.0, y[1:-1], 1.0] - x) ** 2).sum() + 0.3 * np.abs(np.diff(x, 2)).sum()
    for _ in range(300):
        step = np.r_[0, rng.standard_normal(58), 0] * 10.0 ** rng.uniform(-6, -2)
        assert value(x) <= value(x + step) + 1e-8
    assert np.allclose(dc.linear_pieces(np.arange(5.0), 5.0), np.arange(5.0), atol=1e-6)
    assert dc.linear_pieces(np.array([1.0, 2.0])).tolist() == [1.0, 2.0]


def test_steps_season_trend_and_capacity_labels():
    rng = np.random.default_rng(3)
    n = 500
    level = np.where(np.arange(n) < 250, 1.0, 0.7)
    top = 10 * level * (1 + 0.2 * np.cos(np.arange(n) * 2 * np.pi / 365)) * np.exp(0.01 * rng.standard_normal(n)) * np.where(rng.random(n) < 0.3, rng.uniform(0.5, 1, n), 1)
    f = dc.steps_season_trend(np.log(top), 10.0)
    jumps = np.flatnonzero(np.abs(np.diff(f["steps"])) > 0.05)
    assert len(jumps) == 1 and abs(jumps[0] - 249) <= 2
    assert detect.capacity_steps(top[:10], np.ones(10, bool)).tolist() == [0] * 10


def test_admm_solves_a_small_lasso():
    rng = np.random.default_rng(4)
    a, y = rng.standard_normal((40, 5)), rng.standard_normal(40)
    x = admm.solve(a.T @ a, -a.T @ y, [admm.dense_term(np.eye(5), admm.soft(3.0))], tolerance=1e-9)
    g = a.T @ (y - a @ x)
    assert np.all(np.abs(g) <= 3.0 + 1e-4) and np.allclose(g[np.abs(x) > 1e-6], 3 * np.sign(x[np.abs(x) > 1e-6]), atol=1e-3)
    d = admm.difference_term(6, 2, 1, 8, admm.soft(1.0))
    v, z = rng.standard_normal(8), rng.standard_normal(4)
    assert np.isclose(d.apply(v) @ z, v @ d.adjoint(z))
    assert np.allclose(d.gram, np.array([d.adjoint(d.apply(e)) for e in np.eye(8)]).T)
    assert np.allclose(admm.norm2(1.0)(np.array([0.3, 0.4]), 1.0), 0)


def test_dbscan_against_components_of_core_points():
    rng = np.random.default_rng(5)
    p = np.vstack([rng.normal(0, 0.01, (30, 2)), rng.normal(1, 0.01, (20, 2)), [[5, 5]]])
    labels = detect.dbscan(p, 0.1, 3)
    assert set(labels[:30]) == {0} and set(labels[30:50]) == {1} and labels[50] == -1
    assert detect.dbscan(np.zeros((0, 2))).tolist() == []


def test_point_masses_clipping_and_shifts():
    rng = np.random.default_rng(6)
    top = np.r_[rng.uniform(0.1, 0.8, 150), np.full(80, 0.8) + rng.normal(0, 1e-4, 80), [1.0]]
    assert any(abs(x - 0.8) < 0.01 for x in detect.point_masses(top))
    c = detect.clipping(top, np.r_[np.full(150, 0.05), np.full(80, 0.4), 0.05], np.ones(231, bool))
    assert c["inverter_clipping"] and c["days"][150:230].mean() > 0.9 and c["days"][:150].sum() < 8
    noon = np.where((np.arange(300) >= 100) & (np.arange(300) < 200), 13.0, 12.0) + 0.02 * rng.standard_normal(300)
    r = detect.clock_shifts(noon, np.ones(300, bool), 48)
    assert r["shifted"] and set(r["roll"][105:195]) == {-2.0} and set(r["roll"][:95]) == {0.0}
    assert not detect.clock_shifts(12 + 0.02 * rng.standard_normal(300), np.ones(300, bool), 48)["shifted"]


def test_location_fits():
    assert detect.longitude(np.full(5, 740.0), np.zeros(5), -5.0) == pytest.approx(-80.0)
    x = np.r_[np.full(9, 740.0), 100.0]
    assert abs(detect.longitude(x, np.zeros(10), -5.0, "huber") + 80) < 2 < abs(detect.longitude(x, np.zeros(10), -5.0, "l2") + 80)
    assert np.isnan(detect.longitude(np.array([np.nan]), np.zeros(1), 0.0))
    rng = np.random.default_rng(7)
    d, w, la, b, g = rng.uniform(-23, 23, 200), rng.uniform(-60, 60, 200), 37.5, np.radians(22.5), np.radians(15.0)
    rd, rw, rl = np.radians(d), np.radians(w), np.radians(la)
    c = np.sin(rd) * np.sin(rl) * np.cos(b) - np.sin(rd) * np.cos(rl) * np.sin(b) * np.cos(g) + np.cos(rd) * np.cos(rl) * np.cos(b) * np.cos(rw) + np.cos(rd) * np.sin(rl) * np.sin(b) * np.cos(g) * np.cos(rw) + np.cos(rd) * np.sin(b) * np.sin(g) * np.sin(rw)
    q = np.stack([np.sin(rd), np.cos(rd) * np.cos(rw), np.cos(rd) * np.sin(rw)], axis=1)
    got = detect.best_angles(q.T @ q, q.T @ c, {"latitude": la}, {"latitude": (-90.0, 90.0), "tilt": (0.0, 90.0), "azimuth": (-180.0, 180.0)})
    tilt, azimuth = got["tilt"], got["azimuth"]
    assert tilt == pytest.approx(22.5, abs=0.01) and azimuth == pytest.approx(15.0, abs=0.01)
    slope, cut = detect.huber_line(np.arange(50.0), np.r_[3 * np.arange(49.0) + 1, 1e4])
    assert slope == pytest.approx(3, abs=0.05) and cut == pytest.approx(1, abs=0.5)


def test_two_state_labels_by_prefix_products():
    rng = np.random.default_rng(8)
    p = np.where(np.arange(120) // 30 % 2 == 0, 1.0, 0.3) + 0.01 * rng.standard_normal(120)
    p[5] = np.nan
    got = detect.clear_sky_labels(p, np.ones(120))
    inside = (p >= 0.75) & (p <= 1.2)
    out_c, in_c = np.where(np.isnan(p), 1, np.where(inside, 1, 0.1)), np.where(np.isnan(p), 1, np.where(inside, 0.1, 1))
    m = np.zeros((2, 2)) + np.array([[0, np.inf], [np.inf, 0]])
    for i, (a, b) in enumerate(zip(out_c, in_c)):
        step = np.array([[a, b + 4], [a + 4, b]])
        m = np.min(m[:, :, None] + step[None, :, :], axis=1)
        assert got[i] == (m[:, 1].min() < m[:, 0].min() - 1e-12) or np.isclose(m[:, 1].min(), m[:, 0].min())


def test_loss_soiling_and_other_decompositions():
    rng = np.random.default_rng(9)
    n = 400
    e = 50 * (1 + 0.2 * np.cos(np.arange(n) * 2 * np.pi / 365)) * np.exp(-0.03 * np.arange(n) / 365) * np.exp(0.01 * rng.standard_normal(n))
    f = dc.loss_factors(e, np.zeros(n, int), with_soiling=False)
    total = f["baseline"] + f["degradation"] + f["soiling"] + f["capacity"] + f["weather"]
    assert np.allclose(total, np.log(e)) and -0.08 < f["rate"][0] < 0.0
    assert dc.loss_factors(e, rate=-0.02, with_soiling=False)["rate"][0] == pytest.approx(-0.02)
    s = dc.soiling(np.ones(120) + 0.001 * rng.standard_normal(120))
    assert (s["soiling"] <= 0).all() and s["soiling"].min() > -0.05
    p = dc.pvpro_components(1 + 0.05 * np.cos(np.arange(156) * 2 * np.pi / 52) - 0.01 * np.arange(156) / 52)
    assert np.nanmax(np.abs(p["residual"])) < 0.05 and (p["trend"][-1] - p["trend"][0]) < 0
    q = dc.smooth_quantiles(rng.random(20 * 12), [0.2, 0.8], 20, (4, 1))
    assert (q[0.8] >= q[0.2] - 1e-9).all()
    th = dc.periodic_threshold(np.r_[rng.random(100)], 0.5, 10.0)
    assert 0.2 < th.mean() < 0.8
    clear, loss = detect.shade_components(rng.random((12, 8)))
    assert (clear[:, 0] == 0).all() and (loss >= 0).all()
