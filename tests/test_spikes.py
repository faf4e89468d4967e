from datetime import datetime, timedelta

import numpy as np

from sunloom.kernels import hampel
from sunloom.operators import spikes

M = "row_id long, ts timestamp_ntz, site string, sensor string, meas_val_f double, v string, block int"
P = "row_id long, ts timestamp_ntz, site string, system string, p_mp double, v_oc double, t int"


def days(rng, n=12, step=15, ceiling=None, night=0.0, cut=None):
    """Times in minutes and readings of a source with weather, and the places of planted cases."""
    t = np.arange(0, n * 1440, step).astype(float)
    h = t % 1440 / 60
    clear = np.clip(np.cos((h - 12) / 6 * np.pi / 2), 0, None) * (np.abs(h - 12) < 6) * 1000
    cloud = np.where(rng.random(len(t)) < 0.5, 1.0, rng.uniform(0.35, 1, len(t)))
    v = np.round(clear * cloud * (1 + 0.003 * rng.standard_normal(len(t))), 1)
    if cut:
        v = np.where(t > cut * 1440, np.round(v * 0.6, 1), v)
    if ceiling:
        v = np.minimum(v, ceiling)
    return t, np.where(clear > 0, v, night)


def test_planted_cases_are_found_and_nothing_else():
    rng = np.random.default_rng(0)
    for kind in ({}, {"ceiling": 600.0}, {"night": -2.0}, {"cut": 6}):
        t, v = days(rng, **kind)
        want = np.zeros(len(v), bool)
        noon = np.flatnonzero(np.abs(t % 1440 - 720) < 180)
        for i, f in zip(rng.choice(noon, 6, replace=False), (4, 7, 0.02, 0.01, -1, 300)):
            v[i] = np.round(max(v[i], 200) * f, 1)
            want[i] = True
        a = noon[np.searchsorted(noon, 5 * 96 + 44)]
        v[a : a + 9] = 321.7  # below any ceiling
        want[a : a + 9] = True
        got = hampel.power_flags((t * 60e6).astype(np.int64), v)
        assert set(np.flatnonzero(got)) ^ set(np.flatnonzero(want)) <= set(range(a - 1, a + 10)), kind
        assert got[a : a + 9].all()


def test_pieces_change_nothing(monkeypatch):
    t, v = days(np.random.default_rng(2))
    v[::53] *= 5
    t = (t * 60e6).astype(np.int64)
    whole = hampel.power_flags(t, v)
    monkeypatch.setattr(hampel, "TOGETHER", 50)
    assert whole.any() and (hampel.power_flags(t, v) == whole).all()


def test_kernels_at_the_edges():
    none = hampel.power_flags(np.zeros(0, np.int64), np.zeros(0))
    assert len(none) == 0 and len(hampel.fit_flags(np.zeros(0, np.int64), np.zeros(0))) == 0
    t = np.array([0, 0, 60_000_000], np.int64)
    assert hampel.power_flags(t, np.array([1.0, 1.0, 1.0])).sum() == 0
    with np.errstate(all="ignore"):
        assert hampel.power_flags(t, np.array([1.0, np.inf, 1.0])).tolist() == [False, True, False]
        assert hampel.fit_flags(np.arange(20) * 7 * 86_400_000_000, np.r_[np.linspace(300, 310, 10), -305.0, 600.0, np.linspace(310, 300, 8)]).nonzero()[0].tolist() == [10, 11]
    week = np.arange(30) * 7 * 86_400_000_000
    v = 300 + np.sin(np.arange(30))
    v[10:16] = v[10]
    assert hampel.fit_flags(week, v).nonzero()[0].tolist() == list(range(10, 16))


def test_operator_over_blocks_against_one_call(spark):
    rng = np.random.default_rng(3)
    start, data, want = datetime(2022, 1, 1), [], set()
    for sensor in ("a", "b"):
        t, v = days(rng, n=70, step=60)
        for i in rng.choice(np.flatnonzero(np.abs(t % 1440 - 720) < 120), 12, replace=False):
            v[i] = np.round(max(v[i], 100) * 6, 1)
        base = len(data)
        data += [(base + i, start + timedelta(minutes=float(m)), "s", sensor, float(x), "clash", 1) for i, (m, x) in enumerate(zip(t, v))]
        want |= {base + i for i in np.flatnonzero(v > 1200)}
    extra = [(10_000, None, "s", "a", 5e9, "", 1), (10_001, start, "s", "a", None, "", 1), (10_002, start, "s", "a", float("nan"), "", 1), (None, start, "s", "a", 5e9, "", 1), (10_003, start + timedelta(days=1), "s", "a", float("inf"), "", 1), (10_004, start, None, None, 5.0, "", 1)]
    m = spark.createDataFrame([data[i] for i in rng.permutation(len(data))] + extra, M).repartition(5)
    f = spark.createDataFrame([(i, start + timedelta(days=7 * i), "s", "a", 100.0 + i % 3 if i != 9 else 900.0, 30.0 + i % 2 if i != 4 else 0.0, 1) for i in range(40)], P)
    got = {(r.tab, r.row_id, r.field) for r in spikes.found(m, f).collect()}
    assert got == {("measurements", i, "meas_val_f") for i in want | {10_003}} | {("pvpro_results", 9, "p_mp"), ("pvpro_results", 4, "v_oc")}


def test_it_does_not_matter_where_blocks_start(spark):
    rng = np.random.default_rng(8)
    start, data, fits = datetime(2022, 1, 1), [], []
    for sensor, kind in (("a", {}), ("b", {"ceiling": 600.0}), ("c", {"cut": 60})):
        t, v = days(rng, n=130, step=30, **kind)
        noon = np.flatnonzero(np.abs(t % 1440 - 720) < 180)
        for i, f in zip(rng.choice(noon, 60, replace=False), np.tile([4, 7, 0.02, 0.01, -1, 300], 10)):
            v[i] = np.round(max(v[i], 200) * f, 1)
        for k in range(8):
            a = noon[int(rng.integers(0, len(noon) - 12))]
            v[a : a + 6] = 321.7
        gone = rng.random(len(t)) < 0.1
        data += [(len(data) + i, start + timedelta(minutes=float(m)), "s", sensor, float(x), "", 1) for i, (m, x) in enumerate(zip(t[~gone], v[~gone]))]
    for w in range(400):
        fits.append((w, start + timedelta(days=7 * w), "s", "a", float(100 + rng.normal() + (40 if w % 37 == 0 else 0)), float(30 - w / 100 + rng.normal() / 10), 1))
    m, f = spark.createDataFrame(data, M).cache(), spark.createDataFrame(fits, P)
    got = [{(r.field, r.row_id) for r in spikes.flag_readings(m, f, origin).collect()} for origin in (0, 13, 31)]
    assert got[0] == got[1] == got[2]
    assert sum(1 for x, _ in got[0] if x == "meas_val_f") > 150 and {i for x, i in got[0] if x == "p_mp"} >= {w for w in range(400) if w % 37 == 0}


def test_all_readings_of_a_slot_count():
    t, v = days(np.random.default_rng(9), step=5)
    t, v = np.repeat(t, 3) + np.tile([0.0, 0.1, 0.2], len(t)), np.repeat(v, 3)
    # The last reading of each slot is a poor one; the two others tell what is usual.
    v[2::3] = np.where(v[2::3] > 0, 1.0, v[2::3])
    got = hampel.power_flags((t * 60e6).astype(np.int64), v)
    noon = np.abs(t % 1440 - 720) < 120
    assert got[2::3][noon[2::3]].mean() > 0.95 and got[0::3].sum() == got[1::3].sum() == 0


def test_repeated_rows_and_empty_tables(spark):
    rng = np.random.default_rng(5)
    t, v = days(rng, n=8)
    i = int(np.flatnonzero(t == 3 * 1440 + 720)[0])
    v[i] = 9000.0
    start = datetime(2022, 1, 1)
    data = [(k, start + timedelta(minutes=float(m)), "s", "a", float(x), "", 1) for k, (m, x) in enumerate(zip(t, v))]
    m = spark.createDataFrame([*data, (99_999, *data[i][1:])], M)
    assert {r.row_id for r in spikes.flag_readings(m, None).collect()} == {i, 99_999}
    empty = spark.createDataFrame([], P)
    assert spikes.found(m.limit(0), empty).count() == 0
