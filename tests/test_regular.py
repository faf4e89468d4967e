from datetime import date, datetime, timedelta

import numpy as np
import pytest

from sunloom.operators import regular

M = "row_id long, ts timestamp_ntz, site string, sensor string, meas_name string, meas_val_f double, received_at timestamp_ntz, day int, step string"
META = "site string, system string, power_column_label string, data_sampling double, time_shift_manual int, gmt_offset double, time_zone string, time_zone_correction int, revised_at timestamp_ntz"


def frames(spark, readings, sampling=None):
    m = spark.createDataFrame([(i, t, site, sensor, "p", v, t, 5, "x") for i, (site, sensor, t, v) in enumerate(readings)], M)
    meta = spark.createDataFrame([("s", k, "p", float(v), 0, 0.0, None, 0, datetime(2024, 1, 1)) for k, v in (sampling or {}).items()], META)
    return m, meta


def brute(readings, steps):
    want = set()
    for key in {r[:2] for r in readings}:
        own = [r for r in readings if r[:2] == key and r[2] is not None]
        if not own:
            continue
        a = datetime.combine(min(r[2] for r in own).date(), datetime.min.time())
        b = datetime.combine(max(r[2] for r in own).date() + timedelta(days=1), datetime.min.time())
        step = timedelta(minutes=steps[key[1]])
        taken = {int(np.floor((r[2] - a) / step + 0.5)) for r in own if r[3] is not None and r[3] == r[3]}
        n = int((b - a) / step)
        want |= {(*key, (a + i * step).strftime("%Y-%m-%d %H:%M:%S")) for i in range(n) if i not in taken}
    return want


def random_readings(rng):
    out = []
    for sensor, step in (("a", 5), ("b", 15), ("c", 60), (None, 30)):
        t = datetime(2022, 3, 1, 7)
        for _ in range(300):
            t += timedelta(minutes=step)
            if rng.random() < 0.05:
                t += timedelta(hours=float(rng.integers(1, 60)))
            jitter = timedelta(seconds=float(rng.uniform(-0.3, 0.3)) * step * 60)
            v = float("nan") if rng.random() < 0.03 else None if rng.random() < 0.03 else 1.0
            out += [("s", sensor, t + jitter, v)] * (2 if rng.random() < 0.05 else 1)
    return [out[i] for i in rng.permutation(len(out))]


def test_missing_slots_against_brute_force(spark):
    readings = random_readings(np.random.default_rng(1))
    got = regular.found(*frames(spark, readings, {"a": 300, "b": 60}))
    assert {(r.site, r.sensor, r.slot) for r in got.collect()} == brute(readings, {"a": 5, "b": 15, "c": 60, None: 30})


def test_sources_with_few_readings_take_the_declared_step(spark):
    day = datetime(2022, 1, 1)
    readings = [("s", "x", day + timedelta(hours=23, minutes=58), 1.0), ("s", "y", day, None), ("s", "z", day, 1.0)]
    got = regular.found(*frames(spark, readings, {"x": 30, "y": 900, "z": 7})).groupBy("sensor").count()
    # x: its only reading is nearest to the midnight after its last day.
    assert {r.sensor: r["count"] for r in got.collect()} == {"x": 48, "y": 96, "z": 23}


def test_reading_before_midnight_belongs_to_the_next_day(spark):
    day = datetime(2022, 1, 1)
    readings = [("s", "x", day + timedelta(minutes=58 + 60 * i), 1.0) for i in range(24)] + [("s", "x", day + timedelta(hours=40), 1.0)]
    got = {r.slot for r in regular.found(*frames(spark, readings)).collect()}
    assert "2022-01-02 00:00:00" not in got and "2022-01-01 00:00:00" in got and len(got) == 48 - 24 - 1


def test_rows_without_time_and_empty_tables(spark):
    m, meta = frames(spark, [("s", "x", None, 1.0)])
    assert regular.found(m, meta).count() == 0
    assert regular.found(m.limit(0), meta.limit(0)).count() == 0
    with pytest.raises(ValueError):
        regular.regular_series(m, meta, "cubic")


def test_series_fills_across_days(spark):
    day = datetime(2022, 1, 1)
    readings = [("s", "x", day + timedelta(hours=h), float(h)) for h in range(0, 12)] + [("s", "x", day + timedelta(hours=h), float(h)) for h in range(60, 70)]
    m, meta = frames(spark, readings)
    s = {r.slot: r for r in regular.regular_series(m, meta).collect()}
    assert len(s) == 72
    for h in range(0, 70):
        assert s[day + timedelta(hours=h)].filled == pytest.approx(h)
    assert s[day + timedelta(hours=30)].state == "missing" and s[day + timedelta(hours=71)].filled is None
    prev = {r.slot: r.filled for r in regular.regular_series(m, meta, "previous").collect()}
    assert prev[day + timedelta(hours=30)] == 11.0 and prev[day + timedelta(hours=71)] == 69.0


def test_series_and_missing_slots_agree(spark):
    m, meta = frames(spark, random_readings(np.random.default_rng(2)))
    a = {(r.site, r.sensor, r.slot) for r in regular.missing_slots(m, meta).collect()}
    b = {(r.site, r.sensor, r.slot) for r in regular.regular_series(m, meta).filter("state = 'missing'").collect()}
    assert a == b and isinstance(next(iter(a))[2], datetime) and isinstance(date.today(), date)
