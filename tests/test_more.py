from datetime import date, datetime, timedelta
from zoneinfo import ZoneInfo

import numpy as np
import pytest
from pyspark.sql import functions as F

from sunloom import session
from sunloom.kernels import decompositions as dc
from sunloom.kernels import detect
from sunloom.operators import rebin, tables, timeaxis
from sunloom.plans import studies
from sunloom.sources import readers


def test_planted_orientation_is_found(spark):
    rng = np.random.default_rng(0)
    rows, days = [], []
    for system, tilt, azimuth in (("a", 22.0, -15.0), ("b", 35.0, 40.0)):
        for d in range(0, 360, 6):
            day = date(2021, 1, 1) + timedelta(days=d)
            b = 2 * np.pi * (day.timetuple().tm_yday - 1) / 365
            dec = np.degrees(0.006918 - 0.399912 * np.cos(b) + 0.070257 * np.sin(b) - 0.006758 * np.cos(2 * b) + 0.000907 * np.sin(2 * b) - 0.002697 * np.cos(3 * b) + 0.00148 * np.sin(3 * b))
            eot = 229.2 * (0.000075 + 0.001868 * np.cos(b) - 0.032077 * np.sin(b) - 0.014615 * np.cos(2 * b) - 0.04089 * np.sin(2 * b))
            w = 15 * (np.arange(24) + eot / 60 - 12)
            la, de, om = np.radians(37.0), np.radians(dec), np.radians(w)
            q = np.stack([np.full(24, np.sin(de)), np.cos(de) * np.cos(om), np.cos(de) * np.sin(om)], axis=1)
            v = 5 * q @ detect.incidence_weights(37.0, tilt, azimuth) + 0.01 * rng.normal(size=24)
            up = np.sin(la) * np.sin(de) + np.cos(la) * np.cos(de) * np.cos(om)
            v = np.where(up > 0, np.maximum(v, 0), 0)
            rows += [(system, day, i, float(x)) for i, x in enumerate(v)]
            days.append((system, day, float(v.max()), True, False, 37.0))
    obs = spark.createDataFrame(rows, "system_id string, day date, slot int, value double")
    results = spark.createDataFrame(days, "system_id string, day date, top double, is_clear boolean, clipped boolean, lat double")
    for latitude in (37.0, "lat"):
        got = {r.system_id: (r.tilt, r.azimuth) for r in studies.orientation(obs, results, 24, latitude, -120.0, -8.0).collect()}
        assert got["a"] == pytest.approx((22, -15), abs=0.3) and got["b"] == pytest.approx((35, 40), abs=0.3)
    sums = studies.sun_sums(obs, results, 24, -120.0, -8.0).withColumns({"la": F.lit(37.0), "ti": F.when(F.col("system_id") == "a", 22.0).otherwise(35.0), "az": F.when(F.col("system_id") == "a", -15.0).otherwise(40.0)})
    for known, name, want in ((("la", "ti", None), "azimuth", (-15, 40)), (("la", None, "az"), "tilt", (22, 35)), ((None, "ti", "az"), "latitude", (37, 37)), (("la", None, None), "tilt", (22, 35))):
        found = {r.system_id: r[name] for r in studies.orientation_with(sums, *known).collect()}
        assert (found["a"], found["b"]) == pytest.approx(want, abs=0.5), (known, name)
    study = studies.best_first(studies.tilt_azimuth_study(obs, results, 24, 37.0, -120.0, -8.0, [(0, 367), (355, 79)], [0.15], 22.0, -15.0), "tilt_residual").collect()
    assert [r.system_id for r in study] == ["a", "b"] and abs(study[0].tilt_residual) < 0.3


def test_daylight_time_is_removed(spark):
    z = ZoneInfo("America/Los_Angeles")
    start = datetime(2021, 3, 13)
    times = [start + timedelta(minutes=30 * i) for i in range(96)] + [datetime(2021, 11, 6) + timedelta(minutes=30 * i) for i in range(96)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(times)], "i int, ts timestamp_ntz")
    got = {r.i: r.at for r in df.select("i", timeaxis.remove_daylight_time(F.col("ts"), "America/Los_Angeles", -8.0).alias("at")).collect()}
    for i, t in enumerate(times):
        one, two = t.replace(tzinfo=z), t.replace(tzinfo=z, fold=1)
        skipped = one.astimezone(ZoneInfo("UTC")).astimezone(z).replace(tzinfo=None) != t
        twice = one.utcoffset() != two.utcoffset()
        want = None if skipped or twice else t - one.utcoffset() + timedelta(hours=-8)
        assert got[i] == want, t
    assert sum(v is None for v in got.values()) == 4


def test_daylight_resampling_and_back(spark):
    day = date(2021, 6, 1)
    rows = [("s", day, i, float(max(0, 10 * np.sin((i - 5) / 14 * np.pi))) if 5 < i < 19 else 0.0) for i in range(24)]
    marked = spark.createDataFrame(rows, "system_id string, day date, slot int, value double").withColumn("sun", F.col("value") > 0)
    points = rebin.resample_daylight(marked, 13)
    back = {r.slot: r.value for r in rebin.undo_daylight(points, marked, 13).collect()}
    assert len(back) == 24 and all(back[r[2]] == pytest.approx(r[3]) for r in rows)


def test_shade_is_looked_up_by_declination(spark):
    parts = spark.createDataFrame([("s", d, k, 1.0 if k else 0.001, 0.25 if d == -23 else 0.0) for d in range(-24, 25) for k in range(3)], "system_id string, delta int, k int, clear double, loss double")
    days = spark.createDataFrame([("s", date(2021, 12, 21)), ("s", date(2021, 6, 21))], "system_id string, day date")
    got = {(r.day.month, r.k): r.part for r in studies.shade_of_days(days, parts).collect()}
    assert got == {(12, 0): 0.0, (12, 1): 0.25, (12, 2): 0.25, (6, 0): 0.0, (6, 1): 0.0, (6, 2): 0.0}


def test_joint_shade_problem_finds_the_shaded_place():
    rng = np.random.default_rng(0)
    k, d = np.linspace(0, np.pi, 20), np.linspace(-1, 1, 16)
    clear = np.sin(k)[None, :] * (1 - 0.2 * d[:, None] ** 2)
    shaded = clear.copy()
    shaded[:6, 4:7] *= 0.6
    shaded += 0.003 * rng.normal(size=clear.shape)
    shaded[3, 10] = np.nan
    got, loss = detect.shade_components(shaded)
    assert loss[:6, 4:7].mean() > 10 * loss[8:, 10:].mean() and np.abs(got - clear)[8:].mean() < 0.02
    assert (np.diff(got, 2, axis=0) < 1e-3).all() and (got[:, [0, -1]] == 0).all() and (loss >= 0).all()
    vectors = np.linalg.qr(np.stack([np.sin(k), np.sin(2 * k), np.sin(3 * k)], axis=1))[0]
    prior, _ = detect.shade_components(shaded, mean=np.sin(k), prior=(np.array([1.0, 0.1, 0.1]), vectors))
    assert np.abs(prior - clear)[8:].mean() < 0.05


def test_class_prior_is_the_covariance_of_the_class(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 4)) * [3, 2, 1, 0.1] + [1, 2, 3, 4]
    az = rng.uniform(-90, 90, 60)
    corpus = spark.createDataFrame([(float(a), [float(v) for v in r]) for a, r in zip(az, x)], "az double, values array<double>")
    mean, values, vectors = studies.class_prior(corpus, "az <= 30", rank=2)
    part = x[az <= 30]
    want, v = np.linalg.eigh(np.cov(part.T))
    assert np.allclose(mean, part.mean(axis=0)) and np.allclose(values, want[::-1][:2]) and np.allclose(np.abs((vectors * v[:, ::-1][:, :2]).sum(axis=0)), 1)


def test_reweighted_steps_keep_the_planted_one_alone():
    rng = np.random.default_rng(2)
    t = np.arange(500)
    y = 12 + 0.2 * np.cos(2 * np.pi * t / 365) + 0.05 * rng.normal(size=500) + np.where(t >= 250, 1.0, 0)
    plain, again = dc.steps_and_season(y, 0.3)[0], dc.steps_and_season(y, 0.3, passes=5)[0]
    jumps = lambda s: int((np.abs(np.diff(s)) > 1e-3).sum())
    assert jumps(again) < jumps(plain) and again[251] - again[248] == pytest.approx(1, abs=0.15)


def test_partition_plan_balances_sizes(spark):
    rng = np.random.default_rng(3)
    files = spark.createDataFrame([(f"f{i}", int(s)) for i, s in enumerate(rng.integers(1, 100, 500))] + [("big", 5000), ("none", None)], "path string, size long")
    plan = tables.partition_plan(files, 6)
    rows = plan.collect()
    assert len(rows) == 502 and {r.path for r in rows if r.is_outlier} == {"big"}
    sizes = [sum(r.size or 0 for r in rows if r.part == k) for k in range(6)]
    assert max(sizes) - min(sizes) <= 2 * 5000 and {r.part for r in rows} == set(range(6))
    assert tables.partition_plan(files.limit(0), 3).count() == 0


def test_small_expressions(spark):
    df = spark.createDataFrame([(" 90210 ", [0.5, 0.1], [0.1, 0.9]), ("9021", None, [0.1]), (None, [], [])], "z string, a array<double>, b array<double>")
    rows = df.select(tables.zip_code(F.col("z")).alias("z"), tables.all_levels(F.col("a"), F.col("b")).alias("l")).collect()
    assert [(r.z, r.l) for r in rows] == [("90210", [0.1, 0.5, 0.9]), (None, None), (None, [])]
    assert tables.columns_like(spark.createDataFrame([(1, 2, 3)], "ac_power int, dc_power int, ac_flag int"), ["power"], ["dc"]) == ["ac_power"]
    times = readers.with_times(spark.createDataFrame([("x", "2021-01-02 03:04:05"), ("y", "no")], "name string, SampleTime string"))
    assert [r.ts for r in times.collect()] == [datetime(2021, 1, 2, 3, 4, 5), None]
    with pytest.raises(ValueError):
        readers.time_column(times.select("name"))
    assert session.versions()["pyspark"] and session.CLIENTS["local"] is session.local_session and "cluster" in session.CLIENTS


def test_sources_of_a_run(spark, tmp_path):
    dry = readers.synthetic(spark, systems=1, days=400, step=60, soiling=0.004, seasonal=0.9, seed=5)
    even = readers.synthetic(spark, systems=1, days=400, step=60, soiling=0.004, seed=5)
    assert dry.count() == even.count() == 400 * 24 and dry.exceptAll(even).count() > 0
    for i in range(2):
        readers.write_results(spark.createDataFrame([(f"s{i}", 1.0)], "system_id string, x double"), str(tmp_path / "out"), ["system_id"])
    assert {r.system_id for r in readers.merge_results(spark, str(tmp_path / "out")).collect()} == {"s0", "s1"}


def test_a_database_table_is_read_in_parts(spark):
    url, options = "jdbc:derby:memory:sunloom;create=true", {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    try:
        spark.sparkContext._jvm.java.lang.Class.forName(options["driver"])
    except Exception:  # noqa: BLE001
        pytest.skip("no database driver on the class path")
    spark.range(10).write.jdbc(url, "numbers", "overwrite", options)
    got = readers.read_jdbc(spark, url, "numbers", ["\"id\" < 5", "\"id\" >= 5"], options)
    assert got.rdd.getNumPartitions() == 2 and sorted(r[0] for r in got.collect()) == list(range(10))
