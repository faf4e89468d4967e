from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from sunloom.kernels import days, detect
from sunloom.operators import daily, rebin, tables
from sunloom.plans import analyses, pipeline, studies
from sunloom.session import cut_lineage
from sunloom.sources import readers
from sunloom.streaming.daily import daily_stream


@pytest.fixture(scope="module")
def fleet(spark):
    rng = np.random.default_rng(0)
    rows = []
    for system, step in (("plain", 0.0), ("cut", 0.35)):
        for d in range(450):
            half = 5 + np.cos((d - 172) * 2 * np.pi / 365)
            h = np.arange(0, 24, 0.25)
            light = np.where(np.abs(h - 12) < half, np.cos((h - 12) / half * np.pi / 2), 0)
            v = 10 * light * (1 - step * (d >= 250)) * (1 if rng.random() < 0.6 else rng.uniform(0.4, 1, 96))
            rows += [(system, datetime(2021, 1, 1) + timedelta(days=d, hours=float(x)), float(y)) for x, y in zip(h, v) if rng.random() > 0.02]
    rows += [("dark", datetime(2021, 1, 1) + timedelta(hours=i), 0.0) for i in range(72)]
    df = spark.createDataFrame(rows, "system_id string, ts timestamp_ntz, value double").repartition(4).cache()
    return df, pipeline.run(df, 15).cache()


def test_report_finds_the_planted_step(fleet):
    r = {x.system_id: x for x in pipeline.report(fleet[1]).collect()}
    assert r["plain"].quality_score > 0.8 and r["plain"].clearness_score > 0.2
    assert r["cut"].capacity_change and not r["plain"].capacity_change
    assert not r["plain"].time_shift_correction
    labels = fleet[1].filter("system_id = 'cut'").groupBy("capacity_label").agg(F.min("day").alias("d")).orderBy("d").collect()
    assert abs((labels[1].d - datetime(2021, 9, 8).date()).days) <= 2
    assert r["dark"].quality_score in (None, 0.0) and r["plain"].run_pipeline_error == r["plain"].get_data_error == "No error"


def test_short_systems_get_steps_or_no_answer():
    d = np.arange(24)

    def run(f):
        n = len(f)
        same = {"density": 0.5, "bends": 0.1, "linearity": 0.01, "stat1": 0.9, "stat2": 0.05, "noon": 12.0}
        return pipeline.detectors({**{k: np.full(n, v) for k, v in same.items()}, "energy": 50 * f, "top": 10 * f}, 24)

    cut, even, one = run(np.where(d >= 12, 0.5, 1.0) * (1 + 0.01 * np.sin(d))), run(1 + 0.01 * np.sin(d)), run(np.ones(1))
    assert not any(x[2] for x in (cut, even, one))
    assert np.flatnonzero(np.diff(cut[0]["capacity_label"])).tolist() == [11] and not even[0]["capacity_label"].any()
    # "No" only where a shift of an hour would be found.
    assert all(any("shift: " in u for u in x[1]) if "roll" not in x[0] else not x[0]["roll"].any() for x in (cut, even, one))
    assert any("capacity: too few" in u for u in one[1]) and any("shift: too few" in u for u in one[1])


def test_a_stage_that_fails_leaves_the_others(monkeypatch):
    def broken(*_):
        raise ValueError("no luck")

    monkeypatch.setattr(detect, "clipping", broken)
    day = np.clip(np.cos((np.arange(24) - 12) / 6 * np.pi / 2), 0, None)
    out = pipeline.analyse_system(np.arange(40), [np.arange(24)] * 40, [day * (1 + 0.1 * np.sin(i)) for i in range(40)], 24)
    assert (out.error == "clipping: ValueError: no luck").all() and out.clipped.isna().all()
    assert out.no_errors.notna().all() and out.energy.notna().all()


def planted(n, shift=lambda d: 0, m=96):
    """Days of a system whose clock is off by some hours on some days."""
    rng = np.random.default_rng(1)
    h = np.arange(m) * 24 / m
    out = []
    for d in range(n):
        half = 5.5 + np.cos((d - 172) * 2 * np.pi / 365)
        x = h - shift(d)
        light = np.where(np.abs(x - 12) < half, np.cos((x - 12) / half * np.pi / 2), 0)
        out.append(np.clip(10 * light * (1 if rng.random() < 0.6 else rng.uniform(0.5, 1, m)), 0, None))
    return out


def test_a_planted_clock_shift_is_corrected():
    off = lambda d: 1 if 150 <= d < 300 else 0
    values = planted(500, off)
    out = pipeline.analyse_system(np.arange(500), [np.arange(96)] * 500, values, 96)
    assert out.error.isna().all() and out.shifted.all()
    assert abs(np.mean(out.roll[160:290]) + 4) < 0.1 and abs(np.mean(np.r_[out.roll[:140], out.roll[310:]])) < 0.1
    got = np.array([np.asarray(x) for x in out["filled"]])
    assert np.allclose(got.sum(axis=1), np.array(values).sum(axis=1))
    middle = lambda x: (x * np.arange(96)).sum(axis=1) / x.sum(axis=1)
    assert abs(middle(got)[160:290].mean() - middle(got)[:140].mean()) < 0.3


def test_clocks_that_are_far_off_are_moved():
    for hours, field in ((7, "standard_shift"), (2, "time_zone_correction")):
        out = pipeline.analyse_system(np.arange(120), [np.arange(96)] * 120, planted(120, lambda d: hours), 96)
        assert (out[field] == -hours).all(), hours
        assert abs(((out.sunrise + out.sunset) / 2).mean() - 12) < 0.4


def test_matrix_statistics_equal_the_relational_ones(spark):
    rng = np.random.default_rng(5)
    x = np.clip(np.round(np.tile(np.clip(np.cos((np.arange(24) - 12) / 6 * np.pi / 2), 0, None), (20, 1)) * 10 + rng.normal(size=(20, 24)), 3), 0, None)
    start = datetime(2021, 1, 1).date()
    obs = spark.createDataFrame([("s", start + timedelta(days=d), i, float(x[d, i])) for d in range(20) for i in range(24)], "system_id string, day date, slot int, value double")
    got = days.statistics(x, x)
    scores = daily.daily_scores(obs, 24).orderBy("day").toPandas()
    lines, clips = daily.linearity(obs, 24).orderBy("day").toPandas(), daily.clip_scores(obs).orderBy("day").toPandas()
    for name, want in (("density", scores.density), ("energy", scores.energy), ("bends", scores.bends), ("top", scores.top), ("linearity", lines.linearity), ("stat1", clips.stat1), ("stat2", clips.stat2)):
        assert np.allclose(got[name], want), name
    sunny = daily.sun_times(daily.sunny(obs, 0.1), 24).orderBy("day").toPandas()
    rise, fall = days.rough_sun_times(x, np.array([0.1]))
    assert np.allclose(rise[0], sunny.sunrise.astype(float), equal_nan=True) and np.allclose(fall[0], sunny.sunset.astype(float), equal_nan=True)


def test_fleet_keeps_each_sources_step(spark, tmp_path):
    rows = []
    for system, step, peak in (("fine", 15, 12.25), ("hourly", 60, 12.0)):
        for d in range(8):
            for h in np.arange(0, 24, step / 60):
                v = 20.0 if h == peak else float(10 * max(np.cos((h - 12) / (5 + 0.1 * d) * np.pi / 2), 0)) if abs(h - 12) < 5 + 0.1 * d else 0.0
                rows.append(("x", system, datetime(2021, 3, 1) + timedelta(days=d, hours=float(h)), v))
    spark.createDataFrame(rows, "site string, sensor string, ts timestamp_ntz, meas_val_f double").write.parquet(str(tmp_path / "measurements.parquet"))
    spark.read.parquet("/root/testdata/sf0.001/system_metadata.parquet").limit(0).write.parquet(str(tmp_path / "system_metadata.parquet"))
    got = {r.system_id: r for r in analyses.fleet_daily(spark, str(tmp_path)).groupBy("system_id").agg(F.min("top").alias("top"), F.max("step_minutes").alias("step"), F.count("error").alias("e"), F.avg("energy").alias("energy")).collect()}
    want = {s: sum(r[3] for r in rows if r[1] == s) * k / 8 for s, k in (("fine", 0.25), ("hourly", 1.0))}
    # The peak of the fine source lies between the hours.
    for system, step in (("fine", 15), ("hourly", 60)):
        assert got[system].step == step and got[system].e == 0
        assert got[system].energy == pytest.approx(want[system], rel=0.02)
    assert got["fine"].top == pytest.approx(got["hourly"].top)


def test_losses_add_up(fleet):
    good = fleet[1].filter("system_id = 'cut'").withColumn("energy", F.when(F.dayofyear("day") != 100, F.col("energy")).otherwise(0.0))
    c = pipeline.loss_analysis(good, most=22).cache()
    r = pipeline.loss_report(c).first()
    assert r.total == pytest.approx(r.outage + r.degradation + r.soiling + r.capacity_change + r.weather, rel=1e-9)
    # The step takes a third of the energy of the days after it; days without energy are outages.
    after = good.filter("day >= '2021-09-10'").agg(F.sum("energy")).first()[0]
    assert r.capacity_change == pytest.approx(-after * 0.35 / 0.65, rel=0.35) and r.outage < 0
    one = c.first()
    assert 20 <= one.samples <= 22 and one.rate_low <= one.rate <= one.rate_high
    got = pipeline.report(good, pipeline.loss_summary(c), spark_systems(good)).collect()
    assert {x.system_id: x.get_data_error for x in got} == {"cut": "No error", "absent": "no readings"}
    assert [x.total_energy_loss for x in got if x.system_id == "cut"] == [pytest.approx(r.total)]
    loc = pipeline.location(good, 0.0).first()
    assert abs(loc.longitude) < 15


def test_fleet_report_has_sampled_rates_and_their_bounds(spark):
    rows = analyses.fleet_report(spark, "/root/testdata/sf0.001").collect()
    done = [r for r in rows if r.run_loss_analysis_error == "No error"]
    assert done and all(r.deg_rate_lower_bound <= r.degradation_rate <= r.deg_rate_upper_bound for r in done)


def test_losses_of_no_usable_day_are_an_error(spark):
    days = spark.createDataFrame([("dead", datetime(2021, 1, 1).date(), 0.0, 0, False), ("dead", datetime(2021, 1, 2).date(), 0.0, 0, None)], "system_id string, day date, energy double, capacity_label int, no_errors boolean")
    (r,) = pipeline.loss_analysis(days).collect()
    assert r.error == "ValueError: no usable days" and r.rate is None and r.baseline is None
    assert pipeline.loss_summary(pipeline.loss_analysis(days)).first().run_loss_analysis_report_error == "no components"


def spark_systems(results):
    return results.sparkSession.createDataFrame([("cut",), ("absent",)], "system_id string")


def test_dilation_keeps_energy(spark):
    rows = [("s", datetime(2021, 1, d).date(), i, float(i if 7 <= i < 17 else 0)) for d in (1, 2) for i in range(24)]
    obs = spark.createDataFrame(rows, "system_id string, day date, slot int, value double")
    sun = obs.select("system_id", "day").distinct().select("system_id", "day", F.lit(6.3).alias("sunrise"), F.lit(17.9).alias("sunset"))
    dilated = rebin.dilate(obs, sun, 24, 30)
    back = rebin.undilate(dilated, sun, 24, 30)
    want = sum(r[3] for r in rows)
    assert back.agg(F.sum("value")).first()[0] == pytest.approx(want)
    assert rebin.add_sunset_point(dilated).count() == dilated.count() + 2
    lit = obs.withColumn("sun", F.col("value") > 0)
    r = {x.k: x.value for x in rebin.resample_daylight(lit, 19).filter("day = '2021-01-01'").collect()}
    assert len(r) == 19 and r[0] == 7 and r[18] == 16 and r[9] == pytest.approx(11.5)


def test_errors_stay_with_their_system(spark):
    def kernel(pdf):
        if pdf.k.iloc[0] == "b":
            raise ValueError("no luck")
        return pdf[["k"]].head(1).assign(n=len(pdf))

    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "k string, v int")
    got = {r.k: (r.n, r.error) for r in tables.apply_by_system(df, ["k"], kernel, "k string, n double, error string").collect()}
    assert got["a"] == (2.0, None) and got["b"][1] == "ValueError: no luck"


def test_stream_equals_batch(spark, tmp_path):
    rows = [("s", datetime(2021, 1, 1 + i // 24, i % 24), float(i % 24)) for i in range(24 * 6)]
    rows += rows[:10] + [(s, t, v + 5) for s, t, v in rows[10:20]] + [(s, t, v - 5) for s, t, v in rows[20:30]] + [("s", None, 1.0), ("s", datetime(2021, 1, 2), None)]
    batch = spark.createDataFrame(rows, "system_id string, ts timestamp, value double")
    batch.coalesce(1).write.parquet(str(tmp_path / "in"))
    want = {(r.day, r.n, r.energy, r.top) for r in daily_stream(batch, 24.0).collect()}
    stream = daily_stream(spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in")), 24.0)
    q = stream.writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r.day, r.n, r.energy, r.top) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got and got <= want


def test_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text("ts,p\n2021-01-01 00:00:00,1.5\n2021-01-01 01:00:00,\n")
    c = readers.PLUGS["csv"](spark, str(tmp_path / "a.csv"), "p").collect()
    assert [(r.system_id, r.value) for r in c] == [("a", 1.5), ("a", None)]
    assert readers.list_files(spark, str(tmp_path)).count() == 1
    (tmp_path / "s.json").write_text('{"Site": {"location": "x", "longitude": 1.0}, "Inverters": {"i": {"inverter_id": "7"}}}\n')
    assert readers.read_site_json(spark, str(tmp_path / "s.json")).first().inverter_id == "7"
    kml = "<kml xmlns='k'><Placemark><name>r</name><Polygon><coordinates>0,0,0 0.001,0,0 0.001,0.001,111.32 0,0.001,111.32</coordinates></Polygon></Placemark></kml>"
    (tmp_path / "x.kml").write_text(kml)
    p = readers.read_kml(spark, str(tmp_path / "x.kml")).first()
    assert p.tilt == pytest.approx(45, abs=0.1) and p.azimuth == pytest.approx(180, abs=0.1)
    assert readers.plane_summary(readers.read_kml(spark, str(tmp_path / "x.kml"))).first().tilt_std == 0
    s = readers.synthetic(spark, systems=2, days=3, step=60)
    assert s.count() == 2 * 3 * 24 and s.select("system_id").distinct().count() == 2
    keys = s.select("system_id").distinct()
    out = str(tmp_path / "results")
    assert readers.resume(keys, out, ["system_id"]).count() == 2
    readers.write_results(s.filter("system_id = 'system_0'").limit(1), out, ["system_id"])
    assert [r.system_id for r in readers.resume(keys, out, ["system_id"]).collect()] == ["system_1"]


def test_performance_in_one_call_is_the_index_by_the_clear_sky_model(spark):
    # One system of some days, one that begins in the middle of a day, and one that never shines.
    df = spark.sql("""SELECT s AS system_id, timestamp_ntz'2021-05-01' + make_interval(0, 0, 0, 0, 0, 30 * i) AS ts, CASE WHEN s = 'dark' THEN 0D WHEN s = 'late' AND i < 30 THEN NULL ELSE greatest(0D, sin(((i % 48) - 12) / 24 * pi())) * (40 + hash(i, s) % 9) END AS value
        FROM (SELECT explode(sequence(0, 48 * 9 - 1)) AS i) CROSS JOIN VALUES ('whole'), ('late'), ('dark') AS t(s)""")
    grid = cut_lineage(pipeline.gridded_days(df, 30).withColumn("step_minutes", F.lit(30)))
    got = pipeline.performance(grid)
    assert "Generate" not in got._jdf.queryExecution().toString()
    results = cut_lineage(pipeline.analyse(grid))
    want = studies.performance_index(pipeline.slots_of(results), pipeline.clear_sky(results, 48, harmonics=(8, 2)))
    got, want = ({(r.system_id, r.day): r["index"] for r in x.collect()} for x in (got, want))
    assert got.keys() == want.keys() and len(got) >= 18
    assert all((want[k] is None) == (got[k] is None) and (got[k] is None or got[k] == pytest.approx(want[k], rel=1e-8)) for k in want)


def test_a_failure_is_no_performance_index(monkeypatch):
    def broken(*_):
        raise ValueError("no luck")

    def rows():
        systems = [(np.arange(20), 10.0), (np.arange(12), 5.0), (np.arange(0), 1.0)]
        jobs = [pipeline.analyse_fits(d, [np.arange(24)] * len(d), [v * day * (1 + 0.1 * np.sin(i)) for i in d], 24, labels=False) for d, v in systems]
        return pipeline._performance_batch(["a", "b", "none"], [pipeline.performance_job(f, 101, 0.9, (8, 2)) for f in jobs]).to_pandas()

    day = np.clip(np.cos((np.arange(24) - 12) / 6 * np.pi / 2), 0, None)
    good = rows()
    assert good[good.system_id != "none"]["index"].notna().sum() == 32 and good[good.system_id != "none"].error.isna().all()
    last = good[good.system_id == "none"]
    assert len(last) == 1 and last.day.isna().all() and last["index"].isna().all() and last.error.iloc[0] == "ValueError: no values"
    # Neither the clock as it was nor a day without known daylight makes an index.
    for stage, where, name in (("shifts", detect, "clock_shifts_fits"), ("quality", detect, "quality_fits"), ("daytime", days, "sun_fits")):
        with monkeypatch.context() as patch:
            patch.setattr(where, name, broken)
            got = rows()
        got = got[got.system_id != "none"]
        assert len(got) == 32 and got["index"].isna().all() and got.error.str.startswith(f"{stage}: ValueError: no luck").all()
    with monkeypatch.context() as patch:
        patch.setattr(pipeline, "performance_fits", broken)
        assert rows().error.tolist() == ["ValueError: no luck"] * 2 + ["ValueError: no values"]


def test_days_without_daytime_have_no_results(monkeypatch):
    def broken(*_):
        raise ValueError("no luck")

    monkeypatch.setattr(days, "sun_fits", broken)
    day = np.clip(np.cos((np.arange(24) - 12) / 6 * np.pi / 2), 0, None)
    out = pipeline.analyse_system(np.arange(10), [np.arange(24)] * 10, [day] * 10, 24)
    assert len(out) == 10 and (out.error == "daytime: ValueError: no luck").all()
    assert out[["energy", "sunrise", "filled", "no_errors", "is_clear", "roll", "time_zone_correction"]].isna().all().all()


def test_soiling_in_one_call_is_that_of_the_daily_results(spark):
    df = readers.synthetic(spark, systems=3, days=12, step=60, soiling=0.01, seed=3)
    grid = cut_lineage(pipeline.gridded_days(df, 60).withColumn("step_minutes", F.lit(60)))
    got, want = pipeline.soiling(grid), pipeline.soiling_analysis(pipeline.analyse(grid))
    assert got.columns == want.columns and "FlatMapGroupsInPandas" not in want._jdf.queryExecution().toString()
    got, want = ({(r.system_id, r.day): r for r in x.collect()} for x in (got, want))
    assert got.keys() == want.keys() and len(got) == 36
    assert all(got[k].energy == pytest.approx(want[k].energy) and got[k].corrected == pytest.approx(want[k].corrected, rel=1e-3) and got[k].soiling <= 0 for k in want)
