from datetime import date, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from sunloom.functions import solar
from sunloom.operators import windows
from sunloom.plans import studies

LAT, LON, GMT, TILT, AZ = 37.5, -77.0, -5.0, 22.5, 10.0


@pytest.fixture(scope="module")
def sky(spark):
    """Two systems' clear-sky power from the geometry, by quarter hours, and their daily results."""
    days = spark.sql("SELECT 's' AS system_id, explode(sequence(date'2021-01-01', date'2021-12-31', interval 3 days)) AS day")
    obs = days.select("system_id", "day", F.explode(F.sequence(F.lit(0), F.lit(95))).alias("slot"))
    doy = F.dayofyear("day").cast("double")
    w = solar.hour_angle(F.col("slot") * 0.25, F.lit(LON), F.lit(GMT), solar.eot_duffie(doy))
    d = solar.declination_spencer(doy)
    up = solar.solar_position(d, F.lit(LAT), w)[0] > 0
    obs = obs.withColumn("value", F.when(up, F.greatest(F.lit(0.0), solar.cos_incidence(d, F.lit(LAT), F.lit(TILT), F.lit(AZ), w))).otherwise(0.0) * 8).cache()
    rise, fall = solar.sunrise_sunset_hours(F.lit(LAT), F.lit(LON), F.lit(GMT), doy)
    top = obs.groupBy("system_id", "day").agg(F.max("value").alias("top"))
    results = top.select("system_id", "day", "top", rise.alias("sunrise"), fall.alias("sunset"), F.lit(True).alias("is_clear"), F.lit(True).alias("no_errors"), F.lit(False).alias("clipped"), F.lit(None).cast("string").alias("error"))
    return obs, results.cache()


def test_location_studies_find_the_place(sky):
    lon = studies.longitude_study(sky[1], GMT, LON).collect()
    assert len(lon) == 12 and all(abs(r.residual) < 1.0 for r in lon)
    assert max(abs(r.residual) for r in lon if r.eot == "duffie") < 1e-6
    lat = studies.latitude_study(sky[1], LAT).collect()
    assert len(lat) == 6 and all(abs(r.residual) < 2.0 for r in lat)


def test_orientation_is_recovered(sky):
    r = studies.orientation(*sky, 96, LAT, LON, GMT).first()
    assert r.tilt == pytest.approx(TILT, abs=0.5) and r.azimuth == pytest.approx(AZ, abs=1.0)


def test_polar_map_and_sun_up(sky):
    p = studies.polar(sky[0], 96, LAT, LON, GMT, 10.0)
    assert p.count() > 20 and p.filter("`by` < 0").count() == 0
    up = studies.sun_up(*sky, 96).groupBy("up").agg(F.max("value").alias("v")).collect()
    assert {r.up for r in up} == {True, False} and next(r.v for r in up if not r.up) < 0.5


def test_clear_times_and_performance(sky):
    obs = sky[0].filter("day < date'2021-01-20'")
    model = obs.select("system_id", "day", "slot", F.col("value").alias("clear"))
    dim = obs.withColumn("value", F.when(F.col("slot").between(40, 56), F.col("value") * 0.3).otherwise(F.col("value")))
    t = studies.clear_times(dim, model)
    mid = t.filter("slot = 48").agg(F.count_if("inside").alias("n")).first().n
    late = t.filter("slot = 66").agg(F.count_if(~F.col("inside")).alias("n")).first().n
    assert (mid, late) == (0, 0)
    index = studies.performance_index(dim, model).agg(F.max("index").alias("m")).first().m
    assert 0.3 < index < 0.9


def test_two_state_labels_against_a_loop(spark):
    rng = np.random.default_rng(0)
    costs = rng.random((60, 2))
    df = spark.createDataFrame([("k", i, float(a), float(b)) for i, (a, b) in enumerate(costs)], "k string, i long, a double, b double")
    got = {r.i: r.inside for r in windows.two_state_labels(df, ["k"], "i", "a", "b", 0.7).collect()}
    x = y = 0.0
    for i, (a, b) in enumerate(costs):
        x, y = min(x, y + 0.7) + a, min(y, x + 0.7) + b
        assert got[i] == (y < x)


def test_sensors_and_parameter_series(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(400):
        p = float(rng.uniform(1, 9))
        rows += [("s", "good", i, p * 2 + 0.1 * float(rng.standard_normal()), p), ("s", "bad", i, float(rng.uniform(0, 9)), p), ("s", "bad", i, None, p)]
    df = spark.createDataFrame(rows, "system string, sensor string, ts int, x double, y double")
    best = studies.identify_sensor(df, ["system"], "sensor", "x", "y", "ts", 5).first()
    assert best.sensor == "good" and best["corr"] > 0.99
    start = datetime(2020, 1, 3)
    fits = [("a", start + timedelta(weeks=w), 100.0 * (1 - 0.02 * w / 52) * (1 + 0.01 * np.cos(w * 2 * np.pi / 52))) for w in range(156)] + [("short", start, 1.0), ("a", None, 5.0), ("a", start, float("nan"))]
    f = spark.createDataFrame([(k, t, float(v)) for k, t, v in fits], "system string, ts timestamp_ntz, p_mp double")
    parts = studies.parameter_components(f, "p_mp", ["system"])
    assert parts.select("system").distinct().count() == 1 and parts.count() == 156
    assert studies.yearly_change(parts, ["system"]).first().percent == pytest.approx(-2, abs=0.5)
    errors = {r.smooth: r.error for r in studies.holdout_errors(f.filter("system = 'a'"), "p_mp", ["system"], [1.0, 100.0]).collect()}
    assert set(errors) == {1.0, 100.0} and all(e < 1e-3 for e in errors.values())


def test_shade_and_day_of_year(spark, sky):
    days = [date(2021, 1, 1) + timedelta(days=2 * i) for i in range(180)]
    rows = [("s", d, k, float(np.sin(np.pi * k / 15) * (0.5 if k == 4 else 1))) for d in days for k in range(16)]
    r = spark.createDataFrame(rows, "system_id string, day date, k int, value double")
    clear = r.select("system_id", "day").distinct().withColumn("is_clear", F.lit(True))
    s = studies.shade(studies.declination_profiles(r, clear))
    assert s.filter("loss < 0").count() == 0 and s.select("k").distinct().count() == 16
    v = spark.createDataFrame([("a", date(2020, 2, 29), 9.0), ("a", date(2020, 3, 1), 2.0), ("a", date(2021, 3, 1), 4.0)], "k string, day date, value double")
    assert [(x.doy, x.median) for x in studies.daily_median_by_day_of_year(v, ["k"]).collect()] == [(60, 3.0)]
    assert studies.daily_amplitude(sky[1]).filter("amplitude > 0").count() > 100
