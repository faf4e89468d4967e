"""Queries of the analyses over the test tables; fits have no SQL and are tested against planted cases."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sunloom.operators import regular
from sunloom.operators.clocks import latest_metadata
from sunloom.plans import pipeline, studies
from sunloom.session import cut_lineage, table
from sunloom.streaming.daily import daily_stream, outages


def _readings(spark: SparkSession, folder: str) -> DataFrame:
    m = table(spark, folder, "measurements")
    return m.select(F.col("sensor").alias("system_id"), "ts", F.col("meas_val_f").alias("value"))


def _steps(spark: SparkSession, folder: str) -> DataFrame:
    """(system_id, step_minutes) of each sensor, over all its sites."""
    m = table(spark, folder, "measurements").withColumn("site", F.lit(None).cast("string"))
    grids = regular.source_grids(regular.shard_summaries(regular.shards(m)), table(spark, folder, "system_metadata"))
    return grids.select(F.col("sensor").alias("system_id"), F.col("step").alias("step_minutes"))


def _results(spark: SparkSession, folder: str) -> DataFrame:
    return pipeline.run_by_step(_readings(spark, folder), _steps(spark, folder))


def _places(spark: SparkSession, folder: str) -> DataFrame:
    """(system_id, gmt_offset) as last revised."""
    return latest_metadata(table(spark, folder, "system_metadata")).select(F.col("system").alias("system_id"), "gmt_offset")


def fleet_daily(spark: SparkSession, folder: str) -> DataFrame:
    """Daily scores and flags of every source, on the grid of its own step, and its corrected readings; ``roll`` counts slots."""
    return _results(spark, folder).drop("seconds")


def fleet_report(spark: SparkSession, folder: str) -> DataFrame:
    """The summary of a run over all systems of the metadata, with losses, place and the errors of each stage."""
    results = cut_lineage(_results(spark, folder).drop("filled"))
    losses = pipeline.loss_summary(cut_lineage(pipeline.loss_analysis(results)))
    places = pipeline.location(results.join(_places(spark, folder), "system_id", "left"), "gmt_offset")
    return pipeline.report(results, losses, _places(spark, folder)).drop("runtimes").join(places, "system_id", "left")


def fleet_performance(spark: SparkSession, folder: str) -> DataFrame:
    """Each day's energy over that of the source's clear-sky model."""
    return pipeline.performance(pipeline.days_by_step(_readings(spark, folder), _steps(spark, folder)))


def fleet_soiling(spark: SparkSession, folder: str) -> DataFrame:
    return pipeline.soiling(pipeline.days_by_step(_readings(spark, folder), _steps(spark, folder)))


def regular_power(spark: SparkSession, folder: str) -> DataFrame:
    """Every source's regular series with missing periods marked and filled."""
    return regular.regular_series(table(spark, folder, "measurements"), table(spark, folder, "system_metadata"))


def stream_daily(spark: SparkSession, folder: str) -> DataFrame:
    """The streaming statistics over the events as a batch."""
    e = table(spark, folder, "events").select(F.col("event_type").alias("system_id"), F.col("ts").cast("timestamp").alias("ts"), "value")
    d = daily_stream(e, 100.0)
    return d.select("system_id", "day", "n", F.round("energy", 4).alias("energy"), "top")


def stream_sessions(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events").select(F.col("event_type").alias("system_id"), F.col("ts").cast("timestamp").alias("ts"))
    s = outages(e, "1 hour")
    return s.select("system_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


def parameter_trends(spark: SparkSession, folder: str) -> DataFrame:
    """Yearly change of each system's shunt resistance."""
    parts = studies.parameter_components(table(spark, folder, "pvpro_results"), "resistance_shunt", ["site", "system"])
    return studies.yearly_change(parts, ["site", "system"])


def day_of_year(spark: SparkSession, folder: str) -> DataFrame:
    o = table(spark, folder, "orders").groupBy(F.to_date("o_orderdate").alias("day"), "o_orderstatus").agg(F.max("o_totalprice").alias("value"))
    d = studies.daily_median_by_day_of_year(o, ["o_orderstatus"])
    return d.select("o_orderstatus", "doy", F.round("median", 6).alias("median"), F.round("mean", 6).alias("mean"))


def sensor_choice(spark: SparkSession, folder: str) -> DataFrame:
    """Which of two columns of the parameter fits predicts the power of a system best."""
    p = table(spark, folder, "pvpro_results").select("system", "ts", "row_id", *[F.when(~F.isnan(c), F.col(c)).alias(c) for c in ("i_mp", "v_mp", "p_mp")])
    long = p.unpivot(["system", "ts", "p_mp"], ["i_mp", "v_mp"], "sensor", "x")
    scores = studies.sensor_scores(long, ["system"], "sensor", "x", "p_mp", "ts", 5)
    return scores.select("system", "sensor", "n", F.round("rmse", 6).alias("rmse"))


def sun_map(spark: SparkSession, folder: str) -> DataFrame:
    """Mean scaled power by the sun's place, over all hourly values of the events."""
    o = table(spark, folder, "events").groupBy(F.col("event_type").alias("system_id"), F.to_date("ts").alias("day"), F.hour("ts").alias("slot")).agg(F.max("value").alias("value"))
    return studies.polar(o, 24, 37.5, -120.0, -8.0).withColumn("value", F.round("value", 6))


def _sun_days(spark: SparkSession, folder: str) -> DataFrame:
    """Days of the orders with a sunrise and a sunset by formula, as daily results."""
    d = table(spark, folder, "orders").select(F.col("o_orderpriority").alias("system_id"), F.to_date("o_orderdate").alias("day")).distinct()
    swing, of_month = F.sin(2 * F.pi() * (F.dayofyear("day") - 81) / 365.0), F.dayofmonth("day")
    return d.select(
        "system_id", "day", (6 - 1.5 * swing + (of_month % 5) * 0.02).alias("sunrise"), (18.2 + 1.4 * swing - (of_month % 3) * 0.03).alias("sunset"),
        (of_month % 7 != 0).alias("no_errors"), (of_month % 3 == 0).alias("is_clear"), F.lit(None).cast("string").alias("error"),
    )


def s_location(spark: SparkSession, folder: str) -> DataFrame:
    x = pipeline.location(_sun_days(spark, folder), -8.0)
    return x.select("system_id", F.round("longitude", 6).alias("longitude"), F.round("latitude", 6).alias("latitude"))


def s_longitude_study(spark: SparkSession, folder: str) -> DataFrame:
    x = studies.best_first(studies.longitude_study(_sun_days(spark, folder), -8.0, -120.0))
    return x.select("system_id", "eot", "days", "estimator", F.round("longitude", 6).alias("longitude"), F.round("residual", 6).alias("residual"))


def s_latitude_study(spark: SparkSession, folder: str) -> DataFrame:
    x = studies.latitude_study(_sun_days(spark, folder), 37.5)
    return x.select("system_id", "declination", "days", F.round("latitude", 6).alias("latitude"), F.round("residual", 6).alias("residual"))


def _slots(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Hourly values of the events, and results that take all their days as clear."""
    o = table(spark, folder, "events").filter("ts IS NOT NULL").groupBy(F.col("event_type").alias("system_id"), F.to_date("ts").alias("day"), F.hour("ts").alias("slot")).agg(F.max("value").alias("value"))
    days = o.groupBy("system_id", "day").agg(F.max("value").alias("top")).select("*", F.lit(True).alias("is_clear"), F.lit(False).alias("clipped"))
    return o, days


def s_orientation(spark: SparkSession, folder: str) -> DataFrame:
    x = studies.orientation(*_slots(spark, folder), 24, 37.5, -120.0, -8.0)
    return x.select("system_id", F.round("tilt", 4).alias("tilt"), F.round("azimuth", 4).alias("azimuth"), "n")


def s_orientation_known(spark: SparkSession, folder: str) -> DataFrame:
    """Azimuth alone, tilt alone and latitude alone, the other two known."""
    o, days = _slots(spark, folder)
    sums = studies.sun_sums(o, days, 24, -120.0, -8.0).withColumns({"la": F.lit(37.5), "ti": F.lit(20.0), "az": F.lit(10.0)})
    ways = {"azimuth": ("la", "ti", None), "tilt": ("la", None, "az"), "latitude": (None, "ti", "az")}
    parts = [studies.orientation_with(sums, *known).select("system_id", F.lit(k).alias("unknown"), F.round(k, 3).alias("angle"), "n") for k, known in ways.items()]
    return reduce(DataFrame.unionByName, parts)


def s_tilt_azimuth_study(spark: SparkSession, folder: str) -> DataFrame:
    x = studies.tilt_azimuth_study(*_slots(spark, folder), 24, 37.5, -120.0, -8.0, [(0, 367), (0, 20), (355, 79)], [0.15, 0.5], 20.0, 0.0)
    return x.select("system_id", "first_day", "last_day", "share", F.round("tilt", 3).alias("tilt"), F.round("azimuth", 3).alias("azimuth"), "n")


QUERIES = {f.__name__: f for f in (fleet_daily, fleet_report, fleet_performance, fleet_soiling, s_location, s_longitude_study, s_latitude_study, s_orientation, s_orientation_known, s_tilt_azimuth_study, regular_power, stream_daily, stream_sessions, parameter_trends, day_of_year, sensor_choice, sun_map)}
_B = "((doy - 1) * 2 * pi() / 365)"
_EOT = {
    "duffie": f"(229.2 * (0.000075 + 0.001868 * cos{_B} - 0.032077 * sin{_B} - 0.014615 * cos(2 * {_B}) - 0.04089 * sin(2 * {_B})))",
    "da_rosa": "(9.87 * sin(2 * radians((doy - 81) * 360 / 364)) - 7.53 * cos(radians((doy - 81) * 360 / 364)) - 1.5 * sin(radians((doy - 81) * 360 / 364)))",
}
_DECLINATION = {
    "cooper": "(23.45 * sin(radians((doy + 284) * 360 / 365)))",
    "spencer": f"degrees(0.006918 - 0.399912 * cos{_B} + 0.070257 * sin{_B} - 0.006758 * cos(2 * {_B}) + 0.000907 * sin(2 * {_B}) - 0.002697 * cos(3 * {_B}) + 0.00148 * sin(3 * {_B}))",
}
_USE = {"all": "true", "no_errors": "no_errors", "clear": "is_clear"}
_SUN_DAYS = """WITH d AS (SELECT DISTINCT o_orderpriority AS system_id, CAST(o_orderdate AS DATE) AS day FROM orders), e AS (SELECT *, CAST(extract(doy FROM day) AS DOUBLE) AS doy, extract(day FROM day) AS dom FROM d),
s AS (SELECT *, 6 - 1.5 * sin(2 * pi() * (doy - 81) / 365) + dom % 5 * 0.02 AS sunrise, 18.2 + 1.4 * sin(2 * pi() * (doy - 81) / 365) - dom % 3 * 0.03 AS sunset, dom % 7 <> 0 AS no_errors, dom % 3 = 0 AS is_clear FROM e)"""
_LON = {k: f"(720 - (sunrise + sunset) * 30 - {e}) / 4 - 120" for k, e in _EOT.items()}
_LAT = {k: f"degrees(atan(-cos(radians(7.5 * (sunset - sunrise))) / tan(radians({d}))))" for k, d in _DECLINATION.items()}
_LON_STUDY = " UNION ALL ".join(
    f"SELECT system_id, '{e}' AS eot, '{u}' AS days, '{n}' AS estimator, {f}({_LON[e]}) FILTER (WHERE {w}) AS v FROM s GROUP BY 1" for e in _EOT for u, w in _USE.items() for n, f in (("l1", "median"), ("l2", "avg"))
)
_LAT_STUDY = " UNION ALL ".join(f"SELECT system_id, '{d}' AS declination, '{u}' AS days, median({_LAT[d]}) FILTER (WHERE {w} AND abs({_DECLINATION[d]}) > 1) AS v FROM s GROUP BY 1" for d in _DECLINATION for u, w in _USE.items())
_SLOTS = f"""o AS (SELECT event_type AS system_id, CAST(ts AS DATE) AS day, CAST(extract(hour FROM ts) AS INTEGER) AS slot, max(value) AS value FROM events WHERE ts IS NOT NULL GROUP BY 1, 2, 3),
y AS (SELECT *, CAST(extract(doy FROM day) AS DOUBLE) AS doy, max(value) OVER (PARTITION BY system_id, day) AS top FROM o),
g AS (SELECT *, radians({_DECLINATION['spencer']}) AS d, radians(15.0 * (slot + {_EOT['duffie']} / 60 - 12.0)) AS w FROM y)"""
_SUMS = """q AS (SELECT system_id, doy, value / top AS part, sin(d) * sin(radians(37.5)) + cos(d) * cos(radians(37.5)) * cos(w) AS u, cos(d) * sin(radians(37.5)) * cos(w) - sin(d) * cos(radians(37.5)) AS s, cos(d) * sin(w) AS t, value AS v FROM g)"""
_SOLVED = """m AS (SELECT *, uu * (ss * tt - st * st) - us * (us * tt - st * ut) + ut * (us * st - ss * ut) AS det FROM sums),
c AS (SELECT *, uv * (ss * tt - st * st) - us * (sv * tt - st * tv) + ut * (sv * st - ss * tv) AS cu, uu * (sv * tt - st * tv) - uv * (us * tt - st * ut) + ut * (us * tv - sv * ut) AS cs, uu * (ss * tv - sv * st) - us * (us * tv - sv * ut) + uv * (us * st - ss * ut) AS ct FROM m)"""
_PRODUCTS = "count(*) AS n, sum(u * u) AS uu, sum(u * s) AS us, sum(u * t) AS ut, sum(s * s) AS ss, sum(s * t) AS st, sum(t * t) AS tt, sum(u * v) AS uv, sum(s * v) AS sv, sum(t * v) AS tv"
_ANGLES = "degrees(atan2(sqrt((cs / det) ** 2 + (ct / det) ** 2), cu / det)), {0}) AS tilt, round(degrees(atan2(ct / det, cs / det))"
SQL = {
    "s_location": _SUN_DAYS + f" SELECT system_id, round(median({_LON['duffie']}), 6) AS longitude, round(median({_LAT['cooper']}), 6) AS latitude FROM s GROUP BY 1",
    "s_longitude_study": _SUN_DAYS + f" SELECT system_id, eot, days, estimator, round(v, 6) AS longitude, round(-120 - v, 6) AS residual FROM ({_LON_STUDY})",
    "s_latitude_study": _SUN_DAYS + f" SELECT system_id, declination, days, round(v, 6) AS latitude, round(37.5 - v, 6) AS residual FROM ({_LAT_STUDY})",
    "s_orientation": f"WITH {_SLOTS}, {_SUMS}, sums AS (SELECT system_id, {_PRODUCTS} FROM q WHERE part > 0.15 GROUP BY 1), {_SOLVED} SELECT system_id, round({_ANGLES.format(4)}, 4) AS azimuth, n FROM c",
    "s_tilt_azimuth_study": f"""WITH {_SLOTS}, {_SUMS}, options AS (SELECT * FROM (VALUES (0, 367), (0, 20), (355, 79)) AS r(first_day, last_day), (VALUES (0.15::DOUBLE), (0.5::DOUBLE)) AS h(share)),
sums AS (SELECT system_id, first_day, last_day, share, {_PRODUCTS} FROM q JOIN options ON doy > first_day AND doy < last_day AND part > share GROUP BY 1, 2, 3, 4), {_SOLVED}
SELECT system_id, first_day, last_day, share, round({_ANGLES.format(3)}, 3) AS azimuth, n FROM c""",
    "sun_map": f"""WITH {_SLOTS}, t AS (SELECT system_id, day, quantile_cont(value, 0.95) AS q FROM o GROUP BY 1, 2),
p AS (SELECT degrees(asin(sin(radians(37.5)) * sin(d) + cos(radians(37.5)) * cos(d) * cos(w))) AS e, degrees(atan2(sin(w), cos(w) * sin(radians(37.5)) - tan(d) * cos(radians(37.5)))) + 180 AS a, value / nullif(q, 0) AS x FROM g JOIN t ON t.system_id = g.system_id AND t.day = g.day)
SELECT 5.0 * round_even(((a % 360) + 360) % 360 / 5, 0) AS bx, 5.0 * round_even(e / 5, 0) AS "by", round(avg(x), 6) AS value, count(*) AS n FROM p WHERE e >= 0 AND x IS NOT NULL GROUP BY 1, 2""",
    "sensor_choice": """WITH p AS (SELECT system, ts, CASE WHEN NOT isnan(i_mp) THEN i_mp END AS i_mp, CASE WHEN NOT isnan(v_mp) THEN v_mp END AS v_mp, CASE WHEN NOT isnan(p_mp) THEN p_mp END AS y FROM pvpro_results),
l AS (SELECT system, ts, y, 'i_mp' AS sensor, i_mp AS x FROM p UNION ALL SELECT system, ts, y, 'v_mp', v_mp FROM p),
r AS (SELECT *, ntile(6) OVER (PARTITION BY system, sensor ORDER BY ts NULLS FIRST, x, y) - 1 AS part FROM l WHERE x IS NOT NULL AND y IS NOT NULL),
s AS (SELECT system, sensor, part, count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS sxx, sum(x * y) AS sxy FROM r GROUP BY 1, 2, 3),
b AS (SELECT system, sensor, part, sum(n) OVER w AS n, sum(sx) OVER w AS sx, sum(sy) OVER w AS sy, sum(sxx) OVER w AS sxx, sum(sxy) OVER w AS sxy FROM s WINDOW w AS (PARTITION BY system, sensor ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
k AS (SELECT system, sensor, part, (n * sxy - sx * sy) / nullif(n * sxx - sx * sx, 0) AS a, (sy - (n * sxy - sx * sy) / nullif(n * sxx - sx * sx, 0) * sx) / n AS b FROM b WHERE n > 1),
g AS (SELECT r.system, r.sensor, a * x + b AS guess, y FROM r JOIN k ON r.system = k.system AND r.sensor = k.sensor AND r.part = k.part)
SELECT system, sensor, count(*) AS n, round(sqrt(avg((guess - y) ** 2)), 6) AS rmse FROM g WHERE guess IS NOT NULL GROUP BY 1, 2""",
    "day_of_year": """WITH o AS (SELECT CAST(o_orderdate AS DATE) AS day, o_orderstatus, max(o_totalprice) AS value FROM orders GROUP BY 1, 2),
d AS (SELECT *, CAST(extract(doy FROM day) - CASE WHEN extract(doy FROM make_date(CAST(extract(year FROM day) AS INTEGER), 12, 31)) = 366 AND extract(doy FROM day) > 60 THEN 1 ELSE 0 END AS INTEGER) AS doy FROM o WHERE strftime(day, '%m-%d') <> '02-29')
SELECT o_orderstatus, doy, round(quantile_cont(value, 0.5), 6) AS median, round(avg(value), 6) AS mean FROM d GROUP BY 1, 2""",
    "stream_daily": """WITH e AS (SELECT event_type AS system_id, ts, min(value) AS value FROM events WHERE ts IS NOT NULL AND value IS NOT NULL GROUP BY 1, 2)
SELECT system_id, CAST(ts AS DATE) AS day, count(*) AS n, round(sum(value), 4) AS energy, max(value) AS top FROM e GROUP BY 1, 2""",
    "stream_sessions": """WITH e AS (SELECT event_type AS system_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY event_type ORDER BY ts) + INTERVAL 1 HOUR THEN 0 ELSE 1 END AS c FROM events),
g AS (SELECT *, sum(c) OVER (PARTITION BY system_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS g FROM e)
SELECT system_id, min(ts) AS start, max(ts) + INTERVAL 1 HOUR AS "end", count(*) AS n FROM g GROUP BY system_id, g""",
}
