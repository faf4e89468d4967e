"""Queries of the relational operators over the test tables, each with SQL to compare it with.

``events`` stands for power readings: the type of an event is the system, its value the
power; the largest value of an hour is the (day, slot) value.  Sums are rounded, as
their order is not fixed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sunloom.functions import solar
from sunloom.operators import daily, rebin, stats, tables, timeaxis, windows
from sunloom.plans import studies
from sunloom.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
M = 24

_OBS = """obs AS (SELECT event_type AS system_id, CAST(ts AS DATE) AS day, CAST(extract(hour FROM ts) AS INTEGER) AS slot, max(value) AS value
FROM events WHERE ts IS NOT NULL GROUP BY 1, 2, 3)"""
#: All 24 slots of all days between the first and the last of a system, null where nothing was seen.
_GRID = _OBS + """, span AS (SELECT system_id, min(day) AS a, max(day) AS b FROM obs GROUP BY 1),
slots AS (SELECT system_id, CAST(d.d AS DATE) AS day, CAST(s.s AS INTEGER) AS slot FROM span, generate_series(CAST(a AS TIMESTAMP), CAST(b AS TIMESTAMP), INTERVAL 1 DAY) AS d(d), generate_series(0, 23) AS s(s)),
grid AS (SELECT slots.system_id, slots.day, slots.slot, CASE WHEN obs.slot % 7 <> 3 THEN value END AS value FROM slots LEFT JOIN obs USING (system_id, day, slot))"""
_QUANT = "q AS (SELECT system_id, quantile_cont(value, 0.95) AS capacity, quantile_cont(value, 0.99) AS q99, quantile_cont(value, 0.05) AS q05, min(value) AS low FROM obs GROUP BY 1)"
_DAILY = """rev AS (SELECT o_orderpriority AS k, CAST(o_orderdate AS DATE) AS day, CAST(round(sum(o_totalprice) * 100) AS BIGINT) / 100.0 AS value FROM orders GROUP BY 1, 2)"""


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def obs(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events").filter("ts IS NOT NULL")
    return e.groupBy(F.col("event_type").alias("system_id"), F.to_date("ts").alias("day"), F.hour("ts").alias("slot")).agg(F.max("value").alias("value"))


def grid(spark: SparkSession, folder: str) -> DataFrame:
    o = obs(spark, folder)
    span = o.groupBy("system_id").agg(F.min("day").alias("a"), F.max("day").alias("b"))
    days = span.select("system_id", F.explode(F.sequence("a", "b")).alias("day"))
    slots = days.select("system_id", "day", F.explode(F.sequence(F.lit(0), F.lit(M - 1))).alias("slot"))
    holes = o.withColumn("value", F.when(F.col("slot") % 7 != 3, F.col("value")))
    return slots.join(holes, ["system_id", "day", "slot"], "left")


def revenue(spark: SparkSession, folder: str) -> DataFrame:
    o = table(spark, folder, "orders")
    return o.groupBy(F.col("o_orderpriority").alias("k"), F.to_date("o_orderdate").alias("day")).agg((F.round(F.sum("o_totalprice") * 100).cast("long") / 100.0).alias("value"))


def r(c, digits: int = 6):
    return F.round(c, digits)


# --- sources, projections, filters


@query("SELECT event_id, ts, CASE WHEN value BETWEEN 5 AND 60 THEN value END AS value FROM events WHERE ts <= TIMESTAMP '2024-01-20 00:00:00'")
def f_future_and_range(spark, folder):
    e = timeaxis.drop_future(table(spark, folder, "events"), F.lit("2024-01-20").cast("timestamp_ntz"))
    return e.select("event_id", "ts", timeaxis.clip_range(F.col("value"), 5.0, 60.0).alias("value"))


@query("SELECT event_type, count(*) FILTER (WHERE value >= 0) AS n, count(*) FILTER (WHERE value >= 0) >= 24 AS enough FROM events GROUP BY 1")
def f_enough_values(spark, folder):
    return timeaxis.enough_values(table(spark, folder, "events"), ["event_type"])


@query("""SELECT event_type, h AS ts, event_id, value FROM (SELECT *, date_trunc('hour', ts) AS h, row_number() OVER (PARTITION BY event_type, date_trunc('hour', ts) ORDER BY event_id) AS k FROM events) WHERE k = 1""")
def f_first_of_time(spark, folder):
    e = table(spark, folder, "events").select("event_type", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts"), "event_id", "value")
    return timeaxis.first_of_each_time(e, ["event_type"], ["event_id"])


@query(f"""WITH {_OBS}, {_QUANT} SELECT system_id, day, slot, coalesce((value - greatest(low, -0.005 * q99)) / q99 > 0.2, false) AS sun FROM obs JOIN q USING (system_id)""")
def f_sunny(spark, folder):
    return daily.sunny(obs(spark, folder), 0.2).select("system_id", "day", "slot", "sun")


@query(f"""WITH {_OBS}, {_QUANT} SELECT system_id, day, slot, coalesce((value - q05) / nullif(capacity - q05, 0) >= 0.1, false) AS daytime FROM obs JOIN q USING (system_id)""")
def f_daytime(spark, folder):
    return daily.daytime(obs(spark, folder)).select("system_id", "day", "slot", "daytime")


@query(f"""WITH {_GRID} SELECT system_id, day, slot, CASE WHEN value < 0 THEN 0.0 WHEN (slot < 6 OR slot >= 20) AND value IS NULL THEN 0.0 ELSE value END AS value FROM grid""")
def f_zero_night(spark, folder):
    night = (F.col("slot") < 6) | (F.col("slot") >= 20)
    return grid(spark, folder).select("system_id", "day", "slot", daily.zero_night(F.col("value"), night).alias("value"))


@query("""WITH q AS (SELECT event_type, quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM events GROUP BY 1)
SELECT event_id, e.event_type, value FROM events e JOIN q ON e.event_type = q.event_type WHERE value BETWEEN a - 1.5 * (b - a) AND b + 1.5 * (b - a)""")
def f_iqr(spark, folder):
    return daily.iqr_filter(table(spark, folder, "events").select("event_id", "event_type", "value"), ["event_type"], "value")


@query("""SELECT row_id, CASE WHEN NOT h THEN photocurrent END AS photocurrent, CASE WHEN NOT h THEN i_sc END AS i_sc FROM (SELECT row_id, photocurrent, i_sc,
coalesce(photocurrent <= 0.1, false) OR coalesce(photocurrent >= 9, false) OR coalesce(i_sc >= 9, false) AS h FROM (SELECT row_id, CASE WHEN NOT isnan(photocurrent) THEN photocurrent END AS photocurrent, CASE WHEN NOT isnan(i_sc) THEN i_sc END AS i_sc FROM pvpro_results))""")
def f_null_at_bounds(spark, folder):
    p = table(spark, folder, "pvpro_results").select("row_id", *[F.when(~F.isnan(c), F.col(c)).alias(c) for c in ("photocurrent", "i_sc")])
    return tables.null_at_bounds(p, {"photocurrent": (0.1, 9.0), "i_sc": (None, 9.0)})


@query("SELECT DISTINCT system, time_shift_manual, CAST(gmt_offset AS DOUBLE) AS gmt_offset FROM (SELECT system, time_shift_manual, CASE WHEN NOT isnan(gmt_offset) THEN gmt_offset END AS gmt_offset FROM system_metadata) WHERE time_shift_manual IN (0, 1)")
def s_system_metadata(spark, folder):
    m = table(spark, folder, "system_metadata").filter(F.col("time_shift_manual").isin(0, 1))
    return m.select("system", "time_shift_manual", F.when(~F.isnan("gmt_offset"), F.col("gmt_offset")).alias("gmt_offset")).distinct()


# --- time axis


@query("""WITH g AS (SELECT event_type, CAST(round_even((epoch(date_trunc('second', ts)) - lag(epoch(date_trunc('second', ts))) OVER (PARTITION BY event_type ORDER BY ts)) / 10.0, 0) * 10 AS BIGINT) AS gap FROM events),
c AS (SELECT event_type, gap, count(*) AS n FROM g WHERE gap IS NOT NULL GROUP BY 1, 2),
d AS (SELECT *, n / sum(n) OVER (PARTITION BY event_type) AS share, row_number() OVER (PARTITION BY event_type ORDER BY n DESC, gap) AS k FROM c)
SELECT event_type, gap, n, round(share, 6) AS share, k = 1 AS is_mode FROM d WHERE share > 0.05 OR k = 1""")
def a_common_gaps(spark, folder):
    return timeaxis.common_gaps(table(spark, folder, "events"), ["event_type"]).withColumn("share", r(F.col("share")))


@query("""WITH g AS (SELECT event_type, CAST(ts AS DATE) AS day, CAST(round_even((epoch(date_trunc('second', ts)) - lag(epoch(date_trunc('second', ts))) OVER (PARTITION BY event_type ORDER BY ts)) / 10.0, 0) * 10 AS BIGINT) AS gap FROM events),
d AS (SELECT event_type, day, quantile_cont(gap, 0.5) AS rate FROM g WHERE gap IS NOT NULL GROUP BY 1, 2)
SELECT event_type, day, CAST(rate AS DOUBLE) AS rate, coalesce(rate <> lag(rate) OVER (PARTITION BY event_type ORDER BY day), false) AS changes FROM d""")
def a_scan_rates(spark, folder):
    return timeaxis.daily_scan_rates(table(spark, folder, "events"), ["event_type"])


_NEAREST = """e AS (SELECT event_type, CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS s, min_by(value, event_id) AS v FROM events WHERE ts IS NOT NULL GROUP BY 1, 2),
w AS (SELECT *, lag(s) OVER (PARTITION BY event_type ORDER BY s) AS b, lead(s) OVER (PARTITION BY event_type ORDER BY s) AS a FROM e),
c AS (SELECT event_type, s, v, s AS slot FROM w WHERE s % 3600 = 0
UNION SELECT event_type, s, v, (s // 3600 + 1) * 3600 FROM w WHERE a IS NULL OR (s // 3600 + 1) * 3600 < a
UNION SELECT event_type, s, v, ((s + 3599) // 3600 - 1) * 3600 FROM w WHERE b IS NULL OR ((s + 3599) // 3600 - 1) * 3600 > b),
n AS (SELECT event_type, slot, v, row_number() OVER (PARTITION BY event_type, slot ORDER BY abs(slot - s), s DESC) AS k FROM c)"""


@query(f"""WITH {_NEAREST}, span AS (SELECT event_type, min(CAST(ts AS DATE)) AS a, max(CAST(ts AS DATE)) AS b FROM events GROUP BY 1),
g AS (SELECT event_type, x.x AS slot FROM span, generate_series(CAST(a AS TIMESTAMP), CAST(b AS TIMESTAMP) + INTERVAL 23 HOUR, INTERVAL 1 HOUR) AS x(x))
SELECT g.event_type, g.slot, n.v AS value FROM g LEFT JOIN n ON n.event_type = g.event_type AND n.k = 1 AND make_timestamp(n.slot * 1000000) = g.slot""")
def j_standardize(spark, folder):
    e = table(spark, folder, "events").select("event_type", F.date_trunc("second", "ts").cast("timestamp_ntz").alias("ts"), "event_id", "value")
    return timeaxis.standardize(e, ["event_type"], 3600, ["event_id"])


@query(f"""WITH {_OBS}, v AS (SELECT system_id, slot AS hour, avg(value) AS v FROM obs GROUP BY 1, 2),
x AS (SELECT system_id, hour, (v - min(v) OVER (PARTITION BY system_id)) / nullif(max(v) OVER (PARTITION BY system_id) - min(v) OVER (PARTITION BY system_id), 0) AS x FROM v),
n AS (SELECT system_id, avg(hour) AS noon FROM x WHERE x > 0.5 GROUP BY 1)
SELECT system_id, round(noon, 6) AS noon, CAST(CASE WHEN abs(12 - noon) > 4 THEN round_even(12 - noon, 0) ELSE 0 END AS INTEGER) AS shift FROM n""")
def a_average_day(spark, folder):
    o = obs(spark, folder).withColumnRenamed("slot", "hour")
    return timeaxis.average_day_shift(o, ["system_id"]).withColumn("noon", r(F.col("noon")))


@query("""WITH e AS (SELECT event_type AS system_id, date_trunc('hour', ts) AS ts, max(value) AS value FROM events GROUP BY 1, 2),
g AS (SELECT system_id, CAST(ts AS DATE) AS day, CAST(extract(hour FROM ts) AS INTEGER) AS i, CASE WHEN value > 10 THEN value END AS value FROM e),
s AS (SELECT *, min(CASE WHEN value IS NOT NULL THEN day END) OVER (PARTITION BY system_id) AS a, max(CASE WHEN value IS NOT NULL THEN day END) OVER (PARTITION BY system_id) AS b FROM g)
SELECT system_id, day, i, value FROM s WHERE day BETWEEN a AND b""")
def p_embedding(spark, folder):
    e = table(spark, folder, "events").groupBy(F.col("event_type").alias("system_id"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("slot")).agg(F.max("value").alias("value"))
    return timeaxis.embed(e.withColumn("value", F.when(F.col("value") > 10, F.col("value"))), ["system_id"], 3600)


# --- joins, tables, sets


@query("""WITH f AS (SELECT event_type, CAST(ts AS DATE) AS day, avg(value) AS v FROM events GROUP BY 1, 2 HAVING avg(value) > 20)
SELECT event_id, event_type, ts, EXISTS (SELECT 1 FROM f WHERE f.event_type = e.event_type AND f.day = CAST(e.ts AS DATE)) AS bright FROM events e""")
def j_day_flag(spark, folder):
    e = table(spark, folder, "events").select("event_id", "event_type", "ts", "value")
    days = e.groupBy("event_type", F.to_date("ts").alias("day")).agg(F.avg("value").alias("v")).filter("v > 20")
    return tables.with_day_flag(e, days, ["event_type"], "bright").drop("value")


@query("""SELECT o_orderkey, coalesce(f.big, false) AS big FROM orders LEFT JOIN (SELECT l_orderkey, true AS big FROM lineitem GROUP BY 1 HAVING max(l_quantity) >= 45) f ON o_orderkey = l_orderkey""")
def j_time_flag(spark, folder):
    big = table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_quantity").alias("q")).filter("q >= 45").select("o_orderkey", F.lit(True).alias("big"))
    return tables.with_time_flag(table(spark, folder, "orders").select("o_orderkey"), big, ["o_orderkey"], "big")


@query("""SELECT CAST(ts AS DATE) AS day, min_by(value, event_id) FILTER (WHERE event_type = 'click') AS click, min_by(value, event_id) FILTER (WHERE event_type = 'view') AS view FROM events WHERE event_type IN ('click', 'view') GROUP BY 1""")
def j_long_to_wide(spark, folder):
    e = table(spark, folder, "events").filter(F.col("event_type").isin("click", "view")).select(F.to_date("ts").alias("day"), "event_type", "value", "event_id")
    return tables.long_to_wide(e, ["day"], "event_type", "value", ["click", "view"], ["event_id"])


@query("SELECT row_id, name, value FROM (UNPIVOT (SELECT row_id, i_sc, v_oc, p_mp FROM pvpro_results) ON i_sc, v_oc, p_mp INTO NAME name VALUE value) WHERE value IS NOT NULL AND NOT isnan(value)")
def j_wide_to_long(spark, folder):
    p = table(spark, folder, "pvpro_results").select("row_id", "i_sc", "v_oc", "p_mp")
    return tables.wide_to_long(p, ["row_id"], ["i_sc", "v_oc", "p_mp"]).filter("value IS NOT NULL AND NOT isnan(value)")


@query("SELECT DISTINCT system FROM system_metadata WHERE system IS NOT NULL AND system NOT IN (SELECT key_field_1 FROM runner_summary WHERE key_field_1 IS NOT NULL AND get_data_error = 'No error')")
def j_resume(spark, folder):
    done = table(spark, folder, "runner_summary").filter("get_data_error = 'No error' AND key_field_1 IS NOT NULL").select(F.col("key_field_1").alias("system"))
    return tables.not_done(table(spark, folder, "system_metadata").select("system").filter("system IS NOT NULL").distinct(), done, ["system"])


@query("SELECT site, 'metadata' AS origin, NULL AS file_name FROM (SELECT DISTINCT site FROM system_metadata) UNION ALL SELECT site, 'json', file_name FROM site_json")
def u_concat(spark, folder):
    a = table(spark, folder, "system_metadata").select("site").distinct().withColumn("origin", F.lit("metadata"))
    return tables.concat([a, table(spark, folder, "site_json").select("site", F.lit("json").alias("origin"), "file_name")])


@query("SELECT site FROM site_json EXCEPT SELECT site FROM measurements")
def u_except(spark, folder):
    return table(spark, folder, "site_json").select("site").subtract(table(spark, folder, "measurements").select("site"))


@query("SELECT site FROM site_json INTERSECT SELECT site FROM measurements")
def u_intersect(spark, folder):
    return table(spark, folder, "site_json").select("site").intersect(table(spark, folder, "measurements").select("site"))


@query("""WITH h AS (SELECT date_trunc('hour', ts) - INTERVAL (extract(hour FROM ts) % 6) HOUR AS start, event_type, value FROM events)
SELECT event_type, start, count(*) AS n, max(value) AS top FROM h GROUP BY 1, 2""")
def a_resample(spark, folder):
    e = table(spark, folder, "events")
    out = tables.resample(e, ["event_type"], "ts", "6 hours", {"n": F.count("*"), "top": F.max("value")})
    return out.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("SELECT * FROM (VALUES ('duffie', 'fit_l1'), ('duffie', 'fit_l2'), ('da_rosa', 'fit_l1'), ('da_rosa', 'fit_l2')) AS t(eot, estimator)")
def j_option_grid(spark, folder):
    return tables.option_grid(spark, {"eot": ["duffie", "da_rosa"], "estimator": ["fit_l1", "fit_l2"]})


@query(f"WITH {_OBS} SELECT system_id, day, CAST((slot + extract(day FROM day) % 3) % 24 AS INTEGER) AS slot, value FROM obs")
def j_roll_days(spark, folder):
    o = obs(spark, folder)
    rolls = o.select("system_id", "day", (F.dayofmonth("day") % 3).alias("roll")).distinct()
    return tables.shift_days(o, rolls, M, ["system_id"]).select("system_id", "day", "slot", "value")


# --- daily aggregates


@query(f"WITH {_OBS}, {_QUANT} SELECT system_id, round(capacity, 6) AS capacity, round(q99, 6) AS q99, round(q05, 6) AS q05, low FROM q")
def a_quantiles(spark, folder):
    return daily.system_quantiles(obs(spark, folder)).select("system_id", r(F.col("capacity")).alias("capacity"), r(F.col("q99")).alias("q99"), r(F.col("q05")).alias("q05"), "low")


_SCORES = f"""{_OBS}, {_QUANT}, b AS (SELECT *, abs(lag(value) OVER w - 2 * value + lead(value) OVER w) AS bend FROM obs WINDOW w AS (PARTITION BY system_id, day ORDER BY slot)),
scores AS (SELECT system_id, day, count(*) FILTER (WHERE coalesce(value, 0) > 0.02 * capacity) / 24.0 AS density, sum(coalesce(value, 0)) * 24 / 24 AS energy, sum(bend) AS bends, max(value) AS top,
count(*) FILTER (WHERE coalesce(value, 0) > 0.005 * capacity) / 24.0 AS lit_share FROM b JOIN q USING (system_id) GROUP BY 1, 2)"""


@query(f"WITH {_SCORES} SELECT system_id, day, round(density, 6) AS density, round(energy, 4) AS energy, round(bends, 4) AS bends, top, round(lit_share, 6) AS lit_share, lit_share <= 0.2 AS is_missing FROM scores")
def a_daily_scores(spark, folder):
    s = daily.daily_scores(obs(spark, folder), M)
    return s.select("system_id", "day", r(F.col("density")).alias("density"), r(F.col("energy"), 4).alias("energy"), r(F.col("bends"), 4).alias("bends"), "top", r(F.col("lit_share")).alias("lit_share"), "is_missing")


@query(f"WITH {_SCORES} SELECT system_id, day, round(1 - bends / nullif(max(bends) OVER (PARTITION BY system_id), 0), 6) AS smoothness FROM scores")
def a_smoothness(spark, folder):
    return daily.smoothness(daily.daily_scores(obs(spark, folder), M)).select("system_id", "day", r(F.col("smoothness")).alias("smoothness"))


@query(f"""WITH {_OBS}, {_QUANT}, v AS (SELECT system_id, day, slot, CASE WHEN value >= 0.005 * capacity THEN value END AS v FROM obs JOIN q USING (system_id)),
d AS (SELECT system_id, day, round_even(v - lag(v) OVER (PARTITION BY system_id, day ORDER BY slot), 4) AS step FROM v),
c AS (SELECT system_id, day, step, count(*) AS n FROM d WHERE step IS NOT NULL GROUP BY 1, 2, 3),
t AS (SELECT *, row_number() OVER (PARTITION BY system_id, day ORDER BY n DESC, step) AS k FROM c)
SELECT system_id, day, round(step, 4) AS step, n, round(n / 23.0, 6) AS linearity FROM t WHERE k = 1""")
def a_linearity(spark, folder):
    x = daily.linearity(obs(spark, folder), M)
    return x.withColumns({"step": r(F.col("step"), 4), "linearity": r(F.col("linearity"))})


@query(f"""WITH {_OBS}, {_QUANT}, s AS (SELECT system_id, day, slot, (value - greatest(low, -0.005 * q99)) / q99 > 0.2 AS sun FROM obs JOIN q USING (system_id)),
t AS (SELECT system_id, day, min(CASE WHEN sun THEN slot END) AS a, max(CASE WHEN sun THEN slot END) AS b FROM s GROUP BY 1, 2),
x AS (SELECT system_id, day, CASE WHEN a > 0 THEN CAST(a AS DOUBLE) END AS sunrise, CASE WHEN b < 23 THEN CAST(b AS DOUBLE) END AS sunset FROM t)
SELECT system_id, day, sunrise, sunset, (sunrise + sunset) / 2 AS noon FROM x""")
def a_sun_times(spark, folder):
    return daily.sun_times(daily.sunny(obs(spark, folder), 0.2), M)


@query(f"WITH {_OBS} SELECT system_id, day, round(sum(slot * coalesce(value, 0)) / nullif(sum(coalesce(value, 0)), 0), 6) AS com FROM obs GROUP BY 1, 2")
def a_centre_of_mass(spark, folder):
    return daily.centre_of_mass(obs(spark, folder), M).withColumn("com", r(F.col("com")))


@query(f"""WITH {_OBS}, t AS (SELECT *, max(value) OVER (PARTITION BY system_id, day) AS top FROM obs),
d AS (SELECT system_id, day, max(top) AS top, sum(CASE WHEN value > 0.995 * top AND value > 0 THEN value ELSE 0 END) AS high, sum(CASE WHEN value > 0 THEN value ELSE 0 END) AS al FROM t GROUP BY 1, 2)
SELECT system_id, day, round(top / nullif(max(top) OVER (PARTITION BY system_id), 0), 6) AS stat1, round(high / nullif(al, 0), 6) AS stat2 FROM d""")
def a_clip_scores(spark, folder):
    return daily.clip_scores(obs(spark, folder)).select("system_id", "day", r(F.col("stat1")).alias("stat1"), r(F.col("stat2")).alias("stat2"))


@query(f"""WITH {_OBS}, t AS (SELECT *, max(value) OVER (PARTITION BY system_id, day) AS top, max(value) OVER (PARTITION BY system_id) AS sys FROM obs),
d AS (SELECT system_id, day, max(top) / max(sys) AS stat1, sum(CASE WHEN value > 0.995 * top AND value > 0 THEN value ELSE 0 END) / nullif(sum(CASE WHEN value > 0 THEN value ELSE 0 END), 0) AS stat2 FROM t GROUP BY 1, 2),
c AS (SELECT system_id, day, stat1 > 0.05 AND stat2 > 0.1 AND abs(stat1 - 1.0) < 0.0075 AS clipped FROM d)
SELECT t.system_id, t.day, slot, coalesce(clipped AND abs(value / nullif(sys, 0) - 1.0) < 0.01 AND value >= 0.98 * top, false) AS clipped_time FROM t JOIN c ON c.system_id = t.system_id AND c.day = t.day""")
def a_clipped_times(spark, folder):
    o = obs(spark, folder)
    masses = o.select("system_id").distinct().withColumn("point_masses", F.array(F.lit(1.0)))
    days = daily.clipped_days(daily.clip_scores(o), masses)
    return daily.clipped_times(o, days, masses).select("system_id", "day", "slot", "clipped_time")


@query(f"""WITH {_OBS}, t AS (SELECT system_id, day, max(value) AS top FROM obs GROUP BY 1, 2)
SELECT DISTINCT system_id, top, round(cume_dist() OVER (PARTITION BY system_id ORDER BY top), 9) AS share FROM t""")
def a_cdf(spark, folder):
    t = obs(spark, folder).groupBy("system_id", "day").agg(F.max("value").alias("top"))
    return daily.empirical_cdf(t, "top", ["system_id"]).withColumn("share", r(F.col("share"), 9))


@query(f"""WITH {_SCORES}, f AS (SELECT system_id, day, density > 0.3 AND density < 1.05 AS d, bends / nullif(max(bends) OVER (PARTITION BY system_id), 0) < 0.8 AS l, energy > 500 AS c FROM scores)
SELECT system_id, round(avg(CASE WHEN d AND l THEN 1.0 ELSE 0.0 END), 6) AS quality, round(avg(CASE WHEN c AND d AND l THEN 1.0 ELSE 0.0 END), 6) AS clearness FROM f GROUP BY 1""")
def a_data_set_scores(spark, folder):
    s = daily.smoothness(daily.daily_scores(obs(spark, folder), M)).select(
        "system_id", "day", F.col("density").alias("density_score"), (1 - F.col("smoothness")).alias("linearity"), (F.col("energy") > 500).alias("clear")
    )
    x = daily.data_set_scores(daily.day_flags(s, low=0.3, linear=0.8))
    return x.select("system_id", r(F.col("quality")).alias("quality"), r(F.col("clearness")).alias("clearness"))


@query(f"""WITH {_SCORES}, t AS (SELECT system_id, day, 1 - bends / nullif(max(bends) OVER (PARTITION BY system_id), 0) AS tc, energy / nullif(max(energy) OVER (PARTITION BY system_id), 0) AS de FROM scores),
w AS (SELECT system_id, day, CASE WHEN tc > 0.9 AND de > 0.8 THEN sqrt(tc * de) ELSE 0 END AS weight FROM t)
SELECT system_id, day, round(weight, 6) AS weight, weight >= 1e-3 AS clear FROM w""")
def f_clear_rule(spark, folder):
    s = daily.smoothness(daily.daily_scores(obs(spark, folder), M))
    de = F.col("energy") / F.nullif(F.max("energy").over(Window.partitionBy("system_id")), F.lit(0.0))
    w = daily.clear_weights(s.select("system_id", "day", F.col("smoothness").alias("tc"), de.alias("de")))
    return w.select("system_id", "day", r(F.col("weight")).alias("weight"), "clear")


@query(f"""WITH {_GRID}, d AS (SELECT *, slot BETWEEN 8 AND 16 AS daytime FROM grid)
SELECT system_id, round(1 - count(*) FILTER (WHERE value IS NULL) * 1.0 / count(*), 6) AS coverage FROM d WHERE daytime GROUP BY 1""")
def a_coverage(spark, folder):
    g = grid(spark, folder)
    return daily.coverage(g.withColumn("daytime", F.col("slot").between(8, 16)), g).withColumn("coverage", r(F.col("coverage")))


# --- windows


@query(f"""WITH {_GRID}, l AS (SELECT *, last_value(CASE WHEN value IS NOT NULL THEN slot END IGNORE NULLS) OVER b AS ls, last_value(value IGNORE NULLS) OVER b AS lv,
first_value(CASE WHEN value IS NOT NULL THEN slot END IGNORE NULLS) OVER a AS rs, first_value(value IGNORE NULLS) OVER a AS rv FROM grid
WINDOW b AS (PARTITION BY system_id, day ORDER BY slot ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY system_id, day ORDER BY slot ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT system_id, day, slot, round(coalesce(value, CASE WHEN rs > ls THEN lv + (rv - lv) * (slot - ls) / (rs - ls) END, CASE WHEN rs IS NULL THEN lv END), 6) AS filled FROM l""")
def w_interpolate(spark, folder):
    return daily.interpolate_days(grid(spark, folder)).select("system_id", "day", "slot", r(F.col("filled")).alias("filled"))


@query(f"""WITH {_OBS}, n AS (SELECT *, value - lag(value) OVER w AS l, lead(value) OVER w - value AS n FROM obs WINDOW w AS (PARTITION BY system_id, day ORDER BY slot))
SELECT system_id, day, slot, coalesce(abs(l - n) <= 1e-8 + 1e-5 * abs(n) AND value <> 0, false) AS infill FROM n""")
def w_infill(spark, folder):
    return daily.infill_mask(obs(spark, folder)).select("system_id", "day", "slot", "infill")


@query(f"""WITH {_OBS}, h AS (SELECT system_id, CAST(date_diff('day', DATE '2024-01-01', day) * 24 + slot AS BIGINT) AS t, value > 20 AS high FROM obs),
c AS (SELECT *, CASE WHEN high = lag(high) OVER w THEN 0 WHEN lag(high) OVER w IS NULL THEN 0 ELSE 1 END AS c FROM h WINDOW w AS (PARTITION BY system_id ORDER BY t)),
g AS (SELECT *, sum(c) OVER (PARTITION BY system_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM c)
SELECT system_id, CAST(run AS BIGINT) AS run, min(t) AS start, count(*) AS length, min(CAST(high AS INTEGER)) = 1 AS value FROM g GROUP BY 1, 2""")
def w_runs(spark, folder):
    o = obs(spark, folder).select("system_id", (F.date_diff("day", F.lit("2024-01-01").cast("date")) * 24 + F.col("slot")).cast("long").alias("t"), (F.col("value") > 20).alias("high"))
    return windows.runs(o, ["system_id"], "t", "high")


@query(f"""WITH {_DAILY} SELECT k, day, round((value - lag(value, 365) OVER (PARTITION BY k ORDER BY day)) / nullif(value, 0), 6) AS change FROM rev""")
def w_year_lag(spark, folder):
    return windows.lag_change(revenue(spark, folder), ["k"], "day", "value").select("k", "day", r(F.col("change")).alias("change"))


@query(f"""WITH {_DAILY}, c AS (SELECT k, (value - lag(value, 365) OVER (PARTITION BY k ORDER BY day)) / nullif(value, 0) AS change FROM rev) SELECT k, round(100 * quantile_cont(change, 0.5), 6) AS rate FROM c GROUP BY 1""")
def a_degradation_rate(spark, folder):
    return windows.degradation_rate(revenue(spark, folder), ["k"], "day", "value").select("k", r(F.col("rate")).alias("rate"))


@query("""WITH m AS (SELECT o_custkey, CAST(o_orderdate AS DATE) AS day, max(floor(o_totalprice / 100000)) AS level FROM orders GROUP BY 1, 2),
d AS (SELECT *, abs(level - lag(level) OVER (PARTITION BY o_custkey ORDER BY day)) AS d FROM m)
SELECT o_custkey, count(*) FILTER (WHERE d > 0) AS n_jumps, CAST(min(CASE WHEN d > 0 THEN d END) AS DOUBLE) AS least_jump FROM d GROUP BY 1""")
def w_jumps(spark, folder):
    m = table(spark, folder, "orders").groupBy("o_custkey", F.to_date("o_orderdate").alias("day")).agg(F.max(F.floor(F.col("o_totalprice") / 100000)).cast("double").alias("level"))
    return windows.jumps(m, ["o_custkey"], "day", "level")


@query("""WITH m AS (SELECT system, ts, min(p_mp) / 1000 AS v FROM pvpro_results WHERE p_mp IS NOT NULL AND NOT isnan(p_mp) AND system IS NOT NULL GROUP BY 1, 2),
b AS (SELECT *, round_even((v - first_value(v) OVER (PARTITION BY system ORDER BY ts)) / 0.05, 0) * 0.05 AS bucket FROM m)
SELECT system, ts, round(bucket, 4) AS bucket, CAST(dense_rank() OVER (PARTITION BY system ORDER BY bucket) - 1 AS INTEGER) AS label FROM b""")
def w_capacity_labels(spark, folder):
    m = table(spark, folder, "pvpro_results").filter("p_mp IS NOT NULL AND NOT isnan(p_mp) AND system IS NOT NULL").groupBy("system", "ts").agg((F.min("p_mp") / 1000).alias("v"))
    return windows.capacity_labels(m, ["system"], "ts", "v").select("system", "ts", r(F.col("bucket"), 4).alias("bucket"), "label")


@query(f"""WITH {_DAILY}, m AS (SELECT k, day, CASE WHEN count(*) OVER w = 7 THEN avg(value) OVER w END AS m FROM rev WINDOW w AS (PARTITION BY k ORDER BY day ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING))
SELECT k, day, round(coalesce(last_value(m IGNORE NULLS) OVER (PARTITION BY k ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(m IGNORE NULLS) OVER (PARTITION BY k ORDER BY day ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 3) AS mean FROM m""")
def w_rolling_mean(spark, folder):
    return windows.rolling_mean(revenue(spark, folder), ["k"], "day", "value", 3).select("k", "day", r(F.col("mean"), 3).alias("mean"))


@query("""WITH RECURSIVE o AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, CAST(value < 20 AS INTEGER) AS b FROM events),
s AS (SELECT user_id, i, CAST(1 - b AS DOUBLE) AS x, CAST(b AS DOUBLE) AS y FROM o WHERE i = 1
UNION ALL SELECT o.user_id, o.i, least(s.x, s.y + 2.0) + (1 - o.b), least(s.y, s.x + 2.0) + o.b FROM s JOIN o ON o.user_id = s.user_id AND o.i = s.i + 1)
SELECT user_id, i, y < x AS inside FROM s""")
def w_two_state(spark, folder):
    e = table(spark, folder, "events")
    i = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    low = (F.col("value") < 20).cast("double")
    rows = e.select("user_id", i.cast("long").alias("i"), (1 - low).alias("out"), low.alias("in"))
    return windows.two_state_labels(rows, ["user_id"], "i", "out", "in", 2.0)


@query("""WITH m AS (SELECT o_custkey AS c, o_orderkey AS o, CAST(o_totalprice > 200000 AS BOOLEAN) AS h, o_totalprice AS p FROM orders),
x AS (SELECT *, CASE WHEN coalesce(lag(h) OVER (PARTITION BY c ORDER BY o), false) = h THEN 0 ELSE 1 END AS d FROM m),
g AS (SELECT *, sum(d) OVER (PARTITION BY c ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS g FROM x),
k AS (SELECT *, row_number() OVER (PARTITION BY c, g ORDER BY p DESC, o) AS k FROM g WHERE h)
SELECT c, o, p FROM k WHERE k = 1""")
def w_reduce_clusters(spark, folder):
    m = table(spark, folder, "orders").select(F.col("o_custkey").alias("c"), F.col("o_orderkey").alias("o"), (F.col("o_totalprice") > 200000).alias("h"), F.col("o_totalprice").alias("p"))
    return windows.reduce_clusters(m, ["c"], "o", "h", "p")


@query("""WITH m AS (SELECT user_id AS u, event_id AS e, CAST(value >= 20 AS INTEGER) + CAST(value >= 40 AS INTEGER) AS v FROM events),
d AS (SELECT u, e, v - lag(v) OVER (PARTITION BY u ORDER BY e) AS d FROM m), f AS (SELECT * FROM d WHERE d IS NOT NULL),
s AS (SELECT *, CASE WHEN d <> 0 AND coalesce(lag(d) OVER w, 0) = 0 THEN 1 ELSE 0 END AS s, d <> 0 AND coalesce(lead(d) OVER w, 0) = 0 AS last FROM f WINDOW w AS (PARTITION BY u ORDER BY e)),
g AS (SELECT *, sum(s) OVER (PARTITION BY u ORDER BY e ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS g FROM s),
t AS (SELECT *, sum(CASE WHEN d <> 0 THEN d END) OVER (PARTITION BY u, g) AS t FROM g)
SELECT u, e, CAST(CASE WHEN last THEN t ELSE 0 END AS DOUBLE) AS pooled FROM t""")
def w_segment_differences(spark, folder):
    m = table(spark, folder, "events").select(F.col("user_id").alias("u"), F.col("event_id").alias("e"), ((F.col("value") >= 20).cast("double") + (F.col("value") >= 40).cast("double")).alias("v"))
    return windows.segment_differences(m, ["u"], "e", "v")


@query(f"""WITH {_DAILY} SELECT k, day, round(value, 2) AS value, round(sum(value) OVER w, 2) AS total, round(sum(value) OVER w - value, 2) AS start FROM rev WINDOW w AS (PARTITION BY k ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def w_running_total(spark, folder):
    x = windows.running_total(revenue(spark, folder), ["k"], "day", "value")
    return x.select("k", "day", *[r(F.col(c), 2).alias(c) for c in ("value", "total", "start")])


@query(f"""WITH {_OBS}, q AS (SELECT system_id, min(value) AS a, quantile_cont(value, 0.99) AS b FROM obs GROUP BY 1)
SELECT system_id, day, slot, round((value - a) / nullif(b - a, 0), 6) AS scaled, round(value, 6) AS value FROM obs JOIN q USING (system_id)""")
def m_scale_and_back(spark, folder):
    x = daily.quantile_scaled(obs(spark, folder)).drop("value")
    back = daily.quantile_unscaled(x.withColumn("kept", F.col("scaled")))
    return back.select("system_id", "day", "slot", r(F.col("kept")).alias("scaled"), r(F.col("value")).alias("value"))


@query(f"""WITH {_OBS}, t AS (SELECT system_id, max(value) * 0.2 AS least FROM obs GROUP BY 1)
SELECT obs.system_id, day, CAST(count(*) FILTER (WHERE value > least) AS DOUBLE) AS hours FROM obs JOIN t ON t.system_id = obs.system_id GROUP BY 1, 2""")
def a_hours_of_daylight(spark, folder):
    return studies.hours_of_daylight(obs(spark, folder), M, 0.2)


@query(f"WITH {_OBS} SELECT system_id, day, round(CASE WHEN quantile_cont(value, 0.9) > 0 THEN ln(quantile_cont(value, 0.9)) END, 6) AS metric FROM obs GROUP BY 1, 2")
def a_capacity_metric(spark, folder):
    return daily.capacity_metric(obs(spark, folder), 0.9).withColumn("metric", r(F.col("metric")))


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE extract(doy FROM o_orderdate) > 79 AND extract(doy FROM o_orderdate) < 172")
def f_day_range(spark, folder):
    return studies.day_range(table(spark, folder, "orders").select("o_orderkey", "o_orderdate"), 79, 172, "o_orderdate")


@query("""SELECT json_id, CASE WHEN regexp_full_match(z, '[0-9]{5}') THEN z END AS zip FROM (SELECT json_id, regexp_extract(json_extract_string(CASE WHEN json_valid(body) THEN body END, '$.Site.location'), '([0-9]{5})$', 1) AS z FROM site_json)""")
def x_zip_code(spark, folder):
    location = F.get_json_object("body", "$.Site.location")
    return table(spark, folder, "site_json").select("json_id", tables.zip_code(F.regexp_extract(location, "([0-9]{5})$", 1)).alias("zip"))


@query(f"""WITH {_OBS}, y AS (SELECT system_id, CAST(extract(doy FROM day) AS INTEGER) AS doy, avg(value) AS mean FROM obs GROUP BY 1, 2), e AS (SELECT system_id, doy, max(mean) AS seen FROM y WHERE doy % 3 = 0 GROUP BY 1, 2)
SELECT y.system_id, y.doy, round(mean, 6) AS mean, round(seen, 6) AS seen FROM y LEFT JOIN e ON e.system_id = y.system_id AND e.doy = y.doy""")
def j_year_with_empirical(spark, folder):
    y = obs(spark, folder).groupBy("system_id", F.dayofyear("day").alias("doy")).agg(F.avg("value").alias("mean"))
    seen = y.filter("doy % 3 = 0").withColumnRenamed("mean", "seen")
    x = studies.with_empirical(y, seen, ["system_id"])
    return x.select("system_id", "doy", r(F.col("mean")).alias("mean"), r(F.col("seen")).alias("seen"))


# --- re-binning and statistics


_SUN = "sun AS (SELECT system_id, day, 5.5 + (extract(day FROM day) % 4) * 0.3 AS sunrise, 18.25 - (extract(day FROM day) % 3) * 0.4 AS sunset FROM (SELECT DISTINCT system_id, day FROM obs))"


@query(f"""WITH {_OBS}, {_SUN}, t AS (SELECT system_id, day, k.k AS k, sunrise + k.k * (sunset - sunrise) / 20 AS t0, sunrise + (k.k + 1) * (sunset - sunrise) / 20 AS t1 FROM sun, generate_series(0, 19) AS k(k))
SELECT t.system_id, t.day, CAST(t.k AS INTEGER) AS k, round(sum(value * (least(t1, slot + 1) - greatest(t0, slot))) / max(t1 - t0), 6) AS value
FROM t JOIN obs ON obs.system_id = t.system_id AND obs.day = t.day AND slot < t1 AND slot + 1 > t0 GROUP BY 1, 2, 3""")
def j_dilate(spark, folder):
    o = obs(spark, folder)
    return rebin.dilate(o, sun_of(o), M, 20).withColumn("value", r(F.col("value")))


def sun_of(o: DataFrame) -> DataFrame:
    d = F.dayofmonth("day")
    return o.select("system_id", "day").distinct().select("system_id", "day", (5.5 + (d % 4) * 0.3).alias("sunrise"), (18.25 - (d % 3) * 0.4).alias("sunset"))


@query("""WITH f AS (SELECT l_returnflag, l_extendedprice AS p, 1 - l_discount AS d, 1 + l_tax AS t, CASE WHEN l_linestatus = 'F' THEN 0.9 ELSE 1.0 END AS s FROM lineitem),
x AS (SELECT l_returnflag, sum(p) AS s0, sum(p * d) AS sd, sum(p * t) AS st, sum(p * s) AS ss, sum(p * d * t) AS sdt, sum(p * d * s) AS sds, sum(p * t * s) AS sts, sum(p * d * t * s) AS sal FROM f GROUP BY 1)
SELECT l_returnflag, round(sal - s0, 2) AS total, round((sd - s0) / 3 + (sdt - st) / 6 + (sds - ss) / 6 + (sal - sts) / 3, 2) AS d,
round((st - s0) / 3 + (sdt - sd) / 6 + (sts - ss) / 6 + (sal - sds) / 3, 2) AS t, round((ss - s0) / 3 + (sds - sd) / 6 + (sts - st) / 6 + (sal - sdt) / 3, 2) AS s FROM x""")
def a_shapley(spark, folder):
    f = table(spark, folder, "lineitem").select("l_returnflag", F.col("l_extendedprice").alias("p"), (1 - F.col("l_discount")).alias("d"), (1 + F.col("l_tax")).alias("t"), F.when(F.col("l_linestatus") == "F", 0.9).otherwise(1.0).alias("s"))
    x = stats.shapley(f, ["l_returnflag"], ["d", "t", "s"], "p")
    return x.select("l_returnflag", *[r(F.col(c), 2).alias(c) for c in ("total", "d", "t", "s")])


@query("""WITH a AS (SELECT o_orderpriority, 2 * pi() * (extract(doy FROM o_orderdate) - 1) / 365.0 AS a FROM orders),
s AS (SELECT o_orderpriority, CAST(count(*) AS DOUBLE) AS n, sum(cos(a)) AS c, sum(sin(a)) AS s FROM a GROUP BY 1)
SELECT o_orderpriority, n, round(sqrt(c * c + s * s) / n, 6) AS r, round(exp(-(c * c + s * s) / n) * CASE WHEN n < 50 THEN NULL ELSE 1 END, 6) AS p FROM s""")
def a_rayleigh(spark, folder):
    a = table(spark, folder, "orders").select("o_orderpriority", (2 * F.pi() * (F.dayofyear("o_orderdate") - 1) / 365.0).alias("a"))
    return stats.rayleigh(a, ["o_orderpriority"], "a").select("o_orderpriority", "n", r(F.col("r")).alias("r"), r(F.col("p")).alias("p"))


@query("SELECT o_orderstatus, CAST(least(floor((2 * pi() * (extract(doy FROM o_orderdate) - 1) / 365.0) / (2 * pi() / 48)), 47) AS INTEGER) AS bin, count(*) AS n FROM orders GROUP BY 1, 2")
def a_circular_histogram(spark, folder):
    o = table(spark, folder, "orders").select("o_orderstatus", F.dayofyear("o_orderdate").alias("doy"))
    return stats.circular_histogram(o, ["o_orderstatus"], "doy")


@query("""WITH s AS (SELECT o_orderpriority, o_totalprice AS x, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice) AS k, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders),
h AS (SELECT *, (n + 1.0 / 3.0) * 0.025 + 1.0 / 3.0 AS h FROM s)
SELECT o_orderpriority, round(max(CASE WHEN k = CAST(floor(h) AS BIGINT) THEN x END) * (1 - (max(h) - floor(max(h)))) + max(CASE WHEN k = CAST(floor(h) AS BIGINT) + 1 THEN x END) * (max(h) - floor(max(h))), 4) AS q FROM h GROUP BY 1""")
def a_unbiased_quantile(spark, folder):
    q = stats.unbiased_quantile(table(spark, folder, "orders"), ["o_orderpriority"], "o_totalprice", {"q": 0.025})
    return q.select("o_orderpriority", r(F.col("q"), 4).alias("q"))


@query("""SELECT l_returnflag, count(*) AS n, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 2) AS intercept, round(corr(l_quantity, l_extendedprice), 8) AS corr,
round(sqrt(avg((l_quantity - l_extendedprice) * (l_quantity - l_extendedprice))), 4) AS rmse, round(avg(l_quantity - l_extendedprice), 4) AS mbe FROM lineitem GROUP BY 1""")
def a_regression(spark, folder):
    x = stats.regression(table(spark, folder, "lineitem"), ["l_returnflag"], "l_quantity", "l_extendedprice")
    return x.select("l_returnflag", "n", r(F.col("slope"), 4).alias("slope"), r(F.col("intercept"), 2).alias("intercept"), r(F.col("corr"), 8).alias("corr"), r(F.col("rmse"), 4).alias("rmse"), r(F.col("mbe"), 4).alias("mbe"))


@query("""SELECT round_even(l_quantity / 5.0, 0) * 5.0 AS bx, round(round_even(l_discount / 0.05, 0) * 0.05, 4) AS "by", round(avg(l_extendedprice), 4) AS value, count(*) AS n FROM lineitem GROUP BY 1, 2""")
def a_binned(spark, folder):
    b = stats.binned(table(spark, folder, "lineitem"), "l_quantity", "l_discount", "l_extendedprice", 5.0, 0.05)
    return b.select("bx", r(F.col("by"), 4).alias("by"), r(F.col("value"), 4).alias("value"), "n")


# --- solar functions


_D = "CAST(extract(doy FROM o_orderdate) AS DOUBLE)"
_B = f"(({_D} - 1) * 2 * pi() / 365)"
_EOT = f"(229.2 * (0.000075 + 0.001868 * cos{_B} - 0.032077 * sin{_B} - 0.014615 * cos(2 * {_B}) - 0.04089 * sin(2 * {_B})))"
_DEC = f"degrees(0.006918 - 0.399912 * cos{_B} + 0.070257 * sin{_B} - 0.006758 * cos(2 * {_B}) + 0.000907 * sin(2 * {_B}) - 0.002697 * cos(3 * {_B}) + 0.00148 * sin(3 * {_B}))"


@query(f"""SELECT DISTINCT CAST({_D} AS INTEGER) AS doy, round({_EOT}, 6) AS duffie,
round(9.87 * sin(2 * radians(({_D} - 81) * 360 / 364)) - 7.53 * cos(radians(({_D} - 81) * 360 / 364)) - 1.5 * sin(radians(({_D} - 81) * 360 / 364)), 6) AS da_rosa,
round(23.45 * sin(radians(({_D} + 284) * 360 / 365)), 6) AS cooper, round({_DEC}, 6) AS spencer,
round(degrees(acos(-tan(radians(37.5)) * tan(radians({_DEC})))) * 2 / 15, 6) AS daylight FROM orders""")
def m_sun_of_day(spark, folder):
    d = table(spark, folder, "orders").select(F.dayofyear("o_orderdate").alias("doy")).distinct()
    n = F.col("doy").cast("double")
    return d.select(
        "doy", r(solar.eot_duffie(n)).alias("duffie"), r(solar.eot_da_rosa(n)).alias("da_rosa"), r(solar.declination_cooper(n)).alias("cooper"),
        r(solar.declination_spencer(n)).alias("spencer"), r(solar.daylight_hours(F.lit(37.5), solar.declination_spencer(n))).alias("daylight"),
    )


@query(f"""WITH d AS (SELECT DISTINCT CAST({_D} AS INTEGER) AS doy, {_EOT} AS e, {_DEC} AS dec FROM orders), t AS (SELECT *, 15.0 * (10.0 - ((15.0 * -8 + 120) * 4 / 60 - e / 60) - 12.0) AS w FROM d)
SELECT doy, round(w, 6) AS omega, round(sin(radians(dec)) * sin(radians(37.5)) * cos(radians(20)) - sin(radians(dec)) * cos(radians(37.5)) * sin(radians(20)) * cos(radians(10)) + cos(radians(dec)) * cos(radians(37.5)) * cos(radians(20)) * cos(radians(w))
+ cos(radians(dec)) * sin(radians(37.5)) * sin(radians(20)) * cos(radians(10)) * cos(radians(w)) + cos(radians(dec)) * sin(radians(20)) * sin(radians(10)) * sin(radians(w)), 6) AS cos_theta,
round(degrees(asin(sin(radians(37.5)) * sin(radians(dec)) + cos(radians(37.5)) * cos(radians(dec)) * cos(radians(w)))), 6) AS elevation,
round((720.0 - 725 - e) / 4 + 15.0 * -8, 6) AS lon, round(degrees(atan(-cos(radians(7.5 * 11)) / tan(radians(dec)))), 4) AS lat,
CAST(CASE WHEN (doy + 10) % 365 <= 182 THEN (doy + 10) % 365 ELSE 365 - (doy + 10) % 365 END AS INTEGER) AS solstice FROM t""")
def m_geometry(spark, folder):
    d = table(spark, folder, "orders").select(F.dayofyear("o_orderdate").alias("doy")).distinct()
    n = F.col("doy").cast("double")
    eot, dec = solar.eot_duffie(n), solar.declination_spencer(n)
    w = solar.hour_angle(F.lit(10.0), F.lit(-120.0), F.lit(-8.0), eot)
    return d.select(
        "doy", r(w).alias("omega"), r(solar.cos_incidence(dec, F.lit(37.5), F.lit(20.0), F.lit(10.0), w)).alias("cos_theta"), r(solar.solar_position(dec, F.lit(37.5), w)[0]).alias("elevation"),
        r(solar.longitude_from_noon(F.lit(725.0), F.lit(-8.0), eot)).alias("lon"), r(solar.latitude_from_daylight(F.lit(11.0), dec), 4).alias("lat"), solar.solstice_index(F.col("doy")).cast("int").alias("solstice"),
    )


@query("""SELECT row_id, round_even(v_oc / 5.0, 0) * 5.0 AS near, round(ln(v_oc), 9) AS log_v FROM pvpro_results WHERE v_oc > 0 AND NOT isnan(v_oc)""")
def m_round_and_log(spark, folder):
    p = table(spark, folder, "pvpro_results").filter("v_oc > 0 AND NOT isnan(v_oc)")
    return p.select("row_id", solar.round_to(F.col("v_oc"), 5.0).alias("near"), r(F.ln("v_oc"), 9).alias("log_v"))


@query("""SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, concat('s_', event_type) AS label FROM events""")
def x_json_and_text(spark, folder):
    e = table(spark, folder, "events")
    return e.select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"), F.concat(F.lit("s_"), "event_type").alias("label"))


@query("""SELECT file_id, regexp_extract(file_id, '^([0-9]+)_([0-9]+)', 1) AS site, regexp_extract(file_id, '^([0-9]+)_([0-9]+)', 2) AS system, count(*) AS n FROM raw_lines GROUP BY 1""")
def x_file_ids(spark, folder):
    f = table(spark, folder, "raw_lines").groupBy("file_id").agg(F.count("*").alias("n"))
    return f.select("file_id", F.regexp_extract("file_id", "^([0-9]+)_([0-9]+)", 1).alias("site"), F.regexp_extract("file_id", "^([0-9]+)_([0-9]+)", 2).alias("system"), "n")


@query("""SELECT key_field_0, get_data_error = 'No error' AS ok, count(*) AS n, count(DISTINCT key_field_1) AS systems, round(sum(CASE WHEN NOT isnan(runtimes) THEN runtimes END), 4) AS seconds FROM runner_summary GROUP BY 1, 2""")
def p_fleet_summary(spark, folder):
    s = table(spark, folder, "runner_summary")
    return s.groupBy("key_field_0", (F.col("get_data_error") == "No error").alias("ok")).agg(
        F.count("*").alias("n"), F.countDistinct("key_field_1").alias("systems"), r(F.sum(F.when(~F.isnan("runtimes"), F.col("runtimes"))), 4).alias("seconds")
    )
