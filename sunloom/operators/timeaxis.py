"""Time axes: cleaning, sampling, the regular grid, clock changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def seconds(ts: Column) -> Column:
    """Seconds since 1970 of a timestamp without zone."""
    t = ts.cast("timestamp_ntz")
    return F.unix_date(F.to_date(t)).cast("long") * 86_400 + F.timestamp_diff("SECOND", F.to_date(t).cast("timestamp_ntz"), t)


def at_seconds(s: Column) -> Column:
    """The timestamp without zone of seconds since 1970."""
    return F.timestamp_add("SECOND", s, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))


def drop_future(df: DataFrame, now: Column, ts: str = "ts") -> DataFrame:
    """Rows up to ``now``; rows without a time stay."""
    return df.filter(F.col(ts).isNull() | (F.col(ts) <= now))


def enough_values(df: DataFrame, keys: list[str], value: str = "value", least: int = 24) -> DataFrame:
    """(keys, n, enough): whether each source has the least number of values of at least 0."""
    n = F.count_if(F.col(value) >= 0)
    return df.groupBy(*keys).agg(n.alias("n")).withColumn("enough", F.col("n") >= least)


def clip_range(value: Column, low: float | None = -5.0, high: float | None = None) -> Column:
    """The value, or null outside the range (and for NaN)."""
    ok = ~F.isnan(value)
    if low is not None:
        ok &= value >= low
    if high is not None:
        ok &= value <= high
    return F.when(ok, value)


def first_of_each_time(df: DataFrame, keys: list[str], order: list[str], ts: str = "ts") -> DataFrame:
    """The first row of each time of a source in a stated order; rows without a time are dropped.

    One aggregation with partial results, no sort.
    """
    others = [c for c in df.columns if c not in (*keys, ts)]
    first = F.min_by(F.struct(*others), F.struct(*order)).alias("r")
    return df.filter(F.col(ts).isNotNull()).groupBy(*keys, ts).agg(first).select(*keys, ts, *[F.col("r")[c].alias(c) for c in others])


def gap_seconds(df: DataFrame, keys: list[str], ts: str = "ts") -> DataFrame:
    """Rows with ``gap``, the seconds since the row before, rounded to tens, halves to the even one; rows without a time are dropped.

    Rows are ordered within days; the last time of the day before that has one comes from
    one small row a day, so a dense source spreads over as many tasks as it has days.
    """
    s = seconds(F.col(ts))
    rows = df.filter(F.col(ts).isNotNull()).withColumns({"_s": s, "_day": F.to_date(ts)})
    ends = rows.groupBy(*keys, "_day").agg(F.max("_s").alias("_last"))
    before = F.lag("_last").over(Window.partitionBy(*keys).orderBy("_day"))
    carried = ends.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_day").alias("_on"), before.alias("_carried"))
    same = F.col("_day") == F.col("_on")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_{k}"))
    within = F.lag("_s").over(Window.partitionBy(*keys, "_day").orderBy("_s"))
    gap = (F.bround((F.col("_s") - F.coalesce(within, F.col("_carried"))) / 10.0) * 10).cast("long")
    return rows.join(carried, same).withColumn("gap", gap).select(*df.columns, "gap")


def common_gaps(df: DataFrame, keys: list[str], ts: str = "ts", share: float = 0.05) -> DataFrame:
    """(keys, gap, n, share, is_mode): gaps of more than ``share`` of a source's rows, and the most frequent one (of equal ones the smallest)."""
    counts = gap_seconds(df, keys, ts).filter("gap IS NOT NULL").groupBy(*keys, "gap").agg(F.count("*").alias("n"))
    by = Window.partitionBy(*keys)
    ranked = counts.withColumns({"share": F.col("n") / F.sum("n").over(by), "r": F.row_number().over(by.orderBy(F.desc("n"), "gap"))})
    return ranked.filter((F.col("share") > share) | (F.col("r") == 1)).select(*keys, "gap", "n", "share", (F.col("r") == 1).alias("is_mode"))


def daily_scan_rates(df: DataFrame, keys: list[str], ts: str = "ts") -> DataFrame:
    """(keys, day, rate, changes): median gap of each day, and whether it differs from the day's before."""
    day = gap_seconds(df, keys, ts).filter("gap IS NOT NULL").groupBy(*keys, F.to_date(ts).alias("day")).agg(F.percentile("gap", F.lit(0.5)).alias("rate"))
    before = F.lag("rate").over(Window.partitionBy(*keys).orderBy("day"))
    return day.withColumn("changes", F.coalesce(F.col("rate") != before, F.lit(False)))


def nearest_on_grid(df: DataFrame, keys: list[str], step_s: int, ts: str = "ts", value: str = "value", with_own: bool = False) -> DataFrame:
    """(keys, slot, value): each reading on its grid point, or on the one free grid point next to it on either side.

    A grid point takes the nearest of its candidates, at equal distance the later one.
    A reading is a candidate for its own grid point, for the first one after it before
    the next reading, and for the last one before it after the reading before; so no
    range join is needed.  ``with_own`` adds whether the reading is of the grid point's day.
    """
    shard_s = max(86_400, step_s)
    shard = F.floor(F.col("s") / shard_s)
    rows = df.filter(F.col(ts).isNotNull()).select(*keys, seconds(F.col(ts)).alias("s"), F.col(value).alias("v"))
    # Each day for itself, with the readings of its neighbours that are within a step of it.
    near = F.array_distinct(F.array(F.floor((F.col("s") - step_s) / shard_s), shard, F.floor((F.col("s") + step_s) / shard_s)))
    parts = rows.select(*keys, "s", "v", shard.alias("own"), F.explode(near).alias("shard"))
    w = Window.partitionBy(*keys, "shard").orderBy("s")
    seen = parts.withColumns({"before": F.lag("s").over(w), "after": F.lead("s").over(w)}).filter(F.col("own") == F.col("shard"))
    s, f = F.col("s"), F.lit(step_s)
    up, down = (F.floor(s / f) + 1) * f, (F.ceil(s / f) - 1) * f
    own = F.when(s % f == 0, s)
    later = F.when(F.col("after").isNull() | (up < F.col("after")), up)
    earlier = F.when(F.col("before").isNull() | (down > F.col("before")), down)
    spread = seen.select(*keys, "s", "v", F.explode(F.array_distinct(F.array(own, later, earlier))).alias("slot")).filter("slot IS NOT NULL")
    best = F.min_by(F.struct("v", "s"), F.struct(F.abs(F.col("slot") - F.col("s")).alias("far"), (-F.col("s")).alias("late")))
    own_day = F.floor(F.col("best.s") / 86_400) == F.floor(F.col("slot") / 86_400)
    placed = spread.groupBy(*keys, "slot").agg(best.alias("best"))
    return placed.select(*keys, at_seconds(F.col("slot")).alias("slot"), F.col("best.v").alias(value), *([own_day.alias("own")] if with_own else []))


def full_grid(df: DataFrame, keys: list[str], step_s: int, ts: str = "ts") -> DataFrame:
    """All grid points of each source, from the midnight of its first day to the midnight after its last, that excluded."""
    span = df.filter(F.col(ts).isNotNull()).groupBy(*keys).agg(F.to_date(F.min(ts)).alias("a"), F.to_date(F.max(ts)).alias("b"))
    day = span.select(*keys, F.explode(F.sequence("a", "b")).alias("day"))
    at = F.sequence(F.lit(0), F.lit(86_400 - step_s), F.lit(step_s))
    return day.select(*keys, "day", F.explode(at).alias("s")).select(*keys, F.timestamp_add("SECOND", F.col("s"), F.col("day").cast("timestamp_ntz")).alias("slot"))


def standardize(df: DataFrame, keys: list[str], step_s: int, order: list[str], ts: str = "ts", value: str = "value") -> DataFrame:
    """The regular series of each source on its grid, null where no reading is near."""
    clean = first_of_each_time(df.select(*keys, ts, value, *[c for c in order if c not in (*keys, ts, value)]), keys, order, ts)
    return full_grid(df, keys, step_s, ts).join(nearest_on_grid(clean, keys, step_s, ts, value), [*keys, "slot"], "left")


def embed(df: DataFrame, keys: list[str], step_s: int, slot: str = "slot", value: str = "value") -> DataFrame:
    """(keys, day, i, value): the (day, slot of the day) coordinates of a regular series, without empty days at either end."""
    out = df.select(*keys, F.to_date(slot).alias("day"), F.floor((seconds(F.col(slot)) % 86_400) / step_s).cast("int").alias("i"), F.col(value).alias("value"))
    seen = F.when(F.col("value").isNotNull(), F.col("day"))
    ends = out.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.min(seen).alias("a"), F.max(seen).alias("b"))
    same = F.col("day").between(F.col("a"), F.col("b"))
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_{k}"))
    return out.join(ends, same).select(*out.columns)


def average_day_shift(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, noon, shift): the centre of the average day's bright hours and the whole hours to move it to noon, 0 within four hours.

    Expects (keys, hour, value).
    """
    mean = df.groupBy(*keys, "hour").agg(F.avg("value").alias("v"))
    by = Window.partitionBy(*keys)
    scaled = mean.withColumn("x", (F.col("v") - F.min("v").over(by)) / F.nullif(F.max("v").over(by) - F.min("v").over(by), F.lit(0.0)))
    noon = scaled.filter("x > 0.5").groupBy(*keys).agg(F.avg("hour").alias("noon"))
    return noon.withColumn("shift", F.when(F.abs(12 - F.col("noon")) > 4, F.bround(12 - F.col("noon"))).otherwise(0).cast("int"))


def remove_daylight_time(ts: Column, zone: str, offset_hours: float) -> Column:
    """Clock time of a zone as fixed standard time; null for hours that don't exist or occur twice."""
    utc = F.convert_timezone(F.lit(zone), F.lit("UTC"), ts.cast("timestamp_ntz"))
    back = F.convert_timezone(F.lit("UTC"), F.lit(zone), utc)
    hour = F.expr("INTERVAL 1 HOUR")
    later = F.convert_timezone(F.lit("UTC"), F.lit(zone), utc + hour)
    earlier = F.convert_timezone(F.lit("UTC"), F.lit(zone), utc - hour)
    once = (back == ts) & (later != ts) & (earlier != ts)
    return F.when(once, F.timestamp_add("MINUTE", F.lit(int(round(offset_hours * 60))), utc))
