"""Statistics of (day, slot) data: daytime, filling, quality, clear days, clipping.

Input is ``obs(system_id, day, slot, value)`` with ``m`` slots a day.  All of it is
aggregation and windows within a day; statistics of a whole system are joined back as
small rows, which callers that have them pass as ``quantiles``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sunloom.operators import ranks

KEYS = ["system_id"]


def _day():
    """The slots of a day in order; windows need a session, so not at import."""
    return Window.partitionBy("system_id", "day").orderBy("slot")


def system_quantiles(obs: DataFrame) -> DataFrame:
    """(system_id, capacity, q99, q05, low): exact quantiles with linear interpolation and the least value, nulls left out; systems without values have no row."""
    q = ranks.quantiles(obs, KEYS, "value", {"capacity": 0.95, "q99": 0.99, "q05": 0.05, "low": 0.0})
    return q.select(*KEYS, "capacity", "q99", "q05", "low")


def sunny(obs: DataFrame, threshold: float = 0.005, quantiles: DataFrame | None = None) -> DataFrame:
    """obs with ``sun``: whether a value is above the threshold, scaled by the system's range."""
    q = (quantiles or system_quantiles(obs)).select(*KEYS, "q99", F.greatest("low", -0.005 * F.col("q99")).alias("floor"))
    return obs.join(q, KEYS).withColumn("sun", F.coalesce((F.col("value") - F.col("floor")) / F.col("q99") > threshold, F.lit(False))).drop("q99", "floor")


def daytime(obs: DataFrame, threshold: float = 0.1, quantiles: DataFrame | None = None) -> DataFrame:
    """obs with ``daytime``: values from the threshold on, scaled by the 5 and 95 % quantiles."""
    q = (quantiles or system_quantiles(obs)).select(*KEYS, "capacity", "q05")
    scaled = (F.col("value") - F.col("q05")) / F.nullif(F.col("capacity") - F.col("q05"), F.lit(0.0))
    return obs.join(q, KEYS).withColumn("daytime", F.coalesce(scaled >= threshold, F.lit(False))).drop("capacity", "q05")


def quantile_scaled(obs: DataFrame, low: float = 0.0, high: float = 0.99) -> DataFrame:
    """obs with ``scaled``, 0 at the lower and 1 at the higher quantile of the system, and both quantiles ``at_low`` and ``at_high``."""
    q = ranks.quantiles(obs, KEYS, "value", {"at_low": low, "at_high": high}).drop("n")
    return obs.join(q, KEYS).withColumn("scaled", (F.col("value") - F.col("at_low")) / F.nullif(F.col("at_high") - F.col("at_low"), F.lit(0.0)))


def quantile_unscaled(scaled: DataFrame) -> DataFrame:
    """The inverse of ``quantile_scaled``: ``value`` from ``scaled``."""
    return scaled.withColumn("value", F.col("at_low") + F.col("scaled") * (F.col("at_high") - F.col("at_low"))).drop("scaled", "at_low", "at_high")


def capacity_metric(obs: DataFrame, quantile: float = 1.0) -> DataFrame:
    """(system_id, day, metric): logarithm of a quantile of each day's values, null where it isn't positive."""
    q = F.max("value") if quantile == 1.0 else F.percentile("value", F.lit(quantile))
    day = obs.groupBy(*KEYS, "day").agg(q.alias("q"))
    return day.select(*KEYS, "day", F.when(F.col("q") > 0, F.ln("q")).alias("metric"))


def sun_times(marked: DataFrame, m: int) -> DataFrame:
    """(system_id, day, sunrise, sunset, noon) in hours from the first and last sunny slot; null where that is the day's border."""
    first, last = F.min(F.when(F.col("sun"), F.col("slot"))), F.max(F.when(F.col("sun"), F.col("slot")))
    t = marked.groupBy(*KEYS, "day").agg(first.alias("a"), last.alias("b")).select(
        *KEYS, "day", F.when(F.col("a") > 0, F.col("a") * 24.0 / m).alias("sunrise"), F.when(F.col("b") < m - 1, F.col("b") * 24.0 / m).alias("sunset")
    )
    return t.withColumn("noon", (F.col("sunrise") + F.col("sunset")) / 2)


def centre_of_mass(obs: DataFrame, m: int) -> DataFrame:
    """(system_id, day, com): the hour around which a day's energy lies; null without energy."""
    v = F.coalesce("value", F.lit(0.0))
    return obs.groupBy(*KEYS, "day").agg((F.sum(F.col("slot") * 24.0 / m * v) / F.nullif(F.sum(v), F.lit(0.0))).alias("com"))


def zero_night(value: Column, night: Column) -> Column:
    """Negative values and missing ones at night as 0."""
    return F.when(value < 0, 0.0).when(night & value.isNull(), 0.0).otherwise(value)


def interpolate_days(obs: DataFrame, value: str = "value") -> DataFrame:
    """obs with ``filled``: linear between the neighbouring values of a day; the end takes the last value, the start stays null."""
    seen = F.when(F.col(value).isNotNull(), F.struct("slot", F.col(value).alias("v")))
    marked = obs.withColumns({"l": F.last(seen, True).over(_day().rowsBetween(Window.unboundedPreceding, 0)), "r": F.first(seen, True).over(_day().rowsBetween(0, Window.unboundedFollowing))})
    span = F.col("r.slot") - F.col("l.slot")
    line = F.when(span > 0, F.col("l.v") + (F.col("r.v") - F.col("l.v")) * (F.col("slot") - F.col("l.slot")) / span)
    end = F.when(F.col("r").isNull(), F.col("l.v"))
    return marked.withColumn("filled", F.coalesce(F.col(value), line, end)).drop("l", "r")


def daily_scores(obs: DataFrame, m: int, quantiles: DataFrame | None = None) -> DataFrame:
    """(system_id, day, density, energy, smoothness, top, missing_share, is_missing): one pass of aggregation over windows of the day."""
    cap = (quantiles or system_quantiles(obs)).select(*KEYS, "capacity")
    bend = F.abs(F.lag("value").over(_day()) - 2 * F.col("value") + F.lead("value").over(_day()))
    v = F.coalesce("value", F.lit(0.0))
    return (
        obs.withColumn("bend", bend)
        .join(cap, KEYS)
        .groupBy(*KEYS, "day")
        .agg(
            (F.count_if(v > 0.02 * F.col("capacity")) / m).alias("density"),
            (F.sum(v) * 24 / m).alias("energy"),
            F.sum("bend").alias("bends"),
            F.max("value").alias("top"),
            (F.count_if(v > 0.005 * F.col("capacity")) / m).alias("lit_share"),
        )
        .withColumn("is_missing", F.col("lit_share") <= 0.2)
    )


def smoothness(scores: DataFrame) -> DataFrame:
    """Adds 1 - bends / the largest bends of the system."""
    return scores.withColumn("smoothness", 1 - F.col("bends") / F.nullif(F.max("bends").over(Window.partitionBy(*KEYS)), F.lit(0.0)))


def linearity(obs: DataFrame, m: int, quantiles: DataFrame | None = None) -> DataFrame:
    """(system_id, day, step, n, linearity): the most frequent first difference of a day, rounded to 4 digits; values under .005 of capacity left out, of equal counts the smallest step."""
    cap = (quantiles or system_quantiles(obs)).select(*KEYS, "capacity")
    lit = obs.join(cap, KEYS).withColumn("v", F.when(F.col("value") >= 0.005 * F.col("capacity"), F.col("value")))
    steps = lit.withColumn("step", F.bround(F.col("v") - F.lag("v").over(_day()), 4)).filter("step IS NOT NULL")
    counts = steps.groupBy(*KEYS, "day", "step").agg(F.count("*").alias("n"))
    # The largest count with the smallest step in one aggregation.
    top = F.max_by(F.struct("n", "step"), F.struct("n", (-F.col("step")).alias("s")))
    return counts.groupBy(*KEYS, "day").agg(top.alias("t")).select(*KEYS, "day", F.col("t.step").alias("step"), F.col("t.n").alias("n"), (F.col("t.n") / (m - 1)).alias("linearity"))


def infill_mask(obs: DataFrame) -> DataFrame:
    """obs with ``infill``: values that lie on a line with both neighbours."""
    left = F.col("value") - F.lag("value").over(_day())
    right = F.lead("value").over(_day()) - F.col("value")
    close = F.abs(left - right) <= 1e-8 + 1e-5 * F.abs(right)
    return obs.withColumn("infill", F.coalesce(close & (F.col("value") != 0), F.lit(False)))


def day_flags(scores: DataFrame, low: float = 0.6, high: float = 1.05, linear: float = 0.1) -> DataFrame:
    """Boolean flags of days with ``density_score``, ``linearity`` and ``clear``: density, linearity, no_errors, clear, cloudy."""
    d = F.col("density_score").between(low, high) & (F.col("density_score") > low) & (F.col("density_score") < high)
    return scores.withColumns({"density_ok": d, "linearity_ok": F.col("linearity") < linear}).withColumn(
        "no_errors", F.col("density_ok") & F.col("linearity_ok")
    ).withColumns({"is_clear": F.col("clear") & F.col("no_errors"), "is_cloudy": ~F.col("clear") & F.col("no_errors")})


def clear_weights(scores: DataFrame, smooth: str = "tc", energy: str = "de") -> DataFrame:
    """Adds ``weight`` and ``clear`` by the rule smoothness > .9 and energy > .8, weight sqrt of their product."""
    both = (F.col(smooth) > 0.9) & (F.col(energy) > 0.8)
    return scores.withColumn("weight", F.when(both, F.sqrt(F.col(smooth) * F.col(energy))).otherwise(0.0)).withColumn("clear", F.col("weight") >= 1e-3)


def iqr_filter(df: DataFrame, keys: list[str], value: str, width: float = 1.5) -> DataFrame:
    """Rows whose value lies within ``width`` interquartile ranges of the quartiles of its group."""
    q = ranks.quantiles(df, keys, value, {"_q1": 0.25, "_q3": 0.75}).drop("n")
    span = width * (F.col("_q3") - F.col("_q1"))
    return df.join(q, keys).filter(F.col(value).between(F.col("_q1") - span, F.col("_q3") + span)).drop("_q1", "_q3")


def clip_scores(obs: DataFrame) -> DataFrame:
    """(system_id, day, stat1, stat2): the day's maximum over the system's, and the share of energy within .5 % of the day's maximum."""
    top = obs.withColumn("top", F.max("value").over(Window.partitionBy("system_id", "day")))
    v = F.when(F.col("value") > 0, F.col("value")).otherwise(0.0)
    day = top.groupBy(*KEYS, "day").agg(F.max("top").alias("top"), F.sum(F.when(F.col("value") > 0.995 * F.col("top"), v).otherwise(0.0)).alias("high"), F.sum(v).alias("all"))
    return day.select(
        *KEYS, "day", (F.col("top") / F.nullif(F.max("top").over(Window.partitionBy(*KEYS)), F.lit(0.0))).alias("stat1"), (F.col("high") / F.nullif(F.col("all"), F.lit(0.0))).alias("stat2")
    )


def clipped_days(scores: DataFrame, masses: DataFrame) -> DataFrame:
    """Adds ``clipped`` to clip scores, given ``masses`` (system_id, point_masses array<double>)."""
    near = F.exists(F.coalesce("point_masses", F.array().cast("array<double>")), lambda p: F.abs(F.col("stat1") - p) < 0.0075)
    return scores.join(masses, KEYS, "left").withColumn("clipped", (F.col("stat1") > 0.05) & (F.col("stat2") > 0.1) & near).drop("point_masses")


def clipped_times(obs: DataFrame, days: DataFrame, masses: DataFrame) -> DataFrame:
    """obs with ``clipped_time``: on clipped days, near a point mass of the system and from .98 of the day's maximum on."""
    top = F.max("value").over(Window.partitionBy("system_id", "day"))
    scaled = F.col("value") / F.nullif(F.max("value").over(Window.partitionBy("system_id")), F.lit(0.0))
    near = F.exists(F.coalesce("point_masses", F.array().cast("array<double>")), lambda p: F.abs(F.col("scaled") - p) < 0.01)
    marked = obs.withColumns({"top": top, "scaled": scaled}).join(days.select(*KEYS, "day", "clipped"), [*KEYS, "day"], "left").join(masses, KEYS, "left")
    return marked.withColumn("clipped_time", F.coalesce(F.col("clipped") & near & (F.col("value") >= 0.98 * F.col("top")), F.lit(False))).drop("top", "scaled", "clipped", "point_masses")


def empirical_cdf(scores: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """(keys, value, share): the points of each group's empirical distribution function."""
    by = Window.partitionBy(*keys)
    return scores.filter(F.col(value).isNotNull()).select(*keys, value, F.cume_dist().over(by.orderBy(value)).alias("share")).distinct()


def data_set_scores(flags: DataFrame) -> DataFrame:
    """(system_id, quality, clearness, clipped_share): shares of days by flag."""
    share = lambda c: F.avg(F.col(c).cast("double"))
    return flags.groupBy(*KEYS).agg(share("no_errors").alias("quality"), share("is_clear").alias("clearness"))


def coverage(obs: DataFrame, other: DataFrame) -> DataFrame:
    """(system_id, coverage): share of the daytime slots of ``obs`` (with ``daytime``) at which ``other`` has a value."""
    both = obs.join(other.select(*KEYS, "day", "slot", F.col("value").alias("other")), [*KEYS, "day", "slot"], "left")
    return both.filter("daytime").groupBy(*KEYS).agg((1 - F.count_if(F.col("other").isNull()) / F.count("*")).alias("coverage"))
