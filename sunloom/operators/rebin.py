"""Re-binning of daily signals over interval overlap, without a range join.

A day's daylight, whatever its length, is cut into ``n`` equal bins (dilation) and back.
Both directions weight by overlap, so energy is kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def overlap_rebin(source: DataFrame, target: DataFrame, keys: list[str], width: float) -> DataFrame:
    """(keys, k, value): mean of source intervals over each target interval, weighted by overlap.

    source: (keys, s0, s1, value) with intervals no longer than ``width``; target: (keys, k, t0, t1).
    Target intervals are spread over the cells of ``width`` that they touch, one more on
    the left, and joined to the source by the cell of its start: an equi-join.
    """
    cell = lambda c: F.floor(F.col(c) / width)
    spread = target.withColumn("cell", F.explode(F.sequence(cell("t0") - 1, cell("t1"))))
    joined = spread.join(source.withColumn("cell", cell("s0")), [*keys, "cell"])
    part = F.least("t1", "s1") - F.greatest("t0", "s0")
    return (
        joined.filter(part > 0)
        .groupBy(*keys, "k")
        .agg((F.sum(F.col("value") * part) / F.max(F.col("t1") - F.col("t0"))).alias("value"))
    )


def dilated_grid(sun: DataFrame, n: int) -> DataFrame:
    """(system_id, day, k, t0, t1): n equal bins from sunrise to sunset."""
    k = F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    length = (F.col("sunset") - F.col("sunrise")) / n
    return sun.filter("sunset > sunrise").select("system_id", "day", k.alias("k"), "sunrise", length.alias("w")).select(
        "system_id", "day", "k", (F.col("sunrise") + F.col("k") * F.col("w")).alias("t0"), (F.col("sunrise") + (F.col("k") + 1) * F.col("w")).alias("t1")
    )


def dilate(obs: DataFrame, sun: DataFrame, m: int, n: int) -> DataFrame:
    """Signals of equal length for all days: (system_id, day, k, value)."""
    h = 24.0 / m
    source = obs.filter("value IS NOT NULL").select("system_id", "day", (F.col("slot") * h).alias("s0"), ((F.col("slot") + 1) * h).alias("s1"), "value")
    return overlap_rebin(source, dilated_grid(sun, n), ["system_id", "day"], h)


def undilate(dilated: DataFrame, sun: DataFrame, m: int, n: int) -> DataFrame:
    """Back to slots of the day: (system_id, day, slot, value); slots without daylight are 0."""
    h = 24.0 / m
    source = dilated.join(dilated_grid(sun, n), ["system_id", "day", "k"]).select("system_id", "day", F.col("t0").alias("s0"), F.col("t1").alias("s1"), "value")
    slots = sun.select("system_id", "day", F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias("k")).withColumns({"t0": F.col("k") * h, "t1": (F.col("k") + 1) * h})
    back = overlap_rebin(source, slots, ["system_id", "day"], max(h, 24.0 / n))
    return slots.select("system_id", "day", "k").join(back, ["system_id", "day", "k"], "left").select("system_id", "day", F.col("k").alias("slot"), F.coalesce("value", F.lit(0.0)).alias("value"))


def add_sunset_point(dilated: DataFrame, kind: str = "linear") -> DataFrame:
    """One more point after each day's last: on the line of its last two (at least 0), or zero."""
    by = Window.partitionBy("system_id", "day").orderBy(F.desc("k"))
    last = dilated.select("system_id", "day", "k", "value", F.lead("value").over(by).alias("before"), F.row_number().over(by).alias("r")).filter("r = 1")
    value = F.lit(0.0) if kind == "zero" else F.greatest(F.lit(0.0), 2 * F.col("value") - F.coalesce("before", "value"))
    return dilated.select("system_id", "day", "k", "value").unionByName(last.select("system_id", "day", (F.col("k") + 1).alias("k"), value.alias("value")))


def resample_daylight(marked: DataFrame, n: int) -> DataFrame:
    """(system_id, day, k, value): linear interpolation of each day's slots with ``sun`` onto n points from the first to the last."""
    day = Window.partitionBy("system_id", "day")
    lit = marked.filter("sun AND value IS NOT NULL").withColumns({"a": F.min("slot").over(day), "b": F.max("slot").over(day), "next": F.lead("slot").over(day.orderBy("slot")), "next_v": F.lead("value").over(day.orderBy("slot"))})
    x = lambda s: (s - F.col("a")) / F.nullif(F.col("b") - F.col("a"), F.lit(0)) * (n - 1)
    cells = lit.select("system_id", "day", "value", "next_v", x(F.col("slot")).alias("x0"), x(F.col("next")).alias("x1"))
    # Each stretch between two readings gives the points in it, its right end only if it is the last.
    points = cells.filter("x0 IS NOT NULL").withColumn("k", F.explode(F.sequence(F.ceil("x0"), F.greatest(F.ceil("x0"), F.when(F.col("x1").isNull(), F.ceil("x0")).otherwise(F.ceil("x1") - 1)))))
    inside = points.filter((F.col("k") >= F.col("x0")) & (F.col("x1").isNull() | (F.col("k") < F.col("x1"))))
    line = F.when(F.col("x1").isNull(), F.col("value")).otherwise(F.col("value") + (F.col("next_v") - F.col("value")) * (F.col("k") - F.col("x0")) / (F.col("x1") - F.col("x0")))
    return inside.select("system_id", "day", F.col("k").cast("int").alias("k"), line.alias("value")).filter(F.col("k") < n)


def undo_daylight(resampled: DataFrame, marked: DataFrame, n: int) -> DataFrame:
    """Back from ``n`` points of each day's light to its slots: (system_id, day, slot, value), linear between the points, 0 outside the light."""
    ends = marked.filter("sun AND value IS NOT NULL").groupBy("system_id", "day").agg(F.min("slot").alias("a"), F.max("slot").alias("b"))
    slots = marked.select("system_id", "day", "slot").join(ends, ["system_id", "day"], "left")
    x = (F.col("slot") - F.col("a")) / F.nullif(F.col("b") - F.col("a"), F.lit(0)) * (n - 1)
    placed = slots.withColumns({"x": x, "k": F.least(F.floor(x), F.lit(n - 2)).cast("int")}).filter(F.col("slot").between(F.col("a"), F.col("b")))
    low, high = resampled.select("system_id", "day", "k", F.col("value").alias("v0")), resampled.select("system_id", "day", (F.col("k") - 1).alias("k"), F.col("value").alias("v1"))
    met = placed.join(low, ["system_id", "day", "k"]).join(high, ["system_id", "day", "k"])
    back = met.select("system_id", "day", "slot", (F.col("v0") + (F.col("v1") - F.col("v0")) * (F.col("x") - F.col("k"))).alias("back"))
    return slots.select("system_id", "day", "slot").join(back, ["system_id", "day", "slot"], "left").select("system_id", "day", "slot", F.coalesce("back", F.lit(0.0)).alias("value"))
