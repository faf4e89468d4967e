"""Irregular readings of many sources onto regular grids.

Each source (site, sensor) is cut into time shards of one day.  A shard is reduced
to the distinct times of its readings and to a summary (first and last reading,
typical distance).  The summaries of a source, one small row a day, give its step,
its first and last day and, by a prefix scan over the days, the state carried over
each shard's borders: the last reading before and the first after it.  With its
carried state each shard is filled for itself, so a source with very many readings
spreads over as many tasks as it has days.

Defined results
* null and NaN values are no readings but extend a source's range of days; rows
  without ``ts`` are ignored; a null site or sensor is a source of its own;
* a reading belongs to the nearest grid point, halfway to the later one; what is
  nearest to the midnight after the source's last day is outside the grid;
* of several readings at one grid point the nearest holds, of equally near ones the
  earlier, of equal times the smallest value; repeated rows change nothing;
* the step is that of ``STEPS`` nearest to the typical distance of a day's readings,
  for most readings of the source; sources that show less than ``FEW`` distances
  take ``data_sampling`` (minutes, else seconds) if it is one of the steps, else
  what the distances show, else the longest step;
* an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

from math import sqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sunloom.operators.clocks import latest_metadata
from sunloom.session import cut_lineage

STEPS = (5, 10, 15, 30, 60)
FEW = 8
SOURCE = ("site", "sensor")
DAY_MS = 86_400_000
MINUTE_MS = 60_000


def ms_of_day(ts: Column | str) -> Column:
    """Milliseconds since the midnight of a timestamp without zone."""
    t = F.col(ts) if isinstance(ts, str) else ts
    return F.timestamp_diff("MILLISECOND", F.to_date(t).cast("timestamp_ntz"), t.cast("timestamp_ntz"))


def _readings(df: DataFrame) -> DataFrame:
    value = F.col("meas_val_f").cast("double")
    return df.filter(F.col("ts").isNotNull()).select(
        F.col("site").cast("string").alias("site"),
        F.col("sensor").cast("string").alias("sensor"),
        F.to_date("ts").alias("day"),
        ms_of_day("ts").cast("int").alias("ms"),
        F.when(~F.isnan(value), value).alias("value"),
    )


def shards(df: DataFrame, with_values: bool = False) -> DataFrame:
    """One row for each day of each source: ``times``, sorted (ms of the day, with_values: structs of ms and value)."""
    item = F.struct("ms", "value") if with_values else F.col("ms")
    return _readings(df).groupBy(*SOURCE, "day").agg(F.array_sort(F.collect_set(F.when(F.col("value").isNotNull(), item))).alias("times"))


def _step_of(minutes: Column) -> Column:
    """The step nearest to a distance, by ratio."""
    step = F.lit(STEPS[-1])
    for low, high in reversed(list(zip(STEPS, STEPS[1:]))):
        step = F.when(minutes < sqrt(low * high), low).otherwise(step)
    return step


def shard_summaries(days: DataFrame, with_values: bool = False) -> DataFrame:
    """First and last reading, number of distances and the step they show, for each shard."""
    ms = F.transform("times", lambda x: x["ms"]) if with_values else F.col("times")
    n = F.size("ms")
    gaps = F.array_sort(F.zip_with(F.slice("ms", 2, F.greatest(n - 1, F.lit(0))), F.slice("ms", 1, F.greatest(n - 1, F.lit(0))), lambda b, a: b - a))
    return (
        days.withColumn("ms", ms)
        .withColumn("gaps", F.when(n > 1, gaps))
        .select(
            *SOURCE,
            "day",
            F.get("times", F.lit(0)).alias("first"),
            F.get("times", n - 1).alias("last"),
            F.coalesce(F.size("gaps"), F.lit(0)).alias("n_gaps"),
            _step_of(F.get("gaps", F.floor(F.size("gaps") / 2).cast("int")) / MINUTE_MS).alias("shown"),
        )
    )


def source_grids(summaries: DataFrame, meta: DataFrame) -> DataFrame:
    """(site, sensor, first_day, last_day, step in minutes) of each source."""
    votes = {f"n{s}": F.sum(F.when(F.col("shown") == s, F.col("n_gaps")).otherwise(0)) for s in STEPS}
    by_source = summaries.groupBy(*SOURCE).agg(
        F.min("day").alias("first_day"), F.max("day").alias("last_day"), *[v.alias(k) for k, v in votes.items()]
    )
    declared = latest_metadata(meta).select(F.col("system").alias("sensor"), F.col("site").alias("m_site"), "data_sampling")
    sampling = F.when(F.col("data_sampling").isin(*STEPS), F.col("data_sampling")).when((F.col("data_sampling") / 60).isin(*STEPS), F.col("data_sampling") / 60)
    most = F.greatest(*[F.col(k) for k in votes])
    shown = F.coalesce(*[F.when(F.col(f"n{s}") == most, s) for s in STEPS])
    n = sum((F.col(k) for k in votes), F.lit(0))
    step = F.when(n >= FEW, shown).otherwise(F.coalesce(sampling.cast("int"), F.when(n > 0, shown), F.lit(STEPS[-1])))
    return by_source.join(declared, "sensor", "left").select(*SOURCE, "first_day", "last_day", step.cast("int").alias("step"))


def carried_shards(summaries: DataFrame, grids: DataFrame) -> DataFrame:
    """All days of each source's grid with the readings last before and first after them.

    The prefix scan runs over one small row a day.
    """
    days = grids.select(*SOURCE, "step", F.explode(F.sequence("first_day", "last_day")).alias("day"))
    both = days.join(
        summaries.select(*[F.col(c).alias(f"s_{c}") for c in SOURCE], F.col("day").alias("s_day"), "first", "last"),
        F.col("site").eqNullSafe(F.col("s_site")) & F.col("sensor").eqNullSafe(F.col("s_sensor")) & (F.col("day") == F.col("s_day")),
        "left",
    )
    by = Window.partitionBy(*SOURCE).orderBy("day")
    at = lambda c: F.when(F.col(c).isNotNull(), F.struct("day", F.col(c).alias("x")))
    return both.select(
        *SOURCE,
        "step",
        "day",
        F.last(at("last"), ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, -1)).alias("before"),
        F.first(at("first"), ignorenulls=True).over(by.rowsBetween(1, Window.unboundedFollowing)).alias("after"),
    )


def _shards_with_state(df: DataFrame, meta: DataFrame, with_values: bool) -> DataFrame:
    # Summaries and filling both read the shards; the readings are read and grouped once.
    days = cut_lineage(shards(df, with_values))
    summaries = shard_summaries(days, with_values)
    carried = carried_shards(summaries, source_grids(summaries, meta))
    own = days.select(*[F.col(c).alias(f"d_{c}") for c in (*SOURCE, "day")], "times")
    same = F.col("site").eqNullSafe(F.col("d_site")) & F.col("sensor").eqNullSafe(F.col("d_sensor")) & (F.col("day") == F.col("d_day"))
    return carried.join(own, same, "left").drop("d_site", "d_sensor", "d_day")


def _slot(ms: Column) -> Column:
    return F.floor(ms / (F.col("step") * MINUTE_MS) + 0.5).cast("int")


def _slots_a_day() -> Column:
    return (F.lit(1440) / F.col("step")).cast("int")


def _slot_time(slot: Column) -> Column:
    return F.timestamp_add("MINUTE", slot * F.col("step"), F.col("day").cast("timestamp_ntz"))


def missing_slots(df: DataFrame, meta: DataFrame) -> DataFrame:
    """(site, sensor, slot timestamp_ntz) of each grid point without a reading."""
    state = _shards_with_state(df, meta, False)
    # The last reading of the day before may be nearest to this day's midnight.
    from_before = (F.col("before.day") == F.date_sub("day", 1)) & (_slot(F.col("before.x")) == _slots_a_day())
    taken = F.transform(F.coalesce("times", F.array().cast("array<int>")), _slot)
    taken = F.when(F.coalesce(from_before, F.lit(False)), F.array_append(taken, F.lit(0))).otherwise(taken)
    free = F.array_except(F.sequence(F.lit(0), _slots_a_day() - 1), taken)
    return state.select(*SOURCE, "step", "day", F.explode(free).alias("i")).select(*SOURCE, _slot_time(F.col("i")).alias("slot"))


def regular_series(df: DataFrame, meta: DataFrame, method: str = "linear") -> DataFrame:
    """The regular series of each source: (site, sensor, slot, value, state, filled).

    ``value`` is the reading of the grid point, ``state`` read or missing, ``filled`` the
    value with missing points filled: method "linear" between the neighbouring readings
    (beyond the first and last reading of a source: null), "previous" the last reading.
    """
    if method not in ("linear", "previous"):
        raise ValueError(f"unknown method {method!r}")
    state = _shards_with_state(df, meta, True)
    m = _slots_a_day()
    placed = lambda x, ms: F.struct(_slot(ms).alias("i"), F.abs(ms - _slot(ms) * F.col("step") * MINUTE_MS).alias("far"), ms.alias("ms"), x["value"].alias("value"))
    own = F.transform(F.coalesce("times", F.array().cast("array<struct<ms:int,value:double>>")), lambda x: placed(x, x["ms"]))
    before = F.when(F.col("before.day") == F.date_sub("day", 1), F.col("before.x"))
    # A reading of the day before that is nearest to this midnight.
    over = F.when(_slot(before["ms"]) == m, F.array(placed(before, before["ms"] - DAY_MS)))
    all_in = F.array_sort(F.concat(own, F.coalesce(over, F.array().cast("array<struct<i:int,far:int,ms:int,value:double>>"))))
    # A column of its own: sorted once a shard, and not again for each element that is compared with the one before.
    placed_rows = state.select(*SOURCE, "step", "day", "before", "after", all_in.alias("placed"))
    nearest = F.filter("placed", lambda x, k: (x["i"] < m) & ((k == 0) | (x["i"] != F.get("placed", k - 1)["i"])))
    by_slot = placed_rows.select(
        *SOURCE, "step", "day", "before", "after", F.map_from_entries(F.transform(nearest, lambda x: F.struct(x["i"], x["value"]))).alias("by_slot")
    )
    grid = F.transform(F.sequence(F.lit(0), m - 1), lambda i: F.struct(i.alias("i"), F.try_element_at("by_slot", i).alias("value")))
    cells = by_slot.select(*SOURCE, "step", "day", "before", "after", F.explode(grid).alias("cell")).select(*SOURCE, "step", "day", "before", "after", "cell.i", "cell.value")
    shard = Window.partitionBy(*SOURCE, "day").orderBy("i")
    seen = F.when(F.col("value").isNotNull(), F.struct("i", "value"))
    days_off = lambda c: F.date_diff(F.col(f"{c}.day"), F.col("day")) * m
    left_carry = F.when(F.col("before").isNotNull(), F.struct((days_off("before") + _slot(F.col("before.x.ms"))).alias("i"), F.col("before.x.value").alias("value")))
    right_carry = F.when(F.col("after").isNotNull(), F.struct((days_off("after") + _slot(F.col("after.x.ms"))).alias("i"), F.col("after.x.value").alias("value")))
    left = F.coalesce(F.last(seen, ignorenulls=True).over(shard.rowsBetween(Window.unboundedPreceding, 0)), left_carry)
    right = F.coalesce(F.first(seen, ignorenulls=True).over(shard.rowsBetween(0, Window.unboundedFollowing)), right_carry)
    filled = cells.withColumns({"l": left, "r": right})
    span = F.col("r.i") - F.col("l.i")
    line = F.when(span > 0, F.col("l.value") + (F.col("r.value") - F.col("l.value")) * (F.col("i") - F.col("l.i")) / span)
    return filled.select(
        *SOURCE,
        _slot_time(F.col("i")).alias("slot"),
        "value",
        F.when(F.col("value").isNotNull(), "read").otherwise("missing").alias("state"),
        F.coalesce("value", line if method == "linear" else F.col("l.value")).alias("filled"),
    )


def found(df: DataFrame, meta: DataFrame) -> DataFrame:
    """(site, sensor, slot text) of each grid point without a reading."""
    return missing_slots(df, meta).withColumn("slot", F.date_format("slot", "yyyy-MM-dd HH:mm:ss"))
