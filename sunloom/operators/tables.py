"""Table operators: wide and long forms, flags by time and day, site lists, resuming."""

from __future__ import annotations

from collections.abc import Callable
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sunloom.operators.timeaxis import first_of_each_time
from sunloom.session import spread


#: Characters of an error's text that are kept.
ERROR_CHARS = 100_000


def long_to_wide(df: DataFrame, index: list[str], name: str, value: str, names: list[str], order: list[str]) -> DataFrame:
    """One column for each of the given names; of several values the first in order.  The names are given, so no pass looks for them."""
    first = first_of_each_time(df.select(*index[:-1], index[-1], name, value, *[c for c in order if c not in (*index, name, value)]), [*index[:-1], name], order, index[-1])
    return first.groupBy(*index).pivot(name, names).agg(F.first(value))


def wide_to_long(df: DataFrame, index: list[str], columns: list[str], name: str = "name", value: str = "value") -> DataFrame:
    return df.unpivot(index, columns, name, value)


def with_time_flag(df: DataFrame, flags: DataFrame, keys: list[str], flag: str) -> DataFrame:
    """Join a flag by time; rows without one are false."""
    return df.join(flags, keys, "left").withColumn(flag, F.coalesce(F.col(flag), F.lit(False)))


def with_day_flag(df: DataFrame, days: DataFrame, keys: list[str], flag: str, ts: str = "ts") -> DataFrame:
    """Flag rows whose date is among the given days."""
    marked = days.select(*keys, F.col("day").alias("_day")).distinct().withColumn(flag, F.lit(True))
    return df.withColumn("_day", F.to_date(ts)).join(marked, [*keys, "_day"], "left").withColumn(flag, F.coalesce(F.col(flag), F.lit(False))).drop("_day")


def resample(df: DataFrame, keys: list[str], ts: str, every: str, aggregates: dict[str, Column]) -> DataFrame:
    """Aggregates over windows of fixed length: (keys, start, ...).  An aggregate is any column: built in, or a pandas aggregate of the user's (all of them then)."""
    w = F.window(F.col(ts), every)
    return df.groupBy(*keys, w["start"].alias("start")).agg(*[a.alias(n) for n, a in aggregates.items()])


def not_done(keys: DataFrame, results: DataFrame, on: list[str]) -> DataFrame:
    """Keys that an earlier run has no result for."""
    return keys.join(results.select(*on).distinct(), on, "left_anti")


def concat(frames: list[DataFrame]) -> DataFrame:
    """All rows of tables whose columns may differ."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def columns_like(df: DataFrame, include: list[str], exclude: list[str] | None = None) -> list[str]:
    """Names of the columns that hold one of the texts and none of the others."""
    return [c for c in df.columns if any(i in c for i in include) and not any(e in c for e in exclude or [])]


def null_at_bounds(df: DataFrame, bounds: dict[str, tuple[float | None, float | None]]) -> DataFrame:
    """All bounded columns as null in rows in which one of them is at or beyond a bound."""
    hit = F.lit(False)
    for c, (low, high) in bounds.items():
        if low is not None:
            hit |= F.coalesce(F.col(c) <= low, F.lit(False))
        if high is not None:
            hit |= F.coalesce(F.col(c) >= high, F.lit(False))
    return df.withColumns({c: F.when(~hit, F.col(c)) for c in bounds})


def partition_plan(files: DataFrame, parts: int, size: str = "size", outlier: float = 10.0) -> DataFrame:
    """files with ``part`` and ``is_outlier``: parts of about the same total size; outliers are larger than so many times the mean.

    Sizes are summed by hash bucket first, so files are never ordered in one task; a file stays in the part in which it begins.
    """
    rows = files.withColumns({"_b": F.pmod(F.xxhash64(*files.columns), F.lit(1024)), "_s": F.coalesce(F.col(size), F.lit(0)).cast("double")})
    # 1,024 rows at most.
    sums = rows.groupBy("_b").agg(F.sum("_s").alias("_sum"), F.count("*").alias("_n"))
    over = Window.partitionBy(F.lit(0)).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(F.lit(0))
    starts = sums.select("_b", F.coalesce(F.sum("_sum").over(over), F.lit(0.0)).alias("_start"), F.sum("_sum").over(whole).alias("_all"), F.sum("_n").over(whole).alias("_files"))
    within = Window.partitionBy("_b").orderBy(*files.columns).rowsBetween(Window.unboundedPreceding, -1)
    met = rows.join(F.broadcast(starts), "_b").withColumn("_at", F.col("_start") + F.coalesce(F.sum("_s").over(within), F.lit(0.0)))
    part = F.least(F.floor(F.col("_at") * parts / F.nullif("_all", F.lit(0.0))), F.lit(parts - 1)).cast("int")
    return met.select(*files.columns, F.coalesce(part, F.lit(0)).alias("part"), (F.col("_s") > outlier * F.col("_all") / F.col("_files")).alias("is_outlier"))


def zip_code(text: Column) -> Column:
    """The five digits of a zip code, null for any other text."""
    return F.when(F.btrim(text).rlike("^[0-9]{5}$"), F.btrim(text))


def all_levels(first: Column, second: Column) -> Column:
    """Two lists of levels as one, sorted, each level once."""
    return F.array_sort(F.array_union(first, second))


def option_grid(spark: SparkSession, options: dict[str, list]) -> DataFrame:
    """All combinations of a study's few options, as a table."""
    return spark.createDataFrame(list(product(*options.values())), list(options))


def shift_days(df: DataFrame, rolls: DataFrame, m: int, keys: list[str], inverse: bool = False) -> DataFrame:
    """Roll the slots of each day by ``roll`` slots around the day's border."""
    roll = F.coalesce("roll", F.lit(0)) * (-1 if inverse else 1)
    return df.join(rolls, [*keys, "day"], "left").withColumn("slot", F.pmod(F.col("slot") + roll, F.lit(m)).cast("int")).drop("roll")


def apply_by_system(df: DataFrame, keys: list[str], kernel: Callable, schema: str) -> DataFrame:
    """A kernel over each system's few thousand daily rows; an error becomes a row of nulls with its text.

    ``kernel(frame) -> frame``; the schema must have ``error string`` as its last column.
    """
    names = [f.split()[0] for f in schema.split(",")] if schema else []

    def run(pdf):
        import pandas as pd

        try:
            return kernel(pdf).assign(error=None)[[n.strip() for n in names]]
        except Exception as e:  # noqa: BLE001 - one system's failure must not end the others
            row = {n.strip(): [None] for n in names}
            row |= {k: [pdf[k].iloc[0]] for k in keys}
            row["error"] = [f"{type(e).__name__}: {e}"[:ERROR_CHARS]]
            return pd.DataFrame(row)

    return spread(df, *keys).groupBy(*keys).applyInPandas(run, schema)
