"""Exact order statistics and quantiles of groups of any size, without gathering a group.

Values are counted by narrow cells that keep their order, the cells that hold the
wanted ranks are found from the counts (a few thousand small rows a group), and only
the values of those cells are counted one by one.  A group with most of all rows spreads
over all tasks in both counts; no task holds more than a cell's distinct values.

Defined results: null and NaN values are left out; a group without values has no row;
null keys are a group; repeated values count each time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Cells for each power of e, and a number above that of any value's cell.
FINE, SHIFT = 256, 1 << 20


def cell_of(value: Column) -> Column:
    """A whole number that does not fall as the value rises; infinite values have cells of their own."""
    size = F.floor(F.ln(F.abs(value)) * FINE).cast("long") + SHIFT
    size = F.when(F.abs(value) == float("inf"), F.lit(2 * SHIFT)).otherwise(size)
    return F.when(value == 0, F.lit(0)).when(value > 0, size).otherwise(-size).cast("long")


def order_statistics(df: DataFrame, keys: list[str], value: str, ranks: Callable[[Column], dict[str, Column]]) -> DataFrame:
    """(keys, n, <name>...): the value at each rank (from 1) that ``ranks`` gives for a group's number of values ``n``."""
    v = F.col(value).cast("double")
    rows = df.select(F.struct(*keys).alias("k"), v.alias("v"), cell_of(v).alias("cell")).filter(F.col("v").isNotNull() & ~F.isnan("v"))
    counts = rows.groupBy("k", "cell").agg(F.count("*").alias("c"))
    by = Window.partitionBy("k")
    upto = counts.withColumns({"upto": F.sum("c").over(by.orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)), "n": F.sum("c").over(by)})
    wanted = F.array(*[F.struct(F.lit(name).alias("name"), rank.cast("long").alias("rank")) for name, rank in ranks(F.col("n")).items()])
    places = upto.select("k", "cell", "upto", "c", "n", F.explode(wanted).alias("w")).filter((F.col("w.rank") <= F.col("upto")) & (F.col("w.rank") > F.col("upto") - F.col("c")))
    places = places.select("k", "cell", "n", F.col("w.name").alias("name"), (F.col("w.rank") - F.col("upto") + F.col("c")).alias("rank"))
    values = rows.join(places.select("k", "cell").distinct(), ["k", "cell"], "left_semi").groupBy("k", "cell", "v").agg(F.count("*").alias("c"))
    to_here = F.sum("c").over(Window.partitionBy("k", "cell").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    found = values.withColumn("upto", to_here).join(places, ["k", "cell"]).filter((F.col("rank") <= F.col("upto")) & (F.col("rank") > F.col("upto") - F.col("c")))
    names = list(ranks(F.lit(1)))
    picked = found.groupBy("k").agg(F.max("n").alias("n"), *[F.max(F.when(F.col("name") == name, F.col("v"))).alias(name) for name in names])
    return picked.select(*[F.col("k")[c].alias(c) for c in keys], "n", *names)


def quantiles(df: DataFrame, keys: list[str], value: str, levels: dict[str, float], unbiased: bool = False) -> DataFrame:
    """(keys, n, <name>...): quantiles between neighbouring values, linear, or approximately median-unbiased (plotting positions (k - 1/3) / (n + 1/3))."""

    def place(n: Column, q: float) -> Column:
        h = (n + 1.0 / 3.0) * q + 1.0 / 3.0 if unbiased else (n - 1) * F.lit(q) + 1
        return F.least(F.greatest(h, F.lit(1.0)), n.cast("double"))

    def ranks(n: Column) -> dict[str, Column]:
        return {f"{name}_{end}": f(place(n, q)) for name, q in levels.items() for end, f in (("low", F.floor), ("high", F.ceil))}

    found = order_statistics(df, keys, value, ranks)
    part = lambda q: place(F.col("n"), q) - F.floor(place(F.col("n"), q))
    low, high = lambda name: F.col(f"{name}_low"), lambda name: F.col(f"{name}_high")
    # Equal neighbours may be infinite.
    between = [F.when(low(name) == high(name), low(name)).otherwise(low(name) + part(q) * (high(name) - low(name))).alias(name) for name, q in levels.items()]
    return found.select(*keys, "n", *between)
