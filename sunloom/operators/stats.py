"""Statistics that SQL engines lack: Shapley shares, circular tests, median-unbiased quantiles, fits by sums."""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations
from math import factorial, pi

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sunloom.operators import ranks


def subset_sums(df: DataFrame, keys: list[str], factors: list[str], base: str) -> DataFrame:
    """(keys, s_0, s_1, ...): for each set of factors (bit i: factor i) the sum of ``base`` times the set's factors, in one aggregation."""
    sums = []
    for bits in range(1 << len(factors)):
        product = F.col(base)
        for i, f in enumerate(factors):
            if bits >> i & 1:
                product = product * F.col(f)
        sums.append(F.sum(product).alias(f"s_{bits}"))
    return df.groupBy(*keys).agg(*sums)


def shapley(df: DataFrame, keys: list[str], factors: list[str], base: str) -> DataFrame:
    """(keys, total, <factor>...): each factor's share of sum(product of all) - sum(base), the mean over all orders in closed form."""
    n = len(factors)
    sums = subset_sums(df, keys, factors, base)
    out = []
    for i, f in enumerate(factors):
        share = F.lit(0.0)
        others = [j for j in range(n) if j != i]
        for size in range(n):
            weight = factorial(size) * factorial(n - size - 1) / factorial(n)
            for chosen in combinations(others, size):
                bits = sum(1 << j for j in chosen)
                share = share + F.lit(weight) * (F.col(f"s_{bits | 1 << i}") - F.col(f"s_{bits}"))
        out.append(share.alias(f))
    return sums.select(*keys, (F.col(f"s_{(1 << n) - 1}") - F.col("s_0")).alias("total"), *out)


def rayleigh(df: DataFrame, keys: list[str], angle: str, weight: str | None = None) -> DataFrame:
    """(keys, n, r, p): mean resultant length of angles in radians and the p-value of the test for uniformity."""
    w = F.col(weight) if weight else F.lit(1.0)
    a = F.col(angle)
    sums = df.filter(a.isNotNull()).groupBy(*keys).agg(F.sum(w).alias("n"), F.sum(w * F.cos(a)).alias("c"), F.sum(w * F.sin(a)).alias("s"))
    r = F.hypot("c", "s") / F.col("n")
    z = F.col("n") * F.col("r") * F.col("r")
    n = F.col("n")
    # Series of the p-value in 1/n.
    tail = 1 + (2 * z - z * z) / (4 * n) - (24 * z - 132 * z**2 + 76 * z**3 - 9 * z**4) / (288 * n * n)
    return sums.select(*keys, "n", r.alias("r")).withColumn("p", F.exp(-z) * F.when(n < 50, tail).otherwise(1.0))


def circular_histogram(df: DataFrame, keys: list[str], day_of_year: str, bins: int = 48) -> DataFrame:
    """(keys, bin, n): counts of days of the year by angle."""
    angle = 2 * pi * (F.col(day_of_year) - 1) / 365.0
    return df.groupBy(*keys, F.least(F.floor(angle / (2 * pi / bins)), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def unbiased_quantile(df: DataFrame, keys: list[str], value: str, levels: dict[str, float]) -> DataFrame:
    """(keys, n, <name>...): approximately median-unbiased quantiles of groups of any size."""
    return ranks.quantiles(df, keys, value, levels, unbiased=True)


def regression(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """(keys, n, slope, intercept, corr, rmse, mbe) of the line of y over x, from sums."""
    rows = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    s = rows.groupBy(*keys).agg(
        F.count("*").alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.corr(x, y).alias("corr"),
        F.avg((F.col(x) - F.col(y)) ** 2).alias("ms"), F.avg(F.col(x) - F.col(y)).alias("mbe"),
    )
    return s.select(*keys, "n", "slope", "intercept", "corr", F.sqrt("ms").alias("rmse"), "mbe")


def best_sensor(scores: DataFrame, keys: list[str], sensor: str = "sensor") -> DataFrame:
    """The sensor of highest correlation in each group, of equal ones the first by name; null correlations come last."""
    best = F.min_by(F.struct(sensor, "corr", "rmse"), F.struct(F.col("corr").isNull().alias("none"), (-F.col("corr")).alias("c"), F.col(sensor).alias("name")))
    return scores.groupBy(*keys).agg(best.alias("b")).select(*keys, "b.*")


def binned(df: DataFrame, x: str, y: str, value: str, dx: float, dy: float, how: str | Column | Callable[[Column], Column] = "avg") -> DataFrame:
    """(bx, by, value, n): an aggregate by cells of two rounded coordinates, rows without either left out.

    ``how`` is the name of an aggregate, an aggregate column, or a function from the value's
    column to one: built of columns, or a pandas aggregate (``functions.pandas_udf``).
    """
    cell = lambda c, d: F.lit(d) * F.bround(F.col(c) / d)
    f = getattr(F, how)(value) if isinstance(how, str) else how if isinstance(how, Column) else how(F.col(value))
    by = df.dropna(subset=[x, y]).groupBy(cell(x, dx).alias("bx"), cell(y, dy).alias("by"))
    count = by.agg(F.count("*").alias("n"))
    if isinstance(how, str) or isinstance(how, Column):
        return by.agg(f.alias("value"), F.count("*").alias("n"))
    # Pandas aggregates don't mix with others, so the counts are joined by cell.
    return by.agg(f.alias("value")).join(count, ["bx", "by"]).select("bx", "by", "value", "n")
