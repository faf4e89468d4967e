"""Studies and further analyses: sensors, location and orientation, clear-sky times, shade, parameter series.

Study grids are short lists of options; every combination is an aggregate or a kernel
call of a system, so the cost grows with systems times options.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sunloom.functions import solar
from sunloom.kernels import decompositions as dc
from sunloom.kernels import detect
from sunloom.operators import daily, stats, tables, windows
from sunloom.session import spread

KEYS = ["system_id"]
EOT = {"duffie": solar.eot_duffie, "da_rosa": solar.eot_da_rosa}
DECLINATION = {"cooper": solar.declination_cooper, "spencer": solar.declination_spencer}


# --- sensors


def sensor_scores(df: DataFrame, keys: list[str], sensor: str, x: str, y: str, ts: str, folds: int = 20) -> DataFrame:
    """(keys, sensor, n, corr, rmse, mbe): how well each sensor predicts the power, by lines fitted on the past.

    Rows in time order are cut into folds + 1 parts; the line for each part is fitted from
    the sums of all parts before it, so no rows are read again.
    """
    rows = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    part = F.ntile(folds + 1).over(Window.partitionBy(*keys, sensor).orderBy(ts, x, y)) - 1
    parted = rows.select(*keys, sensor, x, y, part.alias("part"))
    sums = parted.groupBy(*keys, sensor, "part").agg(F.count("*").alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(F.col(x) * F.col(x)).alias("sxx"), F.sum(F.col(x) * F.col(y)).alias("sxy"))
    before = Window.partitionBy(*keys, sensor).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    past = sums.select(*keys, sensor, "part", *[F.sum(c).over(before).alias(c) for c in ("n", "sx", "sy", "sxx", "sxy")])
    slope = (F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")) / F.nullif(F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx"), F.lit(0.0))
    lines = past.filter("n > 1").select(*keys, sensor, "part", slope.alias("a"), ((F.col("sy") - slope * F.col("sx")) / F.col("n")).alias("b"))
    # At most folds + 1 small rows a sensor.
    guess = parted.join(lines, [*keys, sensor, "part"]).withColumn("guess", F.col("a") * F.col(x) + F.col("b"))
    return stats.regression(guess, [*keys, sensor], "guess", y).select(*keys, sensor, "n", "corr", "rmse", "mbe")


def identify_sensor(df: DataFrame, keys: list[str], sensor: str, x: str, y: str, ts: str, folds: int = 20) -> DataFrame:
    """The sensor that predicts each system's power best."""
    return stats.best_sensor(sensor_scores(df, keys, sensor, x, y, ts, folds), keys, sensor)


# --- location and orientation


def longitude_study(results: DataFrame, gmt_offset: float, true_longitude: float | None = None) -> DataFrame:
    """(system_id, eot, days, estimator, longitude, residual) over equations of time, choices of days and estimators."""
    doy = F.dayofyear("day").cast("double")
    noon = (F.col("sunrise") + F.col("sunset")) / 2 * 60
    parts = []
    for name, eot in EOT.items():
        each = solar.longitude_from_noon(noon, F.lit(gmt_offset), eot(doy))
        for days, use in (("all", F.lit(True)), ("no_errors", F.col("no_errors")), ("clear", F.col("is_clear"))):
            x = F.when(use, each)
            parts += [(name, days, "l1", F.percentile(x, F.lit(0.5))), (name, days, "l2", F.avg(x))]
    return _study(results, parts, "longitude", ["eot", "days", "estimator"], true_longitude)


def latitude_study(results: DataFrame, true_latitude: float | None = None) -> DataFrame:
    """(system_id, declination, days, latitude, residual) over declination formulas and choices of days."""
    doy = F.dayofyear("day").cast("double")
    hours = F.col("sunset") - F.col("sunrise")
    parts = []
    for name, declination in DECLINATION.items():
        d = declination(doy)
        # Near the equinoxes daylight says nothing about latitude.
        each = F.when(F.abs(d) > 1.0, solar.latitude_from_daylight(hours, d))
        for days, use in (("all", F.lit(True)), ("no_errors", F.col("no_errors")), ("clear", F.col("is_clear"))):
            parts.append((name, days, F.percentile(F.when(use, each), F.lit(0.5))))
    return _study(results, parts, "latitude", ["declination", "days"], true_latitude)


def _study(results: DataFrame, parts: list[tuple], value: str, options: list[str], truth: float | None) -> DataFrame:
    """All combinations in one aggregation of the daily rows, then one row for each."""
    wide = results.filter("error IS NULL").groupBy(*KEYS).agg(*[p[-1].alias(f"v{i}") for i, p in enumerate(parts)])
    rows = F.array(*[F.struct(*[F.lit(o).alias(n) for n, o in zip(options, p[:-1])], F.col(f"v{i}").alias(value)) for i, p in enumerate(parts)])
    out = wide.select(*KEYS, F.explode(rows).alias("r")).select(*KEYS, "r.*")
    return out.withColumn("residual", F.lit(truth).cast("double") - F.col(value))


def sun_sums(obs: DataFrame, results: DataFrame, m: int, longitude: float | str, gmt_offset: float | str, share: float = 0.15) -> DataFrame:
    """(system_id, n, a00..a22, b0..b2): all that a least-squares fit of an orientation needs of the clear days' bright slots, in one aggregation.

    The cosine of incidence is linear in sin(d), cos(d) cos(w) and cos(d) sin(w) of
    declination and hour angle; a are the sums of their products, b those with the power.
    """
    here = lambda x: F.col(x) if isinstance(x, str) else F.lit(x)
    doy = F.dayofyear("day").cast("double")
    d = F.radians(solar.declination_spencer(doy))
    w = F.radians(solar.hour_angle(F.col("slot") * 24.0 / m, here(longitude), here(gmt_offset), solar.eot_duffie(doy)))
    extra = [c for c in (longitude, gmt_offset) if isinstance(c, str)]
    clear = results.filter("is_clear AND NOT coalesce(clipped, false)").select(*KEYS, "day", "top", *extra)
    lit = obs.join(clear, [*KEYS, "day"]).filter(F.col("value") > share * F.col("top"))
    q = lit.select(*KEYS, F.sin(d).alias("q0"), (F.cos(d) * F.cos(w)).alias("q1"), (F.cos(d) * F.sin(w)).alias("q2"), "value")
    products = [F.sum(F.col(f"q{i}") * F.col(f"q{j}")).alias(f"a{i}{j}") for i in range(3) for j in range(i, 3)]
    return q.groupBy(*KEYS).agg(F.count("*").alias("n"), *products, *[F.sum(F.col(f"q{i}") * F.col("value")).alias(f"b{i}") for i in range(3)])


def orientation(obs: DataFrame, results: DataFrame, m: int, latitude: float | str, longitude: float | str, gmt_offset: float | str, share: float = 0.15) -> DataFrame:
    """(system_id, tilt, azimuth, n): the plane whose incidence, times an amplitude, fits the clear days' bright slots best; all of them count.

    At a known latitude the fit is linear: three unknowns, solved from the sums.  Places may be
    numbers or columns (latitude of ``obs`` or ``results``, the others of ``results``).
    """
    extra = [latitude] if isinstance(latitude, str) else []
    known = results.select(*KEYS, *extra).distinct() if extra else None
    sums = sun_sums(obs, results, m, longitude, gmt_offset, share)
    sums = sums.join(known, KEYS) if extra else sums
    a = {(i, j): F.col(f"a{min(i, j)}{max(i, j)}") for i in range(3) for j in range(3)}
    b = [F.col(f"b{i}") for i in range(3)]

    def det(c: list[list[Column]]) -> Column:
        return c[0][0] * (c[1][1] * c[2][2] - c[1][2] * c[2][1]) - c[0][1] * (c[1][0] * c[2][2] - c[1][2] * c[2][0]) + c[0][2] * (c[1][0] * c[2][1] - c[1][1] * c[2][0])

    whole = F.nullif(det([[a[i, j] for j in range(3)] for i in range(3)]), F.lit(0.0))
    solved = sums.withColumns({f"c{k}": det([[b[i] if j == k else a[i, j] for j in range(3)] for i in range(3)]) / whole for k in range(3)})
    la = F.radians(F.col(latitude) if extra else F.lit(latitude))
    # Back from the sun's coordinates to up, south and west of the place.
    up, south, west = F.sin(la) * F.col("c0") + F.cos(la) * F.col("c1"), F.sin(la) * F.col("c1") - F.cos(la) * F.col("c0"), F.col("c2")
    return solved.select(*KEYS, F.degrees(F.atan2(F.hypot(south, west), up)).alias("tilt"), F.degrees(F.atan2(west, south)).alias("azimuth"), "n")


#: Bounds in degrees of what an orientation fit may look for.
ANGLE_BOUNDS = {"latitude": (-90.0, 90.0), "tilt": (0.0, 90.0), "azimuth": (-180.0, 180.0)}


def orientation_with(sums: DataFrame, latitude: str | None = None, tilt: str | None = None, azimuth: str | None = None, name: str = "fit") -> DataFrame:
    """(system_id, latitude, tilt, azimuth, n): the angles that are not known, for any set of known ones (columns of ``sums``).

    Incidence has two degrees of freedom: of three unknown angles one choice among equally good ones is returned.
    """
    known = {k: v for k, v in (("latitude", latitude), ("tilt", tilt), ("azimuth", azimuth)) if v is not None}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.to_dict("records"):
                a = np.array([[r[f"a{min(i, j)}{max(i, j)}"] for j in range(3)] for i in range(3)])
                fixed = {k: float(r[v]) for k, v in known.items()}
                rows.append({"system_id": r["system_id"], **detect.best_angles(a, np.array([r["b0"], r["b1"], r["b2"]]), fixed, ANGLE_BOUNDS), "n": r["n"]})
            yield pd.DataFrame(rows, columns=["system_id", "latitude", "tilt", "azimuth", "n"])

    return sums.mapInPandas(run, "system_id string, latitude double, tilt double, azimuth double, n long")


def day_range(df: DataFrame, low: int, high: int, day: str = "day") -> DataFrame:
    """Rows whose day of the year is between two, both left out; a range over the year's end selects nothing."""
    return df.filter((F.dayofyear(day) > low) & (F.dayofyear(day) < high))


def tilt_azimuth_study(obs: DataFrame, results: DataFrame, m: int, latitude: float, longitude: float, gmt_offset: float, ranges: list[tuple[int, int]], shares: list[float], true_tilt: float | None = None, true_azimuth: float | None = None) -> DataFrame:
    """(system_id, first_day, last_day, share, tilt, azimuth, n, tilt_residual, azimuth_residual) over ranges of days and least parts of the daily maximum."""
    parts = []
    for low, high in ranges:
        for share in shares:
            fit = orientation(obs, day_range(results, low, high), m, latitude, longitude, gmt_offset, share)
            parts.append(fit.select(*KEYS, F.lit(low).alias("first_day"), F.lit(high).alias("last_day"), F.lit(share).alias("share"), "tilt", "azimuth", "n"))
    out = tables.concat(parts)
    return out.withColumns({"tilt_residual": F.lit(true_tilt).cast("double") - F.col("tilt"), "azimuth_residual": F.lit(true_azimuth).cast("double") - F.col("azimuth")})


def best_first(study: DataFrame, residual: str = "residual") -> DataFrame:
    """A study's rows by the size of their residual, those without one last."""
    return study.orderBy(F.abs(residual).asc_nulls_last())


def hours_of_daylight(obs: DataFrame, m: int, share: float = 0.001) -> DataFrame:
    """(system_id, day, hours): slots above a part of the system's largest value, times their length."""
    top = obs.groupBy(*KEYS).agg((F.max("value") * share).alias("least"))
    return obs.join(top, KEYS).groupBy(*KEYS, "day").agg((F.count_if(F.col("value") > F.col("least")) * 24.0 / m).alias("hours"))


def polar(obs: DataFrame, m: int, latitude: float, longitude: float, gmt_offset: float, cell: float = 5.0, how: str = "avg") -> DataFrame:
    """(bx azimuth, by elevation, value, n): power over the day's 95 % quantile by the sun's place, above the horizon."""
    doy = F.dayofyear("day").cast("double")
    omega = solar.hour_angle(F.col("slot") * 24.0 / m, F.lit(longitude), F.lit(gmt_offset), solar.eot_duffie(doy))
    elevation, azimuth = solar.solar_position(solar.declination_spencer(doy), F.lit(latitude), omega)
    top = obs.groupBy(*KEYS, "day").agg(F.percentile("value", F.lit(0.95)).alias("top"))
    scaled = obs.join(top, [*KEYS, "day"]).select(elevation.alias("elevation"), azimuth.alias("azimuth"), (F.col("value") / F.nullif("top", F.lit(0.0))).alias("x"))
    return stats.binned(scaled.filter("elevation >= 0 AND x IS NOT NULL"), "azimuth", "elevation", "x", cell, cell, how)


# --- clear sky


def clear_times(obs: DataFrame, model: DataFrame, low: float = 0.75, high: float = 1.2, cost: float = 0.1, change: float = 4.0) -> DataFrame:
    """(system_id, day, slot, inside): times at which power follows the clear-sky model (system_id, day, slot, clear).

    One dynamic program over all times of a system, its days labelled for themselves once the
    state that each starts with is known.
    """
    v, c = F.col("value"), F.col("clear")
    unknown = v.isNull() | c.isNull()
    near = v.between(low * c, high * c)
    rows = obs.join(model.select(*KEYS, "day", "slot", "clear"), [*KEYS, "day", "slot"], "left").select(
        *KEYS, "day", F.struct("day", F.col("slot").cast("long").alias("slot")).alias("at"),
        F.when(unknown, 1.0).when(near, 1.0).otherwise(cost).alias("out"), F.when(unknown, 1.0).when(near, cost).otherwise(1.0).alias("in"),
    )
    labelled = windows.two_state_labels(rows, KEYS, "at", "out", "in", change, shard="day")
    return labelled.select(*KEYS, "at.day", "at.slot", "inside")


def performance_index(obs: DataFrame, model: DataFrame) -> DataFrame:
    """(system_id, day, index): measured over clear-sky energy of each day."""
    both = obs.join(model.select(*KEYS, "day", "slot", "clear"), [*KEYS, "day", "slot"])
    return both.groupBy(*KEYS, "day").agg((F.sum("value") / F.nullif(F.sum(F.when(F.col("value").isNotNull(), F.col("clear"))), F.lit(0.0))).alias("index"))


# --- shade


def declination_profiles(resampled: DataFrame, clear: DataFrame) -> DataFrame:
    """(system_id, delta, k, value): mean of the clear days' resampled daylight by declination to the nearest degree."""
    delta = F.bround(solar.declination_cooper(F.dayofyear("day").cast("double"))).cast("int")
    return resampled.join(clear.filter("is_clear").select(*KEYS, "day"), [*KEYS, "day"]).groupBy(*KEYS, delta.alias("delta"), "k").agg(F.avg("value").alias("value"))


def shade(profiles: DataFrame) -> DataFrame:
    """(system_id, delta, k, clear, loss): what shade takes at each declination and time of day, by the joint decomposition of the profiles."""

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        grid = pdf.pivot_table(index="delta", columns="k", values="value").reindex(range(int(pdf.delta.min()), int(pdf.delta.max()) + 1))
        clear, loss = detect.shade_components(grid.to_numpy(float))
        at = np.indices(grid.shape)
        return pd.DataFrame({"system_id": pdf.system_id.iloc[0], "delta": grid.index.to_numpy()[at[0].ravel()], "k": grid.columns.to_numpy()[at[1].ravel()], "clear": clear.ravel(), "loss": loss.ravel()})

    return spread(profiles, *KEYS).groupBy(*KEYS).applyInPandas(kernel, "system_id string, delta int, k int, clear double, loss double")


def shade_of_days(days: DataFrame, components: DataFrame, share: float = 0.02) -> DataFrame:
    """(system_id, day, k, part): the part of the clear power that shade takes on each day, looked up by the day's declination.

    0 where the clear power is under a part of the system's 98 % quantile.
    """
    delta = F.bround(solar.declination_cooper(F.dayofyear("day").cast("double"))).cast("int")
    least = components.groupBy(*KEYS).agg((share * F.percentile("clear", F.lit(0.98))).alias("least"))
    found = components.join(least, KEYS).withColumn("part", F.when(F.col("clear") >= F.col("least"), F.col("loss") / F.nullif("clear", F.lit(0.0))).otherwise(0.0))
    return days.select(*KEYS, "day", delta.alias("delta")).join(found.select(*KEYS, "delta", "k", "part"), [*KEYS, "delta"]).select(*KEYS, "day", "k", "part")


def with_empirical(year: DataFrame, empirical: DataFrame, keys: list[str]) -> DataFrame:
    """A year's analysis by day of the year with what was measured then, null where nothing was."""
    return year.join(empirical, [*keys, "doy"], "left")


def class_prior(corpus: DataFrame, condition: Column | str, values: str = "values", rank: int = 6) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, leading eigenvalues, their vectors as columns) of the covariance of the corpus' rows that meet a condition, arrays of one length.

    Sums of products are aggregated; only a matrix as wide as a row reaches the driver.
    """
    rows = corpus.filter(condition).select(F.monotonically_increasing_id().alias("id"), F.posexplode(values).alias("i", "x"))
    one = rows.groupBy("i").agg(F.sum("x").alias("s"), F.count("*").alias("n")).orderBy("i").collect()
    size, n = len(one), one[0]["n"] if one else 0
    arrays = corpus.filter(condition).select(F.posexplode(values).alias("i", "x"), F.col(values).alias("v"))
    two = arrays.select("i", "x", F.posexplode("v").alias("j", "y")).groupBy("i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("s"))
    mean = np.array([r["s"] for r in one]) / max(n, 1)
    cov = np.zeros((size, size))
    for r in two.collect():
        cov[r["i"], r["j"]] = r["s"]
    cov = (cov - n * np.outer(mean, mean)) / max(n - 1, 1)
    values_, vectors = np.linalg.eigh(cov)
    lead = np.argsort(values_)[::-1][:rank]
    return mean, values_[lead], vectors[:, lead]


# --- parameter series


def parameter_components(fits: DataFrame, field: str, keys: list[str], period: int = 52, trend: str = "linear") -> DataFrame:
    """(keys, ts, value, outliers, level, season, trend, residual) of a parameter's series over its largest absolute value.

    Repeated weeks count once (the smallest value); systems with under a dozen values have no rows.
    """
    value = F.when(~F.isnan(field), F.col(field))
    weekly = fits.filter(F.col("ts").isNotNull()).groupBy(*keys, "ts").agg(F.min(value).alias("value"))
    scaled = weekly.withColumn("value", F.col("value") / F.nullif(F.max(F.abs("value")).over(Window.partitionBy(*keys)), F.lit(0.0)))
    rising = "series" in field
    names = ["value", "outliers", "level", "season", "trend", "residual"]

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts").reset_index(drop=True)
        v = pdf.value.astype(float).to_numpy()
        if np.isfinite(v).sum() < 12:
            return pdf.iloc[:0].reindex(columns=[*keys, "ts", *names])
        return pd.concat([pdf, pd.DataFrame(dc.pvpro_components(v, period, trend=trend, rising=rising))], axis=1)[[*keys, "ts", *names]]

    schema = ", ".join([*(f"{k} string" for k in keys), "ts timestamp_ntz", *(f"{n} double" for n in names)])
    return spread(scaled, *keys).groupBy(*keys).applyInPandas(kernel, schema)


def yearly_change(components: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, percent): change of the trend a year in percent of the level."""
    weeks = (F.date_diff(F.max("ts"), F.min("ts")) / 365.25).cast("double")
    change = F.max_by("trend", "ts") - F.min_by("trend", "ts")
    return components.groupBy(*keys).agg((100 * change / F.nullif(weeks * F.avg("level"), F.lit(0.0))).alias("percent"))


def holdout_errors(fits: DataFrame, field: str, keys: list[str], smooths: list[float], seed: int = 0) -> DataFrame:
    """(keys, smooth, error): mean squared error on a held-out fifth for each stiffness."""
    value = F.when(~F.isnan(field), F.col(field))
    weekly = fits.filter(F.col("ts").isNotNull()).groupBy(*keys, "ts").agg(F.min(value).alias("value"))
    grid = tables.option_grid(fits.sparkSession, {"smooth": smooths})
    # A handful of options.
    rows = weekly.join(F.broadcast(grid), F.lit(True))

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts")
        v = pdf.value.astype(float).to_numpy()
        v = v / (np.nanmax(np.abs(v)) if np.isfinite(v).any() else 1.0)
        out = {k: [pdf[k].iloc[0]] for k in keys} | {"smooth": [float(pdf.smooth.iloc[0])], "error": [None]}
        ok = np.flatnonzero(np.isfinite(v))
        if len(ok) >= 20:
            held = np.random.default_rng(seed).permutation(ok)[: len(ok) // 5]
            train = v.copy()
            train[held] = np.nan
            f = dc.pvpro_components(train, smooth=float(pdf.smooth.iloc[0]))
            out["error"] = [float(np.mean((v - f["level"] - f["season"] - f["trend"])[held] ** 2))]
        return pd.DataFrame(out)

    return spread(rows, *keys, "smooth").groupBy(*keys, "smooth").applyInPandas(kernel, ", ".join([*(f"{k} string" for k in keys), "smooth double", "error double"]))


def daily_amplitude(results: DataFrame) -> DataFrame:
    """(system_id, day, amplitude): a smooth upper envelope of the clear days' maxima."""

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("day")
        top = pdf.top.astype(float).to_numpy()
        return pd.DataFrame({"system_id": pdf.system_id, "day": pdf.day, "amplitude": np.exp(dc.smooth_quantile(np.log(np.where((top > 0) & pdf.is_clear.to_numpy(bool), top, np.nan)), 0.9))})

    return spread(results.filter("error IS NULL").select(*KEYS, "day", "top", "is_clear"), *KEYS).groupBy(*KEYS).applyInPandas(kernel, "system_id string, day date, amplitude double")


def sun_up(obs: DataFrame, results: DataFrame, m: int) -> DataFrame:
    """obs with ``up``: between the day's smooth sunrise and sunset."""
    hour: Column = F.col("slot") * 24.0 / m
    return obs.join(results.select(*KEYS, "day", "sunrise", "sunset"), [*KEYS, "day"], "left").withColumn("up", F.coalesce((hour >= F.col("sunrise")) & (hour < F.col("sunset")), F.lit(False))).drop("sunrise", "sunset")


def daily_median_by_day_of_year(values: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, doy, median, mean): by day of the year, the leap day left out and the days after it moved up."""
    leap = (F.month("day") == 2) & (F.dayofmonth("day") == 29)
    is_leap = F.dayofyear(F.last_day(F.make_date(F.year("day"), F.lit(12), F.lit(1)))) == 366
    doy = F.dayofyear("day") - F.when(is_leap & (F.dayofyear("day") > 60), 1).otherwise(0)
    return values.filter(~leap).groupBy(*keys, doy.alias("doy")).agg(F.percentile("value", F.lit(0.5)).alias("median"), F.avg("value").alias("mean"))


def quality_of(obs: DataFrame, m: int) -> DataFrame:
    """Daily densities and linearity in one table, for use without the fits."""
    return daily.daily_scores(obs, m).join(daily.linearity(obs, m).select(*KEYS, "day", "linearity"), [*KEYS, "day"], "left")
