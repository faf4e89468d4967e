"""The whole analysis of a fleet: gridding relational, the fits of a system in one kernel call.

Input is (system_id, ts, value).  Readings are cleaned, put on the regular grid of their
source and gathered by day, all in shards of a day.  A day is then one row of at most 288
values, so a system's rows grow with its years only, however dense its readings were, and
one call holds the matrix of a system for all stages.  A stage that fails leaves nulls and
its text in ``run_pipeline_error``; the stages after it that can go on do.
"""

from __future__ import annotations

import time
import warnings
from collections.abc import Callable, Generator, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sunloom.functions import solar
from sunloom.kernels import days as dm
from sunloom.kernels import decompositions as dc
from sunloom.kernels import detect, many
from sunloom.operators import rebin, timeaxis
from sunloom.operators.stats import shapley
from sunloom.operators.tables import ERROR_CHARS
from sunloom.session import cut_lineage, spread

KEYS = ["system_id"]
NO_ERROR = "No error"
DAILY_SCHEMA = (
    "system_id string, day date, sunrise double, sunset double, density_score double, density_fit double, linearity_score double, energy double, top double, "
    "cluster int, no_errors boolean, clear_weight double, is_clear boolean, is_cloudy boolean, clipped boolean, capacity_label int, roll int, "
    "capacity double, threshold double, normal_scores boolean, inverter_clipping boolean, clip_points array<double>, shifted boolean, standard_shift int, "
    "time_zone_correction int, filled array<double>, undecided string, error string, seconds double"
)
_NAMES = [f.strip().split(" ")[0] for f in DAILY_SCHEMA.split(",")]
_TYPES = {"string": pa.string(), "date": pa.date32(), "double": pa.float64(), "boolean": pa.bool_(), "int": pa.int32(), "array<double>": pa.list_(pa.float64())}
_ARROW = [pa.field(name, _TYPES[kind]) for name, kind in (f.strip().split(" ") for f in DAILY_SCHEMA.split(","))]
#: Days of all systems whose fits are solved together, about; the days of one system always are.
DAYS_AT_ONCE = 8_000
#: Hours that the mean noon must be off for the residual correction of the zone.
ZONE_OFF = 1.0


def _spread(df: DataFrame) -> DataFrame:
    return spread(df, *KEYS)


def gridded_days(df: DataFrame, step_minutes: int, low: float | None = -5.0, high: float | None = None) -> DataFrame:
    """(system_id, day, slots, values, own): the cleaned readings of each day on the regular grid, and whether any is of that day itself."""
    clean = df.select(*KEYS, F.col("ts").cast("timestamp_ntz").alias("ts"), timeaxis.clip_range(F.col("value"), low, high).alias("value"))
    first = timeaxis.first_of_each_time(clean, KEYS, ["value"])
    placed = timeaxis.nearest_on_grid(first, KEYS, step_minutes * 60, with_own=True)
    slot = F.floor(timeaxis.seconds(F.col("slot")) % 86_400 / (step_minutes * 60)).cast("int")
    cell = F.struct(slot.alias("slot"), "value")
    cells = placed.filter("value IS NOT NULL").groupBy(*KEYS, F.to_date("slot").alias("day")).agg(F.array_sort(F.collect_list(cell)).alias("cells"), F.max("own").alias("own"))
    return cells.select(*KEYS, "day", F.col("cells.slot").alias("slots"), F.col("cells.value").alias("values"), "own")


def detectors(x: dict[str, np.ndarray], m: int, fix_shifts: bool = True, capacity: bool = True) -> tuple[dict[str, object], list[str], list[str]]:
    """(columns, undecided, errors): all flags and labels of one system's daily statistics; columns of a stage that fails are missing."""
    return many.alone(detectors_fits(x, m, fix_shifts, capacity))


def detectors_fits(x: dict[str, np.ndarray], m: int, fix_shifts: bool = True, capacity: bool = True, labels: bool = True):
    """``detectors`` as a generator that yields its fits; without ``labels`` only the stages that the shifts need."""
    out: dict[str, object] = {}
    undecided: list[str] = []
    errors: list[str] = []

    def stage(name, f):
        try:
            yield from f()
        except Exception as e:  # noqa: BLE001 - what a stage can't do must not end the others
            errors.append(f"{name}: {type(e).__name__}: {e}")

    def quality():
        q = yield from detect.quality_fits(x["density"], x["linearity"])
        out.update({k: q[k] for k in ("density_score", "density_fit", "linearity_score", "no_errors")}, cluster=q["cluster"].astype("int32"), normal_scores=q["normal"])

    def clear():
        weight = yield from detect.clear_days_fits(x["bends"], x["energy"], x["density"])
        good = (weight >= 1e-3) & (out["density_score"] > 0.9)
        out.update(clear_weight=weight, is_clear=good & out["no_errors"], is_cloudy=~good & out["no_errors"])

    def clipping():
        c = detect.clipping(x["stat1"], x["stat2"], out["no_errors"])
        yield from ()
        out.update(clipped=c["days"], inverter_clipping=c["inverter_clipping"], clip_points=[c["points"].tolist()] * len(x["top"]))

    def levels():
        found = (yield from detect.capacity_steps_fits(x["top"], out["no_errors"])) if capacity else None
        if found is None:
            undecided.append(f"capacity: {'too few usable days' if capacity else 'switched off'}")
        else:
            out["capacity_label"] = found.astype("int32")

    def shifts():
        clear_enough = out["is_clear"].mean() >= 0.3
        use = out["is_clear"] if clear_enough else out["no_errors"]
        shift = (yield from detect.clock_shifts_fits(x["noon"], use, m)) if fix_shifts else None
        if shift is None:
            few = (use & np.isfinite(x["noon"])).sum() < detect.LEAST_DAYS
            undecided.append(f"shift: {'switched off' if not fix_shifts else 'too few usable days' if few else 'the season hides a step in so short a series'}")
        else:
            out.update(roll=shift["roll"].astype("int32"), shifted=shift["shifted"])

    for f in (quality, clear, clipping, levels, shifts) if labels else (quality, clear, shifts):
        yield from stage(f.__name__, f)
    return out, undecided, errors


def analyse_system(day: np.ndarray, slots: list, values: list, m: int, fix_shifts: bool = True, capacity: bool = True) -> pd.DataFrame:
    """Daily results of one system (``DAILY_SCHEMA`` without the system)."""
    out = many.alone(analyse_fits(day, slots, values, m, fix_shifts, capacity))
    return pd.DataFrame({c: out.get(c) for c in _NAMES[1:]}, index=range(len(out["day"])))


def analyse_fits(day: np.ndarray, slots: list, values: list, m: int, fix_shifts: bool = True, capacity: bool = True, labels: bool = True):
    """``analyse_system``'s columns as a generator that yields its fits; without ``labels`` no clipping and no capacity labels, on which the readings, energies and daytime don't depend."""
    began = time.perf_counter()
    numbers, x = dm.matrix(day, slots, values, m)
    if len(numbers) == 0:
        raise ValueError("no values")
    standard = dm.average_day_shift(x)
    x = dm.moved(x, standard * m // 24)
    n = len(x)
    undecided: list[str] = []
    errors: list[str] = []
    try:
        sun = yield from dm.sun_fits(x)
    except Exception as e:  # noqa: BLE001
        # Filling needs the daytime and all else the filled days: what could be made without it would only look like results.
        nothing = np.full(n, np.nan)
        return {
            "day": pd.to_datetime(numbers, unit="D").date, "sunrise": nothing, "sunset": nothing, "energy": nothing, "standard_shift": standard, "filled": [None] * n,
            "error": f"daytime: {type(e).__name__}: {e}"[:ERROR_CHARS], "seconds": time.perf_counter() - began,
        }
    full = dm.filled(x, dm.daytime(n, m, sun["sunrise"], sun["sunset"]))
    stats = dm.statistics(x, full)
    found, undecided, more = yield from detectors_fits({**stats, "noon": sun["noon"]}, m, fix_shifts, capacity, labels)
    errors += more
    # Flags and labels are those of the clock as it was; the days are then rolled, and daytime is found anew.
    roll = found.get("roll", np.zeros(n, np.int32))
    x, zone = dm.rolled(x, roll), 0
    if roll.any():
        sun = yield from dm.sun_fits(x, sun["threshold"])
    noon = np.nanmean((sun["sunrise"] + sun["sunset"]) / 2) if np.isfinite(sun["sunrise"] + sun["sunset"]).any() else 12.0
    if fix_shifts and abs(12 - noon) > ZONE_OFF:
        zone = int(np.rint(12 - noon))
        x = dm.rolled(x, np.full(n, zone * m // 24))
        sun = yield from dm.sun_fits(x, sun["threshold"])
    if roll.any() or zone:
        full = dm.filled(x, dm.daytime(n, m, sun["sunrise"], sun["sunset"]))
    out = {
        "day": pd.to_datetime(numbers, unit="D").date, "sunrise": sun["sunrise"], "sunset": sun["sunset"], "threshold": sun["threshold"], "energy": full.sum(axis=1) * 24 / m, "top": stats["top"],
        "capacity": stats["capacity"], "standard_shift": standard, "time_zone_correction": zone, "filled": list(full), "undecided": "; ".join(undecided) or None,
        "error": "; ".join(errors)[:ERROR_CHARS] or None, **found, "seconds": time.perf_counter() - began,
    }
    return out


def _systems(rows: pd.DataFrame, fix_shifts: bool, capacity: bool, labels: bool = True) -> Iterator[tuple[str, int, Generator]]:
    """(system, step, ``analyse_fits``) of each system of ``rows``, which are sorted by system and day."""
    starts = np.flatnonzero(np.r_[True, rows.system_id.to_numpy()[1:] != rows.system_id.to_numpy()[:-1]])
    number, own = rows.day.to_numpy(), rows.own.to_numpy(bool)
    for start, end in zip(starts, np.r_[starts[1:], len(rows)]):
        # The grid ends with the days that have readings; a last reading near midnight makes no further day.
        on = start + np.flatnonzero(own[start:end])
        a, b = (on[0], on[-1] + 1) if len(on) else (start, start)
        one, step = rows.iloc[a:b], int(rows.step_minutes.iloc[start])
        yield rows.system_id.iloc[start], step, analyse_fits(number[a:b], list(one.slots), list(one["values"]), 1440 // step, fix_shifts, capacity, labels)


def _solved(jobs: list[Generator]) -> list[object]:
    with np.errstate(all="ignore"), warnings.catch_warnings():
        warnings.simplefilter("ignore", RuntimeWarning)
        return many.together(jobs)


def _together(rows: pd.DataFrame, fix_shifts: bool, capacity: bool) -> pa.RecordBatch:
    """The results of the systems of ``rows``, which are sorted by system and day."""
    systems = list(_systems(rows, fix_shifts, capacity))
    began = time.perf_counter()
    found = _solved([job for *_, job in systems])
    seconds = (time.perf_counter() - began) / len(systems)
    found = [{"error": f"{type(f).__name__}: {f}"[:ERROR_CHARS], "day": [None]} if isinstance(f, Exception) else {**f, "seconds": seconds} for f in found]
    columns: dict[str, list] = {c: [] for c in _NAMES}
    for (system, *_), f in zip(systems, found):
        n = len(f["day"])
        for c in _NAMES[1:]:
            v = f.get(c)
            columns[c] += v.tolist() if isinstance(v, np.ndarray) else v if isinstance(v, list) else [v] * n
        columns["system_id"] += [system] * n
    steps = [k for (_, k, _), f in zip(systems, found) for _ in range(len(f["day"]))]
    return pa.RecordBatch.from_arrays([*(pa.array(columns[f.name], f.type, from_pandas=True) for f in _ARROW), pa.array(steps, pa.int32())], schema=pa.schema([*_ARROW, pa.field("step_minutes", pa.int32())]))


def _in_groups(days: DataFrame, kernel: Callable[[pd.DataFrame], pa.RecordBatch], schema: str) -> DataFrame:
    """``kernel`` over the rows of whole systems, some hundred at a time, sorted by system and day; a day is its number."""

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pd.DataFrame] = []
        for batch in batches:
            t = batch.set_column(batch.schema.get_field_index("day"), "day", batch.column("day").cast(pa.int32()).cast(pa.int64()))
            held.append(t.to_pandas())
            if sum(map(len, held)) < DAYS_AT_ONCE:
                continue
            rows = pd.concat(held, ignore_index=True)
            # The last system may go on in the next batch.
            whole = int((rows.system_id.to_numpy() != rows.system_id.iloc[-1]).sum())
            if whole:
                yield kernel(rows.iloc[:whole])
            held = [rows.iloc[whole:]]
        if sum(map(len, held)):
            yield kernel(pd.concat(held, ignore_index=True))

    return days.transform(_spread).sortWithinPartitions(*KEYS, "day").mapInArrow(groups, schema)


def _gridded_columns(days: DataFrame) -> DataFrame:
    return days.select(*KEYS, "day", "slots", "values", "own", F.col("step_minutes").cast("int").alias("step_minutes"))


def analyse(days: DataFrame, fix_shifts: bool = True, capacity: bool = True) -> DataFrame:
    """Flags and labels of all days (``DAILY_SCHEMA`` and ``step_minutes``) from ``gridded_days`` with ``step_minutes``; an error is kept in its system's row.

    A task takes its systems some hundred at a time, so that their fits are solved together.
    """
    return _in_groups(_gridded_columns(days), lambda rows: _together(rows, fix_shifts, capacity), f"{DAILY_SCHEMA}, step_minutes int")


def run(df: DataFrame, step_minutes: int = 60, fix_shifts: bool = True, capacity: bool = True) -> DataFrame:
    """The daily results of all systems of (system_id, ts, value), all on one grid."""
    # Written first, so that the fits are spread by their number and not by the few bytes of their input.
    return analyse(cut_lineage(gridded_days(df, step_minutes).withColumn("step_minutes", F.lit(step_minutes))), fix_shifts, capacity).drop("step_minutes")


def run_by_step(df: DataFrame, steps: DataFrame, fix_shifts: bool = True, capacity: bool = True) -> DataFrame:
    """``run`` for each system at its own step, with ``step_minutes``; steps is (system_id, step_minutes)."""
    return analyse(days_by_step(df, steps), fix_shifts, capacity)


def days_by_step(df: DataFrame, steps: DataFrame) -> DataFrame:
    """``gridded_days`` of each system at its own step, with ``step_minutes``; steps is (system_id, step_minutes).

    Only the few distinct steps reach the driver; systems without a step are left out.
    """
    # Read once for each step.
    both = cut_lineage(df.join(steps, KEYS))
    found = sorted(r[0] for r in both.select("step_minutes").distinct().collect()) or [60]
    parts = [gridded_days(both.filter(F.col("step_minutes") == k).drop("step_minutes"), k).withColumn("step_minutes", F.lit(k)) for k in found]
    return cut_lineage(reduce(DataFrame.unionByName, parts))


def report(results: DataFrame, losses: DataFrame | None = None, systems: DataFrame | None = None) -> DataFrame:
    """One row a system: length in years, capacity, scores and detections, and the errors of each stage of the run.

    With ``losses`` (of ``loss_summary``) its energies and rates too; with ``systems``, a
    table of all that were asked for, a row for those without readings.
    """
    share = lambda c: F.avg(F.col(c).cast("double"))
    one = results.groupBy(*KEYS).agg(
        F.round(F.count("day") / 365.0, 3).alias("length"),
        F.max("capacity").alias("capacity"),
        F.when(F.max("capacity") <= 500, "kW").otherwise("W").alias("power_units"),
        *([F.max("step_minutes").cast("double").alias("sampling")] if "step_minutes" in results.columns else []),
        F.round(share("no_errors"), 3).alias("quality_score"),
        F.round(share("is_clear"), 3).alias("clearness_score"),
        F.max("inverter_clipping").alias("inverter_clipping"),
        F.round(share("clipped"), 3).alias("clipped_fraction"),
        F.when(F.count("capacity_label") > 0, F.countDistinct("capacity_label") > 1).alias("capacity_change"),
        (~F.max("normal_scores")).alias("data_quality_warning"),
        F.max("shifted").alias("time_shift_correction"),
        F.max("time_zone_correction").alias("time_zone_correction"),
        F.max("seconds").alias("runtimes"),
        F.max("undecided").alias("undecided"),
        F.coalesce(F.max("error"), F.lit(NO_ERROR)).alias("run_pipeline_error"),
    )
    one = one.withColumn("run_pipeline_report_error", F.when(F.col("capacity").isNull(), "no daily results").otherwise(NO_ERROR))
    if losses is not None:
        one = one.join(losses, KEYS, "left").withColumns({c: F.coalesce(c, F.lit("no daily results")) for c in ("run_loss_analysis_error", "run_loss_analysis_report_error")})
    if systems is not None:
        one = systems.select(*KEYS).distinct().join(one, KEYS, "left")
    return one.withColumn("get_data_error", F.when(F.col("run_pipeline_error").isNull(), "no readings").otherwise(NO_ERROR))


def slots_of(results: DataFrame) -> DataFrame:
    """obs(system_id, day, slot, value): the corrected and filled readings of the results."""
    return results.filter("filled IS NOT NULL").select(*KEYS, "day", F.posexplode("filled").alias("slot", "value"))


LOSS_FACTORS = ["degradation", "soiling", "capacity_change", "weather"]
LOSS_SCHEMA = (
    "system_id string, day date, energy double, log_energy double, baseline double, degradation double, soiling double, capacity_change double, weather double, "
    "outage boolean, rate double, rate_low double, rate_high double, samples double, error string"
)
_LOSS_NAMES = [f.strip().split(" ")[0] for f in LOSS_SCHEMA.split(",")]


def loss_analysis(results: DataFrame, samples: bool = True, most: int = detect.MC_MOST, **options) -> DataFrame:
    """Components of each day's log energy (``LOSS_SCHEMA``); days without energy or with errors in the data are outages, whose weather is null.

    With ``samples`` the degradation rate is the median of a Monte Carlo run over levels,
    weights and held-out days, and frozen for the components; without it the fitted one.
    ``options`` are those of ``decompositions.loss_factors``.  A system that fails is one row with its error.
    The fits of some hundred systems are solved together.
    """

    def kernel(rows: pd.DataFrame) -> pa.RecordBatch:
        systems = [g for _, g in rows.groupby("system_id", sort=False)]
        return _loss_batch(systems, [loss_job(g, samples, most, **options) for g in systems])

    days = results.filter("day IS NOT NULL AND energy IS NOT NULL").select(*KEYS, "day", "energy", "capacity_label", "no_errors")
    return _in_groups(days, kernel, LOSS_SCHEMA)


def loss_job(days: pd.DataFrame, samples: bool = True, most: int = detect.MC_MOST, **options):
    """The columns of ``LOSS_SCHEMA`` from ``energy`` on of one system's days in order, as a generator that yields its fits."""
    energy, labels = days.energy.astype(float).to_numpy(), days.capacity_label.fillna(0).astype(int).to_numpy()
    good = (energy > 0.1) & days.no_errors.eq(True).to_numpy(bool)
    mc = (yield from detect.monte_carlo_fits(energy, labels, most=most, use_days=good, **options)) if samples else {}
    f = yield from dc.loss_factors_fits(energy, labels, rate=mc.get("rate"), use=good, **options)
    log_e = np.log(np.where(energy > 0.1, energy, np.nan))
    parts = {"baseline": f["baseline"], "degradation": f["degradation"], "soiling": f["soiling"], "capacity_change": f["capacity"]}
    rates = {"rate": float(f["rate"][0]), "rate_low": mc.get("low", np.nan), "rate_high": mc.get("high", np.nan)}
    return {
        "energy": energy, "log_energy": log_e, **parts, "weather": np.where(good, log_e - sum(parts.values()), np.nan), "outage": ~good,
        **{k: np.full(len(energy), detect.yearly_percent(v)) for k, v in rates.items()}, "samples": np.full(len(energy), mc.get("samples", np.nan)),
    }


def _loss_batch(systems: list[pd.DataFrame], jobs: list[Generator]) -> pa.RecordBatch:
    """Rows of ``LOSS_SCHEMA`` of the systems from their ``loss_job``."""
    found = _solved(jobs)
    columns: dict[str, list] = {c: [] for c in _LOSS_NAMES}
    for g, f in zip(systems, found):
        failed = isinstance(f, Exception)
        n = 1 if failed else len(g)
        columns["system_id"] += [g.system_id.iloc[0]] * n
        columns["day"] += [None] if failed else g.day.tolist()
        columns["error"] += [f"{type(f).__name__}: {f}"[:ERROR_CHARS]] if failed else [None] * n
        for c in _LOSS_NAMES[2:-1]:
            columns[c] += [None] if failed else f[c].tolist()
    types = [_TYPES[field.strip().split(" ")[1]] for field in LOSS_SCHEMA.split(",")]
    arrays = [pa.array(columns[c], pa.int32()).cast(t) if c == "day" else pa.array(columns[c], t, from_pandas=True) for c, t in zip(_LOSS_NAMES, types)]
    return pa.RecordBatch.from_arrays(arrays, names=_LOSS_NAMES)


def loss_report(components: DataFrame) -> DataFrame:
    """(system_id, total, outage, degradation, soiling, capacity_change, weather): the energy that each factor costs, the mean over all orders in which the five come.

    A factor multiplies a day's baseline energy by the exponential of its component; an
    outage leaves what was measured of what the other factors but the weather would give.
    """
    out = F.col("outage")
    would = F.col("baseline") + F.col("degradation") + F.col("soiling") + F.col("capacity_change")
    linear = components.filter("error IS NULL").select(
        *KEYS,
        F.exp("baseline").alias("base"),
        *[F.exp(c).alias(c) for c in LOSS_FACTORS[:-1]],
        F.when(out, 1.0).otherwise(F.exp("weather")).alias("weather"),
        F.when(out, F.coalesce(F.col("energy"), F.lit(0.0)) / F.exp(would)).otherwise(1.0).alias("outage"),
    )
    return shapley(linear, KEYS, ["outage", *LOSS_FACTORS], "base")


def loss_summary(components: DataFrame) -> DataFrame:
    """One row a system for the report: the losses of ``loss_report``, rate and bounds, and the errors of both stages."""
    energies = loss_report(components).select(
        *KEYS, F.col("total").alias("total_energy_loss"), F.col("outage").alias("system_outage_loss"), F.col("degradation").alias("degradation_energy_loss"),
        F.col("soiling").alias("soiling_energy_loss"), F.col("capacity_change").alias("capacity_change_energy_loss"), F.col("weather").alias("weather_energy_loss"),
    )
    rates = components.groupBy(*KEYS).agg(
        F.max("rate").alias("degradation_rate"), F.max("rate_low").alias("deg_rate_lower_bound"), F.max("rate_high").alias("deg_rate_upper_bound"), F.coalesce(F.max("error"), F.lit(NO_ERROR)).alias("run_loss_analysis_error")
    )
    report_error = F.when(F.col("total_energy_loss").isNull(), "no components").otherwise(NO_ERROR)
    return rates.join(energies, KEYS, "left").withColumn("run_loss_analysis_report_error", report_error)


SOILING_SCHEMA = "system_id string, day date, energy double, soiling double, season double, trend double, corrected double"


def _soiling_batch(ids: list[str], jobs: list[Generator]) -> pa.RecordBatch:
    """Rows of ``SOILING_SCHEMA`` of the systems, whose jobs return (day numbers, columns)."""
    found = _solved(jobs)
    for f in found:
        if isinstance(f, Exception):
            raise f
    days = np.concatenate([day for day, _ in found])
    names = ["energy", "soiling", "season", "trend", "corrected"]
    columns = [pa.array(np.concatenate([f[c] for _, f in found]), pa.float64()) for c in names]
    return pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(ids, object), [len(day) for day, _ in found]).tolist(), pa.string()), pa.array(days.astype("int32")).cast(pa.date32()), *columns], names=["system_id", "day", *names])


def _soiling_job(day: np.ndarray, energy: np.ndarray):
    """(days, columns) of the days with energy, as a generator that yields its fits."""
    keep = energy > 0
    day, e = day[keep], energy[keep]
    if len(e) == 0:
        return day, {c: e for c in ("energy", "soiling", "season", "trend", "corrected")}
    f = yield from dc.soiling_fits(e / np.quantile(e, 0.98))
    return day, {"energy": e, **f, "corrected": e / (1 + f["soiling"])}


def soiling_analysis(results: DataFrame) -> DataFrame:
    """(system_id, day, energy, soiling, season, trend, corrected) of energy over its 98 % quantile; corrected is the energy without soiling."""

    def kernel(rows: pd.DataFrame) -> pa.RecordBatch:
        groups = [g for _, g in rows.groupby("system_id", sort=False)]
        return _soiling_batch([g.system_id.iloc[0] for g in groups], [_soiling_job(g.day.to_numpy(), g.energy.to_numpy(float)) for g in groups])

    return _in_groups(results.filter("energy > 0").select(*KEYS, "day", "energy"), kernel, SOILING_SCHEMA)


def soiling(days: DataFrame, fix_shifts: bool = True) -> DataFrame:
    """``soiling_analysis`` from ``gridded_days`` with ``step_minutes``, in the call that analyses the days."""

    def job(fits):
        try:
            f = yield from fits
        except Exception:  # noqa: BLE001 - a system without daily results has no days here
            return (yield from _soiling_job(np.zeros(0, int), np.zeros(0)))
        return (yield from _soiling_job(np.array(f["day"], "datetime64[D]").astype(int), f["energy"]))

    def kernel(rows: pd.DataFrame) -> pa.RecordBatch:
        systems = list(_systems(rows, fix_shifts, True, labels=False))
        return _soiling_batch([system for system, *_ in systems], [job(fits) for *_, fits in systems])

    return _in_groups(_gridded_columns(days), kernel, SOILING_SCHEMA)


def location(results: DataFrame, gmt_offset: float | str) -> DataFrame:
    """(system_id, longitude, latitude): from solar noons and hours of daylight, the medians of the daily estimates.

    ``gmt_offset``: hours, or the name of a column of the results.
    """
    doy = F.dayofyear("day").cast("double")
    noon = (F.col("sunrise") + F.col("sunset")) / 2 * 60
    offset = F.col(gmt_offset) if isinstance(gmt_offset, str) else F.lit(gmt_offset)
    lon = solar.longitude_from_noon(noon, offset, solar.eot_duffie(doy))
    lat = solar.latitude_from_daylight(F.col("sunset") - F.col("sunrise"), solar.declination_cooper(doy))
    return results.filter("sunrise IS NOT NULL AND sunset IS NOT NULL").groupBy(*KEYS).agg(F.percentile(lon, F.lit(0.5)).alias("longitude"), F.percentile(lat, F.lit(0.5)).alias("latitude"))


def clear_sky(results: DataFrame, m: int, points: int = 101, level: float = 0.9, harmonics: tuple[int, int] = (16, 3)) -> DataFrame:
    """(system_id, day, slot, clear): the clear-sky model of all slots, a smooth quantile of the dilated days brought back to the clock."""
    sun = results.filter("sunrise IS NOT NULL AND sunset > sunrise").select(*KEYS, "day", "sunrise", "sunset")
    dilated = rebin.dilate(slots_of(results), sun, m, points)
    model = clear_sky_quantile(dilated, points, level, harmonics)
    return rebin.undilate(model.select(*KEYS, "day", "k", F.greatest("clear", F.lit(0.0)).alias("value")), sun, m, points).withColumnRenamed("value", "clear")


def clear_sky_quantile(dilated: DataFrame, day_length: int, level: float = 0.9, harmonics: tuple[int, int] = (8, 2)) -> DataFrame:
    """(system_id, day, k, clear): a smooth upper quantile of a dilated signal (system_id, day, k, value)."""

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["day", "k"]).reset_index(drop=True)
        days = (pd.to_datetime(pdf.day) - pd.to_datetime(pdf.day.iloc[0])).dt.days.to_numpy()
        signal = np.full((days[-1] + 1) * day_length, np.nan)
        at = days * day_length + pdf.k.to_numpy()
        signal[at] = pdf.value.astype(float)
        q = dc.smooth_quantiles(signal, [level], day_length, harmonics)[level]
        return pdf[["system_id", "day", "k"]].assign(clear=q[at])

    return dilated.select(*KEYS, "day", "k", "value").transform(_spread).groupBy(*KEYS).applyInPandas(kernel, "system_id string, day date, k int, clear double")


def performance(days: DataFrame, fix_shifts: bool = True, points: int = 101, level: float = 0.9, harmonics: tuple[int, int] = (8, 2)) -> DataFrame:
    """(system_id, day, index, error): ``studies.performance_index`` by the ``clear_sky`` model, from ``gridded_days`` with ``step_minutes``.

    A system's days are analysed, dilated, fitted and compared in one kernel call: their points meet no shuffle.
    A system with a stage that failed has its days with the error and no index; one whose days can't be analysed or fitted at all is one row with its error.
    """

    def kernel(rows: pd.DataFrame) -> pa.RecordBatch:
        systems = list(_systems(rows, fix_shifts, True, labels=False))
        return _performance_batch([system for system, *_ in systems], [performance_job(fits, points, level, harmonics) for *_, fits in systems])

    return _in_groups(_gridded_columns(days), kernel, "system_id string, day date, index double, error string")


def _performance_batch(ids: list[str], jobs: list[Generator]) -> pa.RecordBatch:
    """The rows of ``performance`` of the systems, whose jobs return (days, indexes, error)."""
    found = [([None], np.full(1, np.nan), f"{type(f).__name__}: {f}"[:ERROR_CHARS]) if isinstance(f, Exception) else f for f in _solved(jobs)]
    columns = [[x for day, *_ in found for x in day], np.concatenate([index for _, index, _ in found]), [error for day, _, error in found for _ in day]]
    of = [system for system, (day, *_) in zip(ids, found) for _ in day]
    types = [pa.string(), pa.date32(), pa.float64(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, t, from_pandas=True) for c, t in zip([of, *columns], types)], names=["system_id", "day", "index", "error"])


def performance_job(fits: Generator, points: int, level: float, harmonics: tuple[int, int]):
    """(days, index of each, error) of one system from its ``analyse_fits``, as a generator; after a stage that failed its days have no index, as each stage can move the clock or the daylight."""
    f = yield from fits
    if f["error"]:
        return np.array(f["day"]), np.full(len(f["day"]), np.nan), f["error"]
    return (*(yield from performance_fits(np.array(f["day"]), np.array(f["filled"]), f["sunrise"], f["sunset"], points, level, harmonics)), None)


def performance_fits(day: np.ndarray, filled: np.ndarray, sunrise: np.ndarray, sunset: np.ndarray, points: int, level: float, harmonics: tuple[int, int]):
    """(days with daylight, measured over clear-sky energy of each), as a generator that yields its fit."""
    with np.errstate(invalid="ignore"):
        lit = np.flatnonzero(np.isfinite(sunrise + sunset) & (sunset > sunrise))
    if len(lit) == 0:
        return day[lit], np.zeros(0)
    m, width = filled.shape[1], ((sunset - sunrise) / points)[lit, None]
    edges = sunrise[lit, None] + np.arange(points + 1) * width
    # A bin's part of the calendar day, and the mean of the readings over the bin; bins outside the day are unknown.
    inside = np.diff(np.clip(edges, 0.0, 24.0), axis=1)
    sums = np.hstack([np.zeros((len(lit), 1)), np.cumsum(filled[lit], axis=1)]) * 24 / m
    means = np.array([np.diff(np.interp(e, np.arange(m + 1) * 24 / m, s)) for e, s in zip(edges, sums)]) / np.diff(edges, axis=1)
    signal = np.full((lit[-1] - lit[0] + 1, points), np.nan)
    signal[lit - lit[0]] = np.where(inside > 0, means, np.nan)
    if not np.isfinite(signal).any():
        return day[lit], np.full(len(lit), np.nan)
    fit = yield dc.multi_periodic_quantiles, (signal.ravel(), level, points, harmonics, 0.1)
    clear = (np.maximum(fit.reshape(-1, points)[lit - lit[0]], 0.0) * inside).sum(axis=1) * m / 24
    return day[lit], filled[lit].sum(axis=1) / np.where(clear == 0, np.nan, clear)
