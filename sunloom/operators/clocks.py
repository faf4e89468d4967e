"""Stamps in mixed formats, precisions and zones to one UTC time.

Each stamp is turned into a character-class mask (digits to 9, letters to A), each
distinct mask is mapped to a parser once, and all stamps of a mask are converted
together (``kernels.stamps``, over Arrow batches).  The log is read once for that; the
few numbers of each stamp are written to the shared folder and all else reads them.
Local clocks are resolved through a table of zone transitions that is computed from the
zone database for the years that the log holds, and carries its version.

An hour that occurs twice is told apart by the order of the records: only records
within some hours of such a transition are compared, each (system, transition) for
itself, so a system with very many records is never gathered in one task.

Defined results
* null, empty and unreadable stamps, dates that don't exist and hours past 23: null;
* a local time that is skipped by a change of the clock is read with the offset before
  the change; all changes of a year count, in years 1 to 9999;
* days and months are told apart by the records of the same system whose day is
  past 12, more of which decide; a system without any counts as month first, dates
  with dots always as day first;
* an abbreviation that several zones share means that of the system's own zone, else the
  smallest of their offsets; an unknown one gives no time;
* with equal ``revised_at`` the metadata row with the largest values holds; systems
  without metadata have times only for stamps with a zone or since 1970;
* records that equal each other in an undecidable repeated hour take the earlier time;
* an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from datetime import datetime, timedelta, timezone
from pathlib import Path
from zoneinfo import TZPATH, ZoneInfo, ZoneInfoNotFoundError

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sunloom.kernels import stamps
from sunloom.session import cut_lineage, ship

HOUR_MS = 3_600_000
#: Hours around a repeated hour in which records are compared.
NEAR_H = 6
#: Rules of the zone database repeat from this year on, each after ``CYCLE`` years.
REPEATS_FROM, CYCLE = 2101, 400
#: No clock changed before this year.
NO_CHANGES_BEFORE = 1800
_EVER = 1 << 60
_SEGMENT = "struct<start:bigint,stop:bigint,off:bigint>"
_TRANSITIONS = f"zone string, year int, segments array<{_SEGMENT}>, folds array<bigint>"


def tz_version() -> str:
    """Version of the zone database in use."""
    for base in TZPATH:
        zi = Path(base, "tzdata.zi")
        if zi.exists():
            with zi.open() as f:
                return f.readline().strip().removeprefix("# version ")
    return "unknown"


def zone_segments(zone: str, years: Iterable[int]) -> list[tuple]:
    """(zone, year, segments, folds) for each local year: the stretches of UTC ms with their offsets in ms, and the changes back."""
    try:
        z = ZoneInfo(zone)
    except (ZoneInfoNotFoundError, ValueError):
        return []
    epoch = datetime(1970, 1, 1, tzinfo=timezone.utc)
    cycle_ms = 146_097 * stamps.DAY_MS

    def offset(t: int) -> int:
        return int((epoch + timedelta(seconds=t)).astimezone(z).utcoffset().total_seconds())

    def changes(year: int) -> list[tuple[int, int]]:
        """The offset at the start of the year, less a day, and all changes until a day after its end, in seconds."""
        start = int((datetime(max(year, 2), 1, 1, tzinfo=timezone.utc) - epoch).total_seconds()) - 86_400
        days = 368 if year >= NO_CHANGES_BEFORE else 0
        out, o = [(-_EVER, offset(start))], offset(start)
        for t in range(start, start + days * 86_400, 86_400):
            if (o2 := offset(t + 86_400)) != o:
                lo, hi = t, t + 86_400
                while hi - lo > 1:
                    mid = (lo + hi) // 2
                    lo, hi = (mid, hi) if offset(mid) == o else (lo, mid)
                out.append((hi * 1000, o2))
                o = o2
        return out

    rows = []
    for year in sorted(set(years)):
        turns = max(0, (year - REPEATS_FROM) // CYCLE)
        found = [(u + turns * cycle_ms if u > -_EVER else u, o * 1000) for u, o in changes(year - turns * CYCLE)]
        stops = [u for u, _ in found[1:]] + [_EVER]
        rows.append((zone, year, [(u, v, o) for (u, o), v in zip(found, stops)], [u for (u, o), (_, before) in zip(found[1:], found) if o < before]))
    return rows


def transition_table(zone_names: DataFrame, years: Iterable[int]) -> DataFrame:
    """Versioned transitions of the zones in ``zone_names`` (a fixed table of a dozen zones) in the given local years."""
    years = sorted(set(years))
    zones = sorted(r[0] for r in zone_names.select("time_zone").filter("time_zone IS NOT NULL").distinct().collect())
    rows = [r for z in zones for r in zone_segments(z, years)]
    return zone_names.sparkSession.createDataFrame(rows, _TRANSITIONS).withColumn("tz_version", F.lit(tz_version()))


def latest_metadata(meta: DataFrame) -> DataFrame:
    """The row with the latest ``revised_at`` of each system, by one aggregation."""
    fields = ["site", "power_column_label", "data_sampling", "time_shift_manual", "gmt_offset", "time_zone", "time_zone_correction"]
    number = lambda c: F.when(~F.isnan(c), F.col(c)) if c in ("gmt_offset", "data_sampling") else F.col(c)
    last = F.max(F.struct("revised_at", *[number(c).alias(c) for c in fields])).alias("m")
    return meta.filter(F.col("system").isNotNull()).groupBy("system").agg(last).select("system", *[F.col(f"m.{c}") for c in fields])


def read_stamps(log: DataFrame) -> DataFrame:
    """(rec_id, system, seq_no, mask, family, clock, swapped, absolute, abbr, hint): the numbers of each record's stamp."""
    source = log.select("rec_id", F.col("system").cast("string").alias("system"), F.col("seq_no").cast("long").alias("seq_no"), F.btrim(F.col("raw_ts").cast("string"), F.lit(" \t\r\n")).alias("t"))
    names = ("mask", "family", "clock", "swapped", "absolute", "abbr", "hint")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = stamps.Reader()
        for batch in batches:
            read = reader.read(batch.column("t"))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("rec_id", "system", "seq_no")), *(read[c] for c in names)], ["rec_id", "system", "seq_no", *names])

    ship(log.sparkSession)
    id_type = source.schema["rec_id"].dataType.simpleString()
    return source.mapInArrow(run, f"rec_id {id_type}, system string, seq_no long, mask string, family string, clock long, swapped long, absolute long, abbr string, hint int")


def _abbreviations(zone_names: DataFrame) -> DataFrame:
    """(abbr, by_zone map of zone to hours, least hours) of the fixed table of zones."""
    pairs = F.array(*[F.struct(F.upper(f"{k}_abbr").alias("abbr"), F.col(f"{k}_offset_h").alias("h")) for k in ("std", "dst")])
    each = zone_names.select("time_zone", F.explode(pairs).alias("z")).select("time_zone", "z.*").filter("abbr IS NOT NULL AND h IS NOT NULL AND NOT isnan(h)")
    own = each.filter("time_zone IS NOT NULL").groupBy("abbr", "time_zone").agg(F.min("h").alias("h"))
    by_zone = own.groupBy("abbr").agg(F.map_from_entries(F.collect_list(F.struct("time_zone", "h"))).alias("by_zone"))
    return each.groupBy("abbr").agg(F.min("h").alias("least_h")).join(by_zone, "abbr", "left")


def _systems(read: DataFrame, meta: DataFrame, zone_names: DataFrame) -> DataFrame:
    """One row a system: its zone, standard offset, correction and order of day and month."""
    order = read.filter((F.col("family") == "slash") & F.col("system").isNotNull()).groupBy("system").agg((F.count_if(F.col("hint") > 0) > F.count_if(F.col("hint") < 0)).alias("day_is_first"))
    zones = zone_names.select("time_zone", F.nanvl("std_offset_h", F.lit(None)).alias("std_h"))
    return (
        latest_metadata(meta)
        # A fixed table of a dozen zones.
        .join(F.broadcast(zones.groupBy("time_zone").agg(F.max("std_h").alias("std_h"))), "time_zone", "left")
        .join(order, "system", "full_outer")
        .select(
            "system",
            "time_zone",
            (F.coalesce("time_shift_manual", F.lit(0)) == 1).alias("follows"),
            F.round(F.coalesce("std_h", "gmt_offset") * HOUR_MS).cast("long").alias("std_ms"),
            (F.coalesce("time_zone_correction", F.lit(0)).cast("long") * HOUR_MS).alias("correction_ms"),
            F.coalesce("day_is_first", F.lit(False)).alias("day_is_first"),
        )
    )


def _utc_of(clock: Column) -> tuple[Column, Column]:
    """(earliest, latest) UTC ms that a clock following its zone can mean, by the segments of its year."""
    fits = lambda s: (clock - s["off"] >= s["start"]) & (clock - s["off"] < s["stop"])
    may = F.transform(F.filter("segments", fits), lambda s: clock - s["off"])
    # Skipped by a change: the last segment that is over by its own clock.
    gone = F.array_max(F.transform(F.filter("segments", lambda s: clock - s["off"] >= s["stop"]), lambda s: F.struct(s["stop"].alias("stop"), (clock - s["off"]).alias("ms"))))["ms"]
    return F.coalesce(F.array_min(may), gone), F.coalesce(F.array_max(may), gone)


def utc_times(log: DataFrame, meta: DataFrame, zone_names: DataFrame) -> DataFrame:
    """(rec_id, utc_ms, mask, family, source, tz_version) of all records; utc_ms is null where a stamp gives no time.

    source: absolute, zone (clock with daylight time), standard, or null; tz_version: of
    the zone database, where it was asked.
    """
    read = cut_lineage(read_stamps(log))
    # The tables of zones and abbreviations have a proven bound; metadata grows and is joined as the planner decides.
    joined = read.join(_systems(read, meta, zone_names), "system", "left").join(F.broadcast(_abbreviations(zone_names)), "abbr", "left")
    written = F.when((F.col("family") == "slash") & F.coalesce("day_is_first", F.lit(False)), F.col("swapped")).otherwise(F.col("clock"))
    stated_ms = F.round(F.coalesce(F.try_element_at("by_zone", F.col("time_zone")), F.col("least_h")) * HOUR_MS).cast("long")
    local = joined.select(
        "rec_id", "system", "seq_no", "mask", "family", "time_zone", "follows", "std_ms", "correction_ms",
        F.coalesce("absolute", F.when(F.col("abbr").isNotNull(), written - stated_ms)).alias("absolute"),
        F.when(F.col("abbr").isNull() & F.col("absolute").isNull(), written).alias("clock"),
    )
    # At most the years 1 to 9999; those next to them for times near a year's end.
    shown = F.year(F.timestamp_millis(F.coalesce("clock", "swapped", "absolute")))
    years = [r[0] for r in read.select(shown.alias("year")).distinct().collect() if r[0] is not None]
    table = transition_table(zone_names, [y + k for y in years for k in (-1, 0, 1) if 1 <= y + k <= 9999])
    at = local.withColumn("local_year", F.year(F.timestamp_millis(F.coalesce("clock", F.col("absolute") + F.coalesce("std_ms", F.lit(0)))))).join(
        F.broadcast(table), (F.col("time_zone") == F.col("zone")) & (F.col("local_year") == F.col("year")) & F.col("follows"), "left"
    ).drop("year", "local_year")
    early, late = _utc_of(F.col("clock"))
    absolute, zoned = F.col("absolute").isNotNull(), F.col("follows") & F.col("zone").isNotNull()
    at = at.withColumns(
        {
            "early": F.when(absolute, F.col("absolute")).when(zoned, early).otherwise(F.col("clock") - F.col("std_ms") + F.when(F.col("follows"), 0).otherwise(F.col("correction_ms"))),
            "late": F.when(absolute, F.col("absolute")).when(zoned, late),
            "source": F.when(absolute, F.lit("absolute")).when(zoned, F.lit("zone")).otherwise(F.lit("standard")),
        }
    )
    # The change back that a time is near to.
    fold = F.when(zoned & F.col("seq_no").isNotNull(), F.get(F.filter("folds", lambda f: F.abs(F.col("early") - f) <= NEAR_H * HOUR_MS), F.lit(0)))
    at = at.withColumn("fold", fold).withColumn("tz_version", F.when(F.col("source") == "zone", F.col("tz_version"))).drop("segments", "folds")
    columns = ["rec_id", "utc_ms", "mask", "family", "source", "tz_version"]
    plain = at.filter(F.col("fold").isNull()).withColumn("utc_ms", F.col("early"))
    close = _told_apart(at.filter(F.col("fold").isNotNull()).select("rec_id", "system", "seq_no", "mask", "family", "source", "tz_version", "clock", "fold", "early", "late"))
    given = F.col("utc_ms").isNotNull()
    return plain.select(columns).unionByName(close.select(columns)).withColumns({"source": F.when(given, F.col("source")), "tz_version": F.when(given, F.col("tz_version"))})


def _told_apart(near: DataFrame) -> DataFrame:
    """Choose between early and late by ``seq_no``, among the records near one transition of one system."""
    by = Window.partitionBy("system", "fold").orderBy("seq_no")
    before, after = by.rangeBetween(Window.unboundedPreceding, 0), by.rangeBetween(0, Window.unboundedFollowing)
    known = F.when(F.col("early") == F.col("late"), F.col("early"))
    doubt = F.col("early") < F.col("late")
    clock = F.when(doubt, F.col("clock"))
    told = near.withColumns(
        {
            # How far each choice breaks the order of the known times, and whether the clock went back among the doubtful.
            "early_breaks": F.greatest(F.coalesce(F.max(known).over(before) - F.col("early"), F.lit(0)), F.lit(0)),
            "late_breaks": F.greatest(F.coalesce(F.col("late") - F.min(known).over(after), F.lit(0)), F.lit(0)),
            "went_back": F.coalesce(F.max(clock).over(before) > F.col("clock") + 60_000, F.lit(False)),
            "goes_back": F.coalesce(F.min(clock).over(after) < F.col("clock") - 60_000, F.lit(False)),
        }
    ).withColumns(
        {
            "is_late": doubt & ((F.col("early_breaks") > F.col("late_breaks")) | ((F.col("early_breaks") == F.col("late_breaks")) & F.col("went_back"))),
            "is_early": doubt & ((F.col("late_breaks") > F.col("early_breaks")) | ((F.col("early_breaks") == F.col("late_breaks")) & F.col("goes_back"))),
        }
    )
    # What comes after a late record is late too, what comes before an early one early.
    told = told.withColumns({"after_late": F.max("is_late").over(before), "before_early": F.max("is_early").over(after)})
    late = F.when(F.col("is_late"), True).when(F.col("is_early"), False).when(F.col("after_late"), True).otherwise(False)
    return told.withColumns({"utc_ms": F.when(doubt & late, F.col("late")).otherwise(F.col("early")), "undecided": doubt & ~F.col("is_late") & ~F.col("is_early") & ~F.col("after_late") & ~F.col("before_early")})


def found(log: DataFrame, meta: DataFrame, zone_names: DataFrame) -> DataFrame:
    """(rec_id, utc_ms) of each record whose stamp gives a time."""
    return utc_times(log, meta, zone_names).filter(F.col("utc_ms").isNotNull()).select("rec_id", "utc_ms")
