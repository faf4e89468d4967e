"""Spikes, stuck values and impossible readings, flagged against each source's own behaviour.

Readings are cut into time blocks of a source, each with a margin of its neighbours'
days, so a source with very many readings spreads over many tasks and each block is
judged for itself.  The blocks are shuffled once as narrow numeric rows, sorted by
the JVM, and met one after the other by ``kernels.hampel`` in Arrow batches; only
flagged readings leave Python.

Defined results
* null and NaN readings are no cases and don't part a run; infinite ones are
  impossible; rows without a time or ``row_id`` are ignored;
* a row delivered twice is judged twice and counts twice in a run; of several readings in
  one slot of the time of day all count, by their median;
* neighbouring readings more than a day away are no neighbours;
* a source of one day has no other days to be measured by: only its own
  neighbouring readings, runs and bounds count;
* equal times are met in the order of ``row_id``; null site or sensor is a source;
* empty tables give an empty table; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sunloom.kernels import hampel
from sunloom.session import ship

#: Days of a block and of its margins, for power readings and for weekly fits.  The margins hold all days that a
#: result looks at (of fits, with a quarter of the weeks missing), so it does not matter where blocks start.
POWER_BLOCK, POWER_MARGIN = 56, hampel.LOOKS_DAYS + 1
FIT_BLOCK, FIT_MARGIN = 1092, 7 * (hampel.FIT_SPAN + hampel.FIT_AROUND) * 4 // 3
#: Fields by code, with the table that each comes from.
FIELDS = (("measurements", "meas_val_f"), ("pvpro_results", "p_mp"), ("pvpro_results", "v_oc"))
_FLAG_SCHEMA = "field_no int, row_id long"


def _blocks(df: DataFrame, field: Column, value: Column, source: list[str], days: int, margin: int, origin: int = 0) -> DataFrame:
    """(gid, block, core, t, v, field_no, row_id): each reading in its block and in those whose margin it is in; a block starts at day ``origin``."""
    day = F.unix_date(F.to_date("ts")) - origin
    own = F.floor(day / days)
    near = F.array_distinct(F.array(F.floor((day - margin) / days), own, F.floor((day + margin) / days)))
    kept = df.filter(F.col("ts").isNotNull() & F.col("row_id").isNotNull()).select(
        F.xxhash64(field, *source).alias("gid"),
        own.alias("own"),
        near.alias("near"),
        (F.unix_date(F.to_date("ts")).cast("long") * 86_400_000_000 + F.timestamp_diff("MICROSECOND", F.to_date("ts").cast("timestamp_ntz"), F.col("ts").cast("timestamp_ntz"))).alias("t"),
        value.cast("double").alias("v"),
        field.alias("field_no"),
        F.col("row_id").cast("long").alias("row_id"),
    )
    kept = kept.filter(F.col("v").isNotNull() & ~F.isnan("v"))
    return kept.select("gid", F.explode("near").alias("block"), "own", "t", "v", "field_no", "row_id").select(
        "gid", "block", (F.col("block") == F.col("own")).alias("core"), "t", "v", "field_no", "row_id"
    )


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Flags of sorted blocks; a block may span batches."""
    names = ("gid", "block", "core", "t", "v", "field_no", "row_id")
    kept: list[list[np.ndarray]] = []

    def flagged(arrays: list[np.ndarray]) -> pa.RecordBatch:
        gid, block, core, t, v, field, row_id = arrays
        cut = np.flatnonzero((gid[1:] != gid[:-1]) | (block[1:] != block[:-1])) + 1
        out = np.zeros(len(gid), bool)
        for a, b in zip(np.r_[0, cut], np.r_[cut, len(gid)]):
            if core[a:b].any():
                judge = hampel.power_flags if field[a] == 0 else hampel.fit_flags
                out[a:b] = judge(t[a:b], v[a:b])
        out &= core
        return pa.RecordBatch.from_arrays([pa.array(field[out], pa.int32()), pa.array(row_id[out], pa.int64())], ["field_no", "row_id"])

    with np.errstate(all="ignore"):
        for batch in batches:
            if batch.num_rows == 0:
                continue
            arrays = [batch.column(c).to_numpy(zero_copy_only=False) for c in names]
            gid, block = arrays[0], arrays[1]
            last = np.flatnonzero((gid != gid[-1]) | (block != block[-1]))
            same_as_kept = bool(kept) and kept[-1][0][-1] == gid[0] and kept[-1][1][-1] == block[0]
            if len(last) == 0 and (not kept or same_as_kept):
                kept.append(arrays)
                continue
            end = last[-1] + 1 if len(last) else 0
            whole = [np.concatenate([*(k[i] for k in kept), arrays[i][:end]]) for i in range(len(names))]
            if len(whole[0]):
                yield flagged(whole)
            kept = [[a[end:] for a in arrays]]
        if kept:
            yield flagged([np.concatenate([k[i] for k in kept]) for i in range(len(names))])


def flag_readings(measurements: DataFrame | None, fits: DataFrame | None, origin: int = 0) -> DataFrame:
    """(tab, row_id, field) of each reading that its source can't have measured."""
    parts = []
    if measurements is not None:
        parts.append(_blocks(measurements, F.lit(0), F.col("meas_val_f"), ["site", "sensor"], POWER_BLOCK, POWER_MARGIN, origin))
    if fits is not None:
        parts += [_blocks(fits, F.lit(i), F.col(c), ["site", "system"], FIT_BLOCK, FIT_MARGIN, origin) for i, c in ((1, "p_mp"), (2, "v_oc"))]
    blocks = parts[0]
    for p in parts[1:]:
        blocks = blocks.unionByName(p)
    ship(blocks.sparkSession)
    flags = blocks.repartition("gid", "block").sortWithinPartitions("gid", "block", "t", "row_id").mapInArrow(_judge, _FLAG_SCHEMA)
    names = F.array(*[F.struct(F.lit(t).alias("tab"), F.lit(f).alias("field")) for t, f in FIELDS])
    return flags.withColumn("n", F.element_at(names, F.col("field_no") + 1)).select("n.tab", "row_id", "n.field")


def found(measurements: DataFrame, fits: DataFrame) -> DataFrame:
    """The flagged readings of both tables."""
    return flag_readings(measurements, fits)
