"""Window operators over ordered rows of a system: runs, segments, year lags, buckets, two-state labels."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sunloom.session import ship


def runs(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """(keys, run, start, length, value): maximal runs of equal values in order; nulls equal each other."""
    w = Window.partitionBy(*keys).orderBy(order)
    change = F.when(F.row_number().over(w) == 1, 0).when(F.col(value).eqNullSafe(F.lag(value).over(w)), 0).otherwise(1)
    marked = df.select(*keys, order, value, change.alias("c")).withColumn("run", F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*keys, "run").agg(F.min(order).alias("start"), F.count("*").alias("length"), F.min(value).alias("value"))


def segment_differences(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """(keys, order, pooled): differences of neighbouring rows, those in a row that aren't 0 pooled at the last of them, 0 elsewhere."""
    w = Window.partitionBy(*keys).orderBy(order)
    d = df.select(*keys, order, (F.col(value) - F.lag(value).over(w)).alias("d")).filter("d IS NOT NULL")
    starts = F.when((F.col("d") != 0) & (F.coalesce(F.lag("d").over(w), F.lit(0.0)) == 0), 1).otherwise(0)
    s = d.withColumns({"g": F.sum(starts).over(w.rowsBetween(Window.unboundedPreceding, 0)), "last": (F.col("d") != 0) & (F.coalesce(F.lead("d").over(w), F.lit(0.0)) == 0)})
    # A segment's sum is over its own rows only.
    own = Window.partitionBy(*keys, "g")
    total = F.sum(F.when(F.col("d") != 0, F.col("d"))).over(own)
    return s.select(*keys, order, F.when(F.col("last"), total).otherwise(0.0).alias("pooled"))


def reduce_clusters(df: DataFrame, keys: list[str], order: str, mask: str, metric: str) -> DataFrame:
    """One row of each run of true ``mask``: the one with the largest metric, the first of equal ones."""
    w = Window.partitionBy(*keys).orderBy(order)
    change = F.when(F.coalesce(F.lag(mask).over(w), F.lit(False)) == F.col(mask), 0).otherwise(1)
    marked = df.withColumn("_d", change).withColumn("_c", F.sum("_d").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    best = F.max_by(F.struct(order, metric), F.struct(F.col(metric), (-F.col(order)).alias("o")))
    return marked.filter(F.col(mask)).groupBy(*keys, "_c").agg(best.alias("b")).select(*keys, f"b.{order}", f"b.{metric}")


def running_total(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """(keys, order, value, start, total): the sum up to each row, and where it starts (the offset of a waterfall's bar)."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum(F.coalesce(F.col(value), F.lit(0.0))).over(w)
    return df.select(*keys, order, value, total.alias("total")).withColumn("start", F.col("total") - F.coalesce(F.col(value), F.lit(0.0)))


def lag_change(df: DataFrame, keys: list[str], order: str, value: str, lag: int = 365) -> DataFrame:
    """(keys, order, change): (value - value ``lag`` rows before) / value."""
    w = Window.partitionBy(*keys).orderBy(order)
    return df.select(*keys, order, ((F.col(value) - F.lag(value, lag).over(w)) / F.nullif(F.col(value), F.lit(0.0))).alias("change"))


def degradation_rate(df: DataFrame, keys: list[str], order: str, value: str, lag: int = 365) -> DataFrame:
    """(keys, rate): percent a year, the median of the year-on-year changes."""
    return lag_change(df, keys, order, value, lag).groupBy(*keys).agg((100 * F.percentile("change", F.lit(0.5))).alias("rate"))


def jumps(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """(keys, n_jumps, least_jump) of a piecewise constant signal."""
    w = Window.partitionBy(*keys).orderBy(order)
    d = F.abs(F.col(value) - F.lag(value).over(w))
    return df.withColumn("_d", d).groupBy(*keys).agg(F.count_if(F.col("_d") > 0).alias("n_jumps"), F.min(F.when(F.col("_d") > 0, F.col("_d"))).alias("least_jump"))


def capacity_labels(df: DataFrame, keys: list[str], order: str, value: str, width: float = 0.05) -> DataFrame:
    """Adds ``bucket`` (value relative to the first, to the nearest ``width``) and ``label`` (0, 1, ... in order of the bucket)."""
    first = F.first(value).over(Window.partitionBy(*keys).orderBy(order))
    bucket = (F.bround((F.col(value) - first) / width) * width).cast("double")
    return df.withColumn("bucket", bucket).withColumn("label", F.dense_rank().over(Window.partitionBy(*keys).orderBy("bucket")) - 1)


def centred_mean(df: DataFrame, keys: list[str], order: str, value: str, half: int) -> Column:
    """Centred rolling mean where the window is whole, filled forward and then backward elsewhere."""
    w = Window.partitionBy(*keys).orderBy(order)
    around = w.rowsBetween(-half, half)
    mean = F.when(F.count(F.lit(1)).over(around) == 2 * half + 1, F.avg(value).over(around))
    return mean


def rolling_mean(df: DataFrame, keys: list[str], order: str, value: str, half: int) -> DataFrame:
    """Adds ``mean``: centred rolling mean, filled forward, then backward."""
    w = Window.partitionBy(*keys).orderBy(order)
    raw = df.withColumn("_m", centred_mean(df, keys, order, value, half))
    forward = F.last("_m", True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    back = F.first("_m", True).over(w.rowsBetween(0, Window.unboundedFollowing))
    return raw.withColumn("mean", F.coalesce(forward, back)).drop("_m")


def _walk(batches: Iterator[pa.RecordBatch], groups: list[str], change: float, summary: bool) -> Iterator[pa.RecordBatch]:
    """Rows in order, group by group: labels, or of each group the map from the state before it to the one after it.

    The state is the cost inside less the cost outside.  A row with the costs' difference d
    takes state s to clip(s, -change, change) + d; rows together take s to clip(s, low, high) + move.
    """
    before: tuple | None = None
    state, low, high, move = 0.0, float("-inf"), float("inf"), 0.0

    def summed(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) if rows else [[]] * (len(groups) + 3)
        arrays = [pa.array(c, t) for c, t in zip(columns, [*key_types, *[pa.float64()] * 3])]
        return pa.RecordBatch.from_arrays(arrays, [*groups, "low", "high", "move"])

    key_types: list[pa.DataType] = []
    for batch in batches:
        key_types = [batch.schema.field(g).type for g in groups]
        keys = list(zip(*(batch.column(g).to_pylist() for g in groups)))
        starts = batch.column("start").to_pylist()
        out: list = []
        for key, start, d in zip(keys, starts, batch.column("d").to_pylist()):
            if key != before:
                if summary and before is not None:
                    out.append((*before, low, high, move))
                before, state, low, high, move = key, start, float("-inf"), float("inf"), 0.0
            if summary:
                low, high, move = min(max(low, -change - move), change - move), min(max(high, -change - move), change - move), move + d
            else:
                state = min(max(state, -change), change) + d
                out.append(state < 0)
        if summary:
            yield summed(out)
        else:
            kept = [c for c in batch.schema.names if c not in ("start", "d")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(out, pa.bool_())], [*kept, "inside"])
    if summary and before is not None:
        yield summed([(*before, low, high, move)])


def two_state_labels(df: DataFrame, keys: list[str], order: str, cost_out: str, cost_in: str, change: float, shard: str | None = None) -> DataFrame:
    """(keys, order, inside): labels by the forward costs of a two-state dynamic program, without going back.

    Costs per row are given for both states; a change costs ``change``; equal costs are
    outside; a null cost counts as 0.  With ``shard``, a column that rises with the order (a
    day), each shard is reduced to the map that it makes of the state before it, the maps
    are composed over one small row a shard, and all shards are labelled for themselves, so
    a source with very many rows spreads over as many tasks as it has shards.
    """
    ship(df.sparkSession)
    groups = [*keys, *([shard] if shard else [])]
    d = F.coalesce(F.col(cost_in).cast("double"), F.lit(0.0)) - F.coalesce(F.col(cost_out).cast("double"), F.lit(0.0))
    rows = df.select(*dict.fromkeys([*groups, order]), d.alias("d"))
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = lambda names, more: ", ".join([*(f"`{n}` {types[n]}" for n in names), more])
    kept = list(dict.fromkeys([*groups, order]))

    def labels(ready: DataFrame) -> DataFrame:
        ordered = ready.repartition(*groups).sortWithinPartitions(*groups, order).select(*kept, "start", "d")
        return ordered.mapInArrow(lambda b: _walk(b, groups, change, False), schema(kept, "inside boolean")).select(*dict.fromkeys([*keys, *([shard] if shard in keys else []), order]), "inside")

    if shard is None:
        return labels(rows.withColumn("start", F.lit(0.0)))
    by_shard = rows.withColumn("start", F.lit(0.0)).repartition(*groups).sortWithinPartitions(*groups, order).select(*groups, "start", "d")
    maps = by_shard.mapInArrow(lambda b: _walk(b, groups, change, True), schema(groups, "low double, high double, move double"))

    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, state = None, 0.0
        for batch in batches:
            starts = []
            for key, low, high, move in zip(zip(*(batch.column(k).to_pylist() for k in keys)), *(batch.column(c).to_pylist() for c in ("low", "high", "move"))):
                if key != before:
                    before, state = key, 0.0
                starts.append(state)
                state = min(max(state, low), high) + move
            yield pa.RecordBatch.from_arrays([*(batch.column(g) for g in groups), pa.array(starts, pa.float64())], [*groups, "start"])

    states = maps.repartition(*keys).sortWithinPartitions(*groups).mapInArrow(compose, schema(groups, "start double"))
    same = states.select(*[F.col(g).alias(f"_{g}") for g in groups], "start")
    on = [F.col(g).eqNullSafe(F.col(f"_{g}")) for g in groups]
    met = on[0]
    for c in on[1:]:
        met &= c
    return labels(rows.join(same, met).select(*kept, "start", "d"))
