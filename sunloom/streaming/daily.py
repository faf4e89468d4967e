"""Daily statistics of a stream of readings.

The statistics of a day are plain aggregates, so the stream and the batch give the same
rows, also of times that were delivered with several values.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LATE = "1 day"


def daily_stream(readings: DataFrame, capacity: float, late: str = LATE) -> DataFrame:
    """(system_id, day, n, energy, top, first_bright, last_bright) of readings (system_id, ts timestamp, value).

    Append mode: a day is out once the watermark has passed its end.  Works on batch tables alike.
    """
    bright = F.when(F.col("value") > 0.02 * capacity, F.col("ts"))
    clean = readings.filter(F.col("ts").isNotNull() & F.col("value").isNotNull() & ~F.isnan("value")).withWatermark("ts", late)
    # Of several values of one time the smallest, in a stream as in a batch.
    clean = clean.groupBy("system_id", "ts").agg(F.min("value").alias("value"))
    days = clean.groupBy("system_id", F.window("ts", "1 day").alias("w")).agg(
        F.count("*").alias("n"), F.sum("value").alias("energy"), F.max("value").alias("top"), F.min(bright).alias("first_bright"), F.max(bright).alias("last_bright")
    )
    return days.select("system_id", F.to_date("w.start").alias("day"), "n", "energy", "top", "first_bright", "last_bright")


def outages(readings: DataFrame, gap: str = "3 hours", late: str = LATE) -> DataFrame:
    """(system_id, start, end, n): stretches of readings without a pause of ``gap``, as session windows."""
    clean = readings.filter(F.col("ts").isNotNull()).withWatermark("ts", late)
    s = clean.groupBy("system_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return s.select("system_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def refit(stream: DataFrame, table_path: str, checkpoint: str, fit: Callable[[DataFrame, int], None]):
    """Start a query that appends finished days to a table and calls ``fit`` with the whole table after each batch."""

    def write(batch: DataFrame, epoch: int) -> None:
        # A batch that is repeated after a failure replaces its own folder.
        batch.write.mode("overwrite").parquet(f"{table_path}/epoch={epoch}")
        fit(batch.sparkSession.read.parquet(table_path), epoch)

    return stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(write).start()
