"""Sources and sinks: delimited files, site records, polygons, databases, a registry of plugs, a Python data source.

Schemas are stated, never inferred from the data, so a scan reads each file once.
"""

from __future__ import annotations

from collections.abc import Callable
from math import atan2, cos, degrees, hypot, radians, sqrt

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from sunloom.operators.tables import not_done
from sunloom.session import ship

SITE_SCHEMA = "Site struct<location:string,longitude:double,latitude:double>, Mount map<string,struct<tilt:double,azimuth:double>>, Inverters map<string,struct<inverter_id:string>>"
LONG_SCHEMA = "ts timestamp_ntz, site string, sensor string, meas_name string, meas_val_f double"


def read_csv(spark: SparkSession, path: str, columns: dict[str, str], ts: str = "ts", limit: int | None = None, ts_format: str | None = None) -> DataFrame:
    """Delimited files with a header and a time column; ``system_id`` is the file's name.  ``columns`` maps value columns to types."""
    schema = T.StructType([T.StructField(ts, T.TimestampNTZType()), *[T.StructField(c, T._parse_datatype_string(t)) for c, t in columns.items()]])
    reader = spark.read.schema(schema).option("header", True).option("enforceSchema", False).option("mode", "PERMISSIVE")
    if ts_format:
        reader = reader.option("timestampNTZFormat", ts_format)
    df = reader.csv(path).withColumn("system_id", F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(?:\.csv)?(?:\.gz)?$", 1))
    return df.limit(limit) if limit is not None else df


def list_files(spark: SparkSession, folder: str, pattern: str = "*.csv") -> DataFrame:
    """(path, size) of the files of a folder, without reading their contents."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(folder).select("path", F.col("length").alias("size"))


def read_long(spark: SparkSession, path: str, site: str | None = None, sensor: str | None = None, since: str | None = None, until: str | None = None) -> DataFrame:
    """The long measurement table, with filters that reach the scan."""
    df = spark.read.parquet(path)
    for column, value in (("site", site), ("sensor", sensor)):
        if value is not None:
            df = df.filter(F.col(column) == value)
    if since is not None:
        df = df.filter(F.col("ts") >= F.lit(since).cast("timestamp_ntz"))
    if until is not None:
        df = df.filter(F.col("ts") < F.lit(until).cast("timestamp_ntz"))
    return df


def read_site_json(spark: SparkSession, path: str) -> DataFrame:
    """(location, longitude, latitude, inverter, inverter_id) of well-formed site records, one JSON object a line."""
    body = spark.read.text(path).select(F.from_json("value", SITE_SCHEMA).alias("b"))
    return body.select("b.Site.*", F.explode_outer("b.Inverters").alias("inverter", "i")).select("location", "longitude", "latitude", "inverter", F.col("i.inverter_id").alias("inverter_id"))


def read_jdbc(spark: SparkSession, url: str, table: str, predicates: list[str], properties: dict[str, str]) -> DataFrame:
    """A database table, one partition for each predicate."""
    return spark.read.jdbc(url, table, predicates=predicates, properties=properties)


def plane_of(ring: list[tuple[float, float, float]]) -> tuple[float, float]:
    """(tilt, azimuth) in degrees of a roof polygon of (longitude, latitude, height in metres), from the cross product of its first edges."""
    (x0, y0, z0), (x1, y1, z1), (x2, y2, z2) = ring[:3]
    m = 111_320.0
    u = ((x1 - x0) * m * cos(radians(y0)), (y1 - y0) * m, z1 - z0)
    v = ((x2 - x0) * m * cos(radians(y0)), (y2 - y0) * m, z2 - z0)
    n = (u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0])
    if n[2] < 0:
        n = tuple(-c for c in n)
    tilt = degrees(atan2(hypot(n[0], n[1]), n[2]))
    return tilt, degrees(atan2(n[0], n[1])) % 360 if sqrt(n[0] ** 2 + n[1] ** 2) > 0 else 0.0


def read_kml(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, tilt, azimuth) of each polygon with heights in KML files."""
    import xml.etree.ElementTree as ET

    def parse(batches):
        for pdf in batches:
            rows = []
            for p, content in zip(pdf.path, pdf.content):
                try:
                    root = ET.fromstring(bytes(content))
                except ET.ParseError:
                    continue
                for mark in root.iterfind(".//{*}Placemark"):
                    name = mark.findtext("{*}name") or ""
                    for c in mark.iterfind(".//{*}coordinates"):
                        ring = [tuple(map(float, x.split(","))) for x in (c.text or "").split() if x.count(",") == 2]
                        if len(ring) >= 3:
                            rows.append((p, name, *plane_of(ring)))
            yield pd.DataFrame(rows, columns=["path", "name", "tilt", "azimuth"])

    ship(spark)
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(parse, "path string, name string, tilt double, azimuth double")


def plane_summary(planes: DataFrame) -> DataFrame:
    """(path, mean, median and deviation of tilt and azimuth)."""
    out = []
    for c in ("tilt", "azimuth"):
        out += [F.avg(c).alias(f"{c}_mean"), F.percentile(c, F.lit(0.5)).alias(f"{c}_median"), F.stddev_pop(c).alias(f"{c}_std")]
    return planes.groupBy("path").agg(*out)


#: Named sources: functions of a session and keys that give (system_id, ts, value).
PLUGS: dict[str, Callable[..., DataFrame]] = {}


def plug(name: str):
    """Register a source by name."""

    def add(f):
        PLUGS[name] = f
        return f

    return add


@plug("measurements")
def measurements(spark: SparkSession, path: str, **filters) -> DataFrame:
    """Power readings of the long table; the system is the sensor."""
    return read_long(spark, path, **filters).select(F.col("sensor").alias("system_id"), "ts", F.col("meas_val_f").alias("value"))


@plug("csv")
def csv(spark: SparkSession, path: str, column: str, **options) -> DataFrame:
    return read_csv(spark, path, {column: "double"}, **options).select("system_id", "ts", F.col(column).alias("value"))


def write_results(df: DataFrame, path: str, keys: list[str], mode: str = "append") -> None:
    """Append results by key, so that a run can be resumed."""
    df.write.mode(mode).partitionBy(*keys).parquet(path)


def resume(keys: DataFrame, path: str, on: list[str]) -> DataFrame:
    """Keys without results at ``path``; all of them if there are none yet."""
    spark = keys.sparkSession
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        return keys
    return not_done(keys, spark.read.parquet(path), on)


def merge_results(spark: SparkSession, path: str) -> DataFrame:
    """The results of all runs that wrote to a folder, as one table."""
    return spark.read.option("mergeSchema", True).parquet(path)


def time_column(df: DataFrame, named: str | None = None) -> str:
    """The named column, else the first one whose name holds "time"; an error if there is none."""
    found = [named] if named in df.columns else [c for c in df.columns if "time" in c.lower()]
    if not found:
        raise ValueError(f"no time column among {df.columns}")
    return found[0]


def with_times(df: DataFrame, named: str | None = None, pattern: str | None = None) -> DataFrame:
    """df with ``ts``, its time column's texts as timestamps; unreadable ones are null."""
    return df.withColumn("ts", F.try_to_timestamp(F.col(time_column(df, named)), *([F.lit(pattern)] if pattern else [])).cast("timestamp_ntz"))


class SyntheticSource(DataSource):
    """Simulated power of a few systems as a data source: ``spark.read.format("sunloom_synthetic")``.

    Options: systems, days, step (minutes), seed, soiling (rate a day), seasonal (part by which
    the rate and the chance of cleaning swing over the year).  Each system is a
    partition, and its numbers depend only on the seed and its own number.
    """

    @classmethod
    def name(cls) -> str:
        return "sunloom_synthetic"

    def schema(self) -> str:
        return "system_id string, ts timestamp_ntz, value double"

    def reader(self, schema):
        return _SyntheticReader(self.options)


class _SyntheticReader(DataSourceReader):
    def __init__(self, options):
        self.options = dict(options)

    def partitions(self):
        return [InputPartition(i) for i in range(int(self.options.get("systems", 4)))]

    def read(self, partition):
        from datetime import datetime, timedelta

        import numpy as np

        i, o = partition.value, self.options
        days, step, rate, swing = int(o.get("days", 365)), int(o.get("step", 60)), float(o.get("soiling", 0.0)), float(o.get("seasonal", 0.0))
        rng = np.random.default_rng([int(o.get("seed", 0)), i])
        start, dirt = datetime(2020, 1, 1), 0.0
        lat = np.radians(25 + 20 * rng.random())
        for d in range(days):
            dec = np.radians(23.45 * np.sin(2 * np.pi * (d + 285) / 365))
            half = np.degrees(np.arccos(np.clip(-np.tan(lat) * np.tan(dec), -1, 1))) / 15
            # Dry summers: more dirt and less rain.
            season = swing * np.sin(2 * np.pi * (d - 80) / 365)
            dirt = 0.0 if rng.random() < 0.02 * (1 - season) else min(dirt + rate * (1 + season), 0.3)
            h = np.arange(0, 24, step / 60)
            light = np.where(np.abs(h - 12) < half, np.cos((h - 12) / half * np.pi / 2), 0)
            cloud = 1.0 if rng.random() < 0.5 else rng.uniform(0.3, 1, len(h))
            for t, v in zip(h, 10 * light * cloud * (1 - dirt)):
                yield f"system_{i}", start + timedelta(days=d, hours=float(t)), float(v)


def synthetic(spark: SparkSession, **options) -> DataFrame:
    """Simulated power of some systems."""
    ship(spark)
    spark.dataSource.register(SyntheticSource)
    reader = spark.read.format("sunloom_synthetic")
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load()
