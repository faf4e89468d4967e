"""Session helpers shared by the operators, the tests and the bench."""

from __future__ import annotations

import os
import platform
import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str | int = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with the settings the operators expect (UTC, AQE, Arrow)."""
    # One thread for each task's linear algebra: the tasks already use all cores.
    os.environ.setdefault("OMP_NUM_THREADS", "1")
    os.environ.setdefault("OPENBLAS_NUM_THREADS", "1")
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("sunloom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


#: Named ways to get a session: functions of settings.
CLIENTS: dict[str, Callable[..., SparkSession]] = {"local": local_session}


def client(name: str):
    """Register a way to get a session, as of a cluster, by name."""

    def add(f: Callable[..., SparkSession]) -> Callable[..., SparkSession]:
        CLIENTS[name] = f
        return f

    return add


@client("cluster")
def cluster_session(master: str, checkpoint: str, **settings: str) -> SparkSession:
    """A session on a cluster; ``checkpoint`` is a folder that all executors share."""
    builder = SparkSession.builder.master(master).appName("sunloom").config("spark.checkpoint.dir", checkpoint).config("spark.sql.session.timeZone", "UTC")
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def versions() -> dict[str, str]:
    """Versions that results depend on, to be kept with them."""
    import numpy
    import pandas
    import pyarrow
    import pyspark

    return {m.__name__: m.__version__ for m in (numpy, pandas, pyarrow, pyspark)} | {"python": platform.python_version()}


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session; in local mode, where none is set (tests), one of this machine."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if named is None:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = os.path.join(tempfile.gettempdir(), "sunloom-checkpoint")
    sc.setCheckpointDir(named)
    return named


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it from there.

    A lost executor then costs no recomputation of what came before.  The data
    are written once, by the eager checkpoint.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Table ``name`` of a folder of Parquet tables."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers of the session, once, so that they need not have it installed."""
    sc = spark.sparkContext
    if getattr(sc, "_sunloom_shipped", False):
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="sunloom-ship-")
    name = os.path.join(folder, "sunloom_package.zip")
    with zipfile.ZipFile(name, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(name)
    sc._sunloom_shipped = True


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` by key over as many tasks as the session's shuffles have, however few bytes it holds.

    For kernels that take long for each small group: sized by bytes, all of them would be one task.
    """
    ship(df.sparkSession)
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
