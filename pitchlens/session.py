"""Spark session helpers.

The library never owns the cluster configuration: functions take the
session they are given. ``local_session`` is only a convenience for tests,
benchmarks and the command line.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

# Settings that every job in this package relies on. They are applied to a
# session only where the session does not set them already.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def _driver_memory() -> str:
    """About 60 % of the machine's memory, capped at 16 GB (local mode: the driver is the executor)."""
    try:
        with open("/proc/meminfo") as fh:
            kb = next(int(line.split()[1]) for line in fh if line.startswith("MemTotal:"))
        mb = int(kb / 1024 * 0.6)
    except (OSError, StopIteration, ValueError):
        mb = 4096
    return f"{max(1024, min(mb, 16384))}m"


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "pitchlens",
                  extra: dict | None = None) -> SparkSession:
    """Session for tests and local benchmarks (UI off, UTC, AQE on)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", os.environ.get("PITCHLENS_DRIVER_MEMORY", _driver_memory()))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for k, v in {**DEFAULT_CONF, **(extra or {})}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster this setting names a shared (distributed) folder and is
    used as is; without it a ``ValueError`` is raised, as a machine-local
    folder would lose what other executors write. Only a local session
    (tests, one machine) gets a fresh folder under the system temp directory.
    """
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if conf_dir:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(conf_dir)
        return conf_dir
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    local_dir = tempfile.mkdtemp(prefix="pitchlens-ckpt-")
    spark.conf.set("spark.checkpoint.dir", local_dir)
    spark.sparkContext.setCheckpointDir(local_dir)
    return local_dir


def cut(df: DataFrame) -> DataFrame:
    """Write a table that is read many times once: an eager checkpoint in the shared folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def shared_path(spark: SparkSession, name: str) -> str:
    """A path for a materialised table inside the shared checkpoint folder."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, name)
