"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pitchlens.session import ensure_checkpoint_dir

MASK64 = (1 << 64) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage: an eager checkpoint in the shared folder of ``spark.checkpoint.dir``."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def fresh(df: DataFrame, *stems: str) -> list[str]:
    """Column names that start with the stems and clash with no column of df."""
    taken = {c.lower() for c in df.columns}
    out = []
    for s in stems:
        while s.lower() in taken:
            s += "_"
        taken.add(s.lower())
        out.append(s)
    return out


def id_mod(col: str | Column, n: int) -> Column:
    """crc32 of the id's decimal text, modulo n (NULL for a NULL id)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.crc32(c.cast("string").cast("binary")) % n


#: Partial results that one merge task reads.
FAN_IN = 64


def tree_merge(parts: DataFrame, keys: list[str], merge: Callable, schema: str) -> DataFrame:
    """Merge the partial results of all partitions per key, FAN_IN partitions at a time, until one row per key is left.

    ``merge`` takes the rows of a group (pandas) and returns one in the same form; it may also see partial
    merges. What a task holds does not grow with the number of partitions.
    """
    left = parts.rdd.getNumPartitions()
    parts = parts.withColumn("lane", F.spark_partition_id())
    while True:
        parts = parts.withColumn("lane", F.floor(F.col("lane") / FAN_IN).cast("int"))
        parts = parts.groupBy(*keys, "lane").applyInPandas(merge, f"{schema}, lane int")
        left = -(-left // FAN_IN)
        if left <= 1:
            return parts.drop("lane")


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64 on an array of uint64 (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
