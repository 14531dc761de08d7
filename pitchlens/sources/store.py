"""Materialised datasets and sinks.

``materialize`` is the cache-or-compute step of the feature datasets: if the
table exists it is read, else it is built, written as Parquet and read back.
The write is a lineage cut that survives lost executors (unlike a local
checkpoint): the default location is the shared folder the cluster names in
``spark.checkpoint.dir``.

A dataset is a folder of versions. A version counts once its write is
committed (``_SUCCESS``); readers take the newest one. A refresh writes a new
version and touches no other, so handles on older versions stay readable;
``drop_old_versions`` is the only thing that deletes, and only when called.
"""

from __future__ import annotations

import hashlib
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_path

#: Version of the projections that landed tables hold; raise it when their rows or columns change.
PROJECTION_VERSION = 2


def _fs(spark: SparkSession, path: str):
    hpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hpath


def versions(spark: SparkSession, path: str) -> list[str]:
    """Committed versions of a dataset, oldest first (full paths)."""
    fs, root = _fs(spark, path)
    if not fs.exists(root):
        return []
    names = sorted(st.getPath().getName() for st in fs.listStatus(root) if st.isDirectory())
    done = [f"{path}/{n}" for n in names if n.startswith("v")]
    return [p for p in done if fs.exists(_fs(spark, f"{p}/_SUCCESS")[1])]


def drop_old_versions(spark: SparkSession, path: str) -> int:
    """Delete all committed versions but the newest; the caller knows that nobody reads them."""
    old = versions(spark, path)[:-1]
    for p in old:
        fs, hp = _fs(spark, p)
        fs.delete(hp, True)
    return len(old)


def materialize(spark: SparkSession, name: str, builder: Callable[[], DataFrame], refresh: bool = False,
                path: str | None = None, partition_by: list[str] | None = None) -> DataFrame:
    """Read the newest version of dataset ``name``, or build, write and read one (always with ``refresh``)."""
    path = path or shared_path(spark, name if name.startswith("landed/") else f"datasets/{name}")
    have = versions(spark, path)
    if have and not refresh:
        return spark.read.parquet(have[-1])
    new = f"{path}/v{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    writer = builder().write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(new)
    return spark.read.parquet(new)


def source_key(spark: SparkSession, *paths: str) -> str:
    """Identity of input files as a short hash: every file below each path (or glob) with size and time."""
    h = hashlib.sha1(str(PROJECTION_VERSION).encode())
    for p in paths:
        fs, hp = _fs(spark, p)
        files = []
        for top in fs.globStatus(hp) or []:
            it = fs.listFiles(top.getPath(), True)
            while it.hasNext():
                st = it.next()
                files.append(f"{st.getPath()}|{st.getLen()}|{st.getModificationTime()}")
        h.update("\n".join([p, *sorted(files)]).encode())
    return h.hexdigest()[:16]


_LANDED: dict[tuple, DataFrame] = {}


def land(spark: SparkSession, name: str, builder: Callable[[], DataFrame], sources: list[str]) -> DataFrame:
    """Write a derived table once (keyed by its source files) and scan the Parquet copy.

    The landing step of a feed: later queries get a columnar scan with
    predicate pushdown and column pruning instead of re-deriving the rows.
    The scan DataFrame itself is reused within a session (it is immutable).
    """
    key = source_key(spark, *sources)
    memo = (spark.sparkContext.applicationId, spark.conf.get("spark.checkpoint.dir", ""), name, key)
    if memo not in _LANDED:
        _LANDED[memo] = materialize(spark, f"landed/{name}-{key}", builder)
    return _LANDED[memo]


_FILES = "file string, size long, modified long, version string"


def _listing(spark: SparkSession, sources: list[str]) -> list[tuple[str, int, int]]:
    """(file, size, time) of every file below the paths or globs; hidden and marker files do not count."""
    out = set()
    for p in sources:
        fs, hp = _fs(spark, p)
        for top in fs.globStatus(hp) or []:
            it = fs.listFiles(top.getPath(), True)
            while it.hasNext():
                st = it.next()
                if not st.getPath().getName().startswith(("_", ".")):
                    out.add((st.getPath().toString(), st.getLen(), st.getModificationTime()))
    return sorted(out)


def _plain_path(c):
    """One spelling of a file's path: ``file:/a`` and ``file:///a`` are the same."""
    return F.regexp_replace(c, r"^([a-zA-Z0-9+.\-]+:)/+", "$1/")


def manifest(spark: SparkSession, name: str) -> DataFrame:
    """file, size, modified, version: the files whose rows a dataset of :func:`land_files` holds now."""
    have = versions(spark, shared_path(spark, f"landed/{name}/manifest"))
    return spark.read.schema(_FILES).parquet(have[-1]) if have else spark.createDataFrame([], _FILES)


def land_files(spark: SparkSession, name: str, parse: Callable[[list[str]], DataFrame], sources: list[str]) -> DataFrame:
    """Land a folder of files that grows: only files that are new since the last call are parsed.

    ``parse(paths)`` gives the rows of some files with a column ``source_file``. A manifest tells which
    files (by path, size and time) are landed and in which version of the data; new ones are parsed
    and appended as one version more. A changed file is parsed anew; rows of its old state and of
    files that are gone are left out when reading (their versions stay for readers that have them open).
    Of two calls at the same time the later manifest counts; files it does not name are parsed by the next.
    """
    root = shared_path(spark, f"landed/{name}")
    have = versions(spark, f"{root}/manifest")
    seen = manifest(spark, name)
    listed = spark.createDataFrame(_listing(spark, sources), "file string, size long, modified long")
    state = ["file", "size", "modified"]
    fresh = [r["file"] for r in listed.join(seen, state, "left_anti").select("file").collect()]
    gone = seen.join(listed, state, "left_anti").limit(1).count()
    if fresh or gone or not have:
        version = f"v{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
        kept = seen.join(listed, state, "left_semi")
        if fresh:
            parse(fresh).write.parquet(f"{root}/data/{version}")
        now = kept.unionByName(listed.join(seen, state, "left_anti").withColumn("version", F.lit(version))).select("file", "size", "modified", "version")
        now.coalesce(1).write.parquet(f"{root}/manifest/{version}")
        seen = manifest(spark, name)
    used = [r["version"] for r in seen.select("version").distinct().collect()]
    if not used:
        old = versions(spark, f"{root}/data")
        return spark.read.parquet(old[-1]).limit(0) if old else parse([])
    rows = spark.read.parquet(*[f"{root}/data/{v}" for v in sorted(used)])
    version_of = F.regexp_extract(F.col("_metadata.file_path"), r"/(v\d+-[0-9a-f]+)/[^/]*$", 1)
    written = F.url_decode(F.regexp_replace("source_file", r"\+", "%2B"))      # a row's file is a URI, a listing has plain paths
    landed = rows.select("*", version_of.alias("_version"), _plain_path(written).alias("_file"))
    # Rows of files whose landed state is not the one that counts now.
    live = seen.select(F.col("version").alias("_version"), _plain_path("file").alias("_file"))
    return landed.join(live, ["_version", "_file"], "left_semi").select(*rows.columns)


def write_predictions(df: DataFrame, path: str, header: bool = False) -> None:
    """Prediction sink: ``player, team, y, x`` rows as CSV (y before x, no header)."""
    df.select("player_id", "team_id", "y", "x").write.mode("overwrite").option("header", header).csv(path)


def write_table(df: DataFrame, path: str, mode: str = "overwrite", fmt: str = "parquet", header: bool = True) -> None:
    """Generic sink (Parquet by default; ``fmt="csv"`` writes a header row)."""
    w = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        w = w.option("header", header)
    w.save(path)


def read_csv_table(spark: SparkSession, path: str, schema: str | None = None, index_col: bool = False) -> DataFrame:
    """CSV source with a header; an explicit schema avoids an inference pass.

    ``index_col=True`` drops a leading unnamed index column (files written
    with a row index).
    """
    reader = spark.read.option("header", True)
    reader = reader.schema(schema) if schema else reader.option("inferSchema", True)
    df = reader.csv(path)
    if index_col:
        df = df.drop(df.columns[0])
    return df
