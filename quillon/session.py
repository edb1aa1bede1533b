"""Session, table and scratch-folder helpers shared by every operator."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_own: list[str] = []


def local_session(cores: str | int = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("quillon")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.sql.warehouse.dir", os.path.join(tempfile.gettempdir(), "quillon-warehouse"))
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table, read by Spark only, so any store that Spark reads will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _is_local(master: str) -> bool:
    return master == "local" or master.startswith("local[")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir. Where that is unset: in local mode, as in tests, a temporary folder that goes with the process; on a
    cluster a folder of the warehouse, and an error where that is a machine's own disk too."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and _is_local(spark.sparkContext.master):
        if not _own:
            folder = tempfile.mkdtemp(prefix="quillon-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
            _own.append("file://" + folder)
        shared = _own[0]
    if not shared:
        warehouse = spark.conf.get("spark.sql.warehouse.dir", "")
        if not warehouse or warehouse.startswith(("file:", "/")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        shared = f"{warehouse.rstrip('/')}/scratch"
    return f"{shared.rstrip('/')}/quillon/{spark.sparkContext.applicationId}"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether Spark's own file systems have this path."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


#: Lets Spark delete the shuffle files of a write when it is done.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back: cuts the lineage and survives lost executors.

    What has been written needs its shuffles no more, so their files go with the end of the write."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{uuid.uuid4().hex}-{name}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def discard(*frames: DataFrame) -> None:
    """Delete what ``materialise`` has written for these frames, which no later plan may read."""
    for df in frames:
        _delete(df.sparkSession, df._scratch_path)


def clear_scratch(spark: SparkSession) -> None:
    """Delete what this application has written to the scratch folder; call it when its results are stored."""
    _delete(spark, scratch_dir(spark))
