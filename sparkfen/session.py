"""Spark session and shared-storage helpers."""

from __future__ import annotations

import gc
import os
import sys
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "sparkfen", cpus: int | str = 8, **conf: str) -> SparkSession:
    """A local session with the settings that the tests and the bench use.

    On a cluster the session comes from the launcher; nothing in the engine changes its settings.
    """
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir.

    Only where that is unset (tests, notebooks on one machine) a local folder is made and set for checkpoints.
    """
    context = spark.sparkContext
    path = context.getConf().get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not path:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="sparkfen-")
        context.setCheckpointDir(path)
    elif not context.getCheckpointDir():
        context.setCheckpointDir(path)
    return context.getCheckpointDir() or path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder that scratch_path() named, with its files, in whatever store it is."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def cut(df: DataFrame) -> DataFrame:
    """The frame written to the shared folder and read again, so that its lineage ends there.

    Nothing reads the shuffle files before it any more. Spark deletes them when the driver's collector finds their plans
    unused, which it seldom runs for; so long jobs would fill the disks. Hence release().

    A written frame keeps the planner's estimate of its size, a product over joins; in loops that number itself would grow from
    round to round, to millions of digits. So it is dropped once it is long.
    """
    shared_dir(df.sparkSession)
    out = df.checkpoint(eager=True)
    if size_bits(out) > MOST_BITS:
        spark = df.sparkSession
        out = DataFrame(spark._jsparkSession.createDataFrame(out._jdf.javaRDD(), out._jdf.schema()), spark)
    del df
    release(out.sparkSession)
    return out


#: Length of an estimated size, in bits, beyond which it is dropped.
MOST_BITS = 1024


def size_bits(df: DataFrame) -> int:
    """The length in bits of the planner's estimate of a frame's size."""
    try:
        return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()).bit_length()
    except ValueError:  # more digits than Python reads into a number
        return 4 * sys.get_int_max_str_digits()


#: Seconds between two collections that release() asks for, and the time of the last.
RELEASE_EVERY = 4.0
_RELEASED = [0.0]


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle and checkpoint files that no frame refers to, if that was not done lately."""
    if time.monotonic() - _RELEASED[0] >= RELEASE_EVERY:
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        _RELEASED[0] = time.monotonic()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables of a folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """The frame, dealt out evenly if it has fewer partitions than the cluster has cores (a file of one row group is one task).

    Meant for scans before costly work on each row. Where there are partitions enough, as in any large input, nothing is shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def repo_root() -> str:
    """The folder that holds the package."""
    return os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
