"""Session settings the library relies on."""

from __future__ import annotations

import os
import re
import uuid

from pyspark.sql import DataFrame, SparkSession


def build(app: str = "tidewatch", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings every operator assumes: UTC, AQE and skew-join splitting."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.serializer", "org.apache.spark.serializer.KryoSerializer")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def prepare(spark: SparkSession) -> SparkSession:
    """Pin what results depend on; called by every query entry."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names, else one below the warehouse.

    The warehouse is a shared place on a cluster; a local one is taken only if all executors are
    threads of this process, since others would write to disks of their own.
    """
    path = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if path is None:
        path = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
        remote = "://" in path and not path.startswith("file:")
        if not remote and not re.fullmatch(r"local(\[[^-]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path)
    return path


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new folder in the shared place, removed when the session's JVM ends."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the lineage ends in the shared folder, so lost executors cost nothing."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows written once to the shared folder and read back: each later pass reads only the columns it needs."""
    path = f"{scratch_dir(df.sparkSession, name)}/rows"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


#: Rows that one task of a chain of sorts and windows over wide rows should hold: every sort holds all of them.
ROWS_A_TASK = 100_000


def tasks_for(spark: SparkSession, rows: int) -> int | None:
    """Tasks that keep ROWS_A_TASK rows each; None while Spark's own number will do."""
    if rows <= ROWS_A_TASK * spark.sparkContext.defaultParallelism:
        return None
    return -(-rows // ROWS_A_TASK)


def dealt(df: DataFrame, key: str, rows: int) -> DataFrame:
    """Laid out by ``key`` in tasks that stay at ROWS_A_TASK rows as the input grows.

    Left to itself a shuffle has about as many tasks as there are cores until one holds 64 MB of compressed rows.
    """
    tasks = tasks_for(df.sparkSession, rows)
    return df.repartition(tasks, key) if tasks else df


def shuffle_partitions(default: int = 8) -> str:
    return str(os.environ.get("BENCH_CPUS", default))
