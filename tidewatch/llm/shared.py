"""Helpers of this subpackage: tables, lineage cuts, size-checked broadcasts, evaluated-once columns."""

from __future__ import annotations

import sys
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from types import ModuleType

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.session import checkpoint_dir

#: Most rows of a narrow table (ids, hashes, a few words) that may be broadcast: some tens of MB.
BROADCAST_ROWS = 400_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder, removed when the session's JVM ends."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared folder and read it back: lineage ends, nothing is computed twice."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def maybe_broadcast(small: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Mark a stored narrow table for broadcast if it has few rows; else leave the join to a shuffle.

    The count of a stored table comes from its file footers.
    """
    return F.broadcast(small) if small.count() <= rows else small


def pin(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are evaluated once a row.

    Spark merges neighbouring projections and would evaluate a shared expression again wherever a
    lambda uses it. A generator of one row lies between the projections and keeps them apart.
    """
    values = F.struct(*[c.alias(n) for n, c in columns.items()])
    return df.select("*", F.inline(F.array(values)))


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """What runs inside gives Python workers so many rows at a time; a lazy result does not remember it."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def worker_cache(name: str) -> dict:
    """A dict that lives as long as its Python process.

    Functions travel to workers by value, so each task gets a module of its own with empty globals: what a
    global kept would be built anew in every task, and the old one linger until it is collected.
    """
    module = sys.modules.setdefault("_tidewatch_worker", ModuleType("_tidewatch_worker"))
    return module.__dict__.setdefault(name, {})


def fresh(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Only the given columns, under the operator's own names, so that others cannot clash."""
    return df.select(*[F.col(f"`{c}`").alias(n) for n, c in columns.items()])


ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_lower(text: Column) -> Column:
    """Lower-case A to Z and nothing else."""
    plain = F.octet_length(text) == F.length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, ASCII_UPPER, ASCII_UPPER.lower()))
