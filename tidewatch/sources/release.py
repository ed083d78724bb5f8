"""Release export with reconciliation, checksums, feature cache, reports and table sinks."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.operators.quality import digest_of


class ReleaseError(ValueError):
    """The release would not be what it claims."""


def export_release(
    tables: dict[str, DataFrame], out: str, report_fingerprints: dict[str, str] | None = None,
    fingerprints: dict[str, str] | None = None,
) -> DataFrame:
    """Writes every table as Parquet and CSV, reads both back, and returns the manifest.

    Refused when a bundled report was made from other data, or when a count differs.
    """
    if report_fingerprints is not None and report_fingerprints != fingerprints:
        raise ReleaseError("the bundled report describes other data")
    spark = next(iter(tables.values())).sparkSession
    manifest = None
    for name, df in sorted(tables.items()):
        df.write.mode("errorifexists").parquet(f"{out}/parquet/{name}")
        stored = spark.read.parquet(f"{out}/parquet/{name}")
        stored.write.mode("errorifexists").option("header", True).csv(f"{out}/csv/{name}")
        text = spark.read.schema(stored.schema).option("header", True).csv(f"{out}/csv/{name}")
        row = None
        for kind, part in (("parquet", stored), ("csv", text), ("source", df)):
            counted = part.agg(F.count("*").alias(f"{kind}_rows")).withColumn("table", F.lit(name))
            row = counted if row is None else row.join(counted, "table")
        manifest = row if manifest is None else manifest.unionByName(row)
    agree = (F.col("parquet_rows") == F.col("source_rows")) & (F.col("csv_rows") == F.col("source_rows"))
    return manifest.select(
        "table", "source_rows", "parquet_rows", "csv_rows",
        F.when(agree, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("row counts differ: "), "table"))).alias("reconciled"),
    )


def checksums(spark: SparkSession, folder: str) -> DataFrame:
    """(file, sha256, length) of every file below a folder, hashed where the files are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    relative = F.regexp_replace("path", "^.*/(?=(parquet|csv)/)", "")
    return files.select(relative.alias("file"), F.sha2("content", 256).alias("sha256"), "length")


def verify(spark: SparkSession, folder: str, recorded: DataFrame) -> DataFrame:
    """Files that are missing, added or changed since the list was made.

    ``recorded`` is a stored list, not a cached or lazy one, which would see the files of today.
    """
    now = checksums(spark, folder).select("file", F.col("sha256").alias("now"))
    was = recorded.select("file", F.col("sha256").alias("was"))
    state = (
        F.when(F.col("now").isNull(), "missing").when(F.col("was").isNull(), "added")
        .when(F.col("now") != F.col("was"), "changed")
    )
    return was.join(now, "file", "full_outer").select("file", state.alias("state")).filter("state is not null")


def feature_cache(spark: SparkSession, path: str, key: dict, compute) -> DataFrame:
    """The matrix stored under a key, computed and stored when the stored key is another.

    The key names the data set, its scale and the feature list; any difference is a miss.
    """
    digest = digest_of(key)
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/key")
    known = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)
    stored = spark.read.schema("digest string, key string").json(f"{path}/key").first() if known else None
    if stored is None or stored["digest"] != digest:
        compute().write.mode("overwrite").parquet(f"{path}/matrix")
        spark.createDataFrame([(digest, json.dumps(key, sort_keys=True))], "digest string, key string").write.mode(
            "overwrite"
        ).json(f"{path}/key")
    return spark.read.parquet(f"{path}/matrix")


def write_report(metrics: DataFrame, path: str) -> None:
    """Long-form metrics (metric, value, ...) as JSON lines."""
    metrics.write.mode("overwrite").json(path)


def new_facts(batch: DataFrame, existing: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows of a batch whose key is not stored yet; within the batch the first in order wins."""
    rest = [c for c in batch.columns if c not in keys]
    first = F.min(F.struct(*order, *[c for c in rest if c not in order])).alias("__f")
    unique = batch.groupBy(*keys).agg(first).select(*keys, *[F.col(f"__f.{c}").alias(c) for c in rest])
    return unique.join(existing.select(*keys), keys, "left_anti").select(*batch.columns)


def upsert_profiles(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """Profiles after a batch: first_seen only moves earlier, opened_at is set once.

    Two different opening dates for an account are an error and never a choice.
    """
    both = stored.unionByName(batch)
    merged = both.groupBy("account").agg(
        F.min("first_seen").alias("first_seen"), F.min("opened_at").alias("__lo"), F.max("opened_at").alias("__hi")
    )
    clash = F.raise_error(F.concat(F.lit("two opening dates for account "), F.col("account").cast("string")))
    return merged.select(
        "account", "first_seen", F.when(F.col("__lo") != F.col("__hi"), clash).otherwise(F.col("__lo")).alias("opened_at")
    )


