"""Event topics: envelopes in and out, dead letters, and their replay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.functions import keys

# Envelope members.
ENVELOPE = T.StructType(
    [
        T.StructField("event_id", T.StringType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("schema_version", T.IntegerType()),
        T.StructField("occurred_at", T.TimestampType()),
        T.StructField("institution_id", T.StringType()),
        T.StructField("producer", T.StringType()),
        T.StructField("payload", T.StringType()),
        T.StructField("_corrupt", T.StringType()),
    ]
)
MAX_BYTES = 1_048_576


def read_topic(spark: SparkSession, topic: str, servers: str, **options: str) -> DataFrame:
    """Raw records of a topic as a stream of (key, value)."""
    reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers)
    for name, value in options.items():
        reader = reader.option(name, value)
    raw = reader.option("subscribe", topic).load()
    return raw.select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"))


def read_files(spark: SparkSession, path: str, max_files: int = 100) -> DataFrame:
    """The same from a folder of text files, one record per line."""
    return (
        spark.readStream.option("maxFilesPerTrigger", max_files).text(path)
        .select(F.lit(None).cast("string").alias("key"), "value")
    )


def envelopes(raw: DataFrame, event_type: str, version: int, payload: T.StructType) -> DataFrame:
    """Parsed envelopes with ``reason`` NULL when sound, else why the record cannot be used."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    parsed = raw.withColumn("e", F.from_json("value", ENVELOPE, options))
    marked = T.StructType([*payload.fields, T.StructField("_corrupt", T.StringType())])
    parsed = parsed.withColumn("b", F.from_json("e.payload", marked, options))
    e, body = F.col("e"), F.col("b")
    reason = (
        F.when(F.octet_length("value") > MAX_BYTES, "too_large")
        .when(e.isNull() | e["_corrupt"].isNotNull() | e["event_id"].isNull(), "malformed")
        .when(~e["event_id"].rlike(keys.UUID), "malformed")
        .when(~e["event_type"].eqNullSafe(event_type), "wrong_type")
        .when(~e["schema_version"].eqNullSafe(version), "wrong_version")
        .when(body.isNull() | body["_corrupt"].isNotNull(), "malformed")
    )
    return parsed.withColumn("reason", reason).select(
        "key", "value", "reason", "e.event_id", "e.event_type", "e.occurred_at", "e.institution_id",
        F.when(reason.isNull(), F.struct(*[body[f.name].alias(f.name) for f in payload.fields])).alias("payload"),
    )


def sound(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.col("reason").isNull()).drop("reason", "value")


def dead_letters(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.col("reason").isNotNull()).select("event_id", "key", "value", "reason")


def to_envelope(
    rows: DataFrame, event_type: str, key: Column, event_id: Column, occurred_us: Column,
    institution: Column, payload: list[str], version: int = 1, producer: str = "tidewatch",
) -> DataFrame:
    """(key, value) records of one event type; the key keeps an entity's events in order."""
    value = F.to_json(
        F.struct(
            event_id.alias("event_id"), F.lit(event_type).alias("event_type"),
            F.lit(version).alias("schema_version"),
            F.date_format(F.timestamp_micros(occurred_us), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("occurred_at"),
            institution.alias("institution_id"), F.lit(producer).alias("producer"),
            F.to_json(F.struct(*payload)).alias("payload"),
        )
    )
    return rows.select(key.cast("string").alias("key"), value.alias("value"))


def write_topic(records: DataFrame, topic: str, servers: str, checkpoint: str):
    """Starts a query that appends (key, value) records to a topic."""
    return (
        records.writeStream.format("kafka").option("kafka.bootstrap.servers", servers)
        .option("topic", topic).option("checkpointLocation", checkpoint).start()
    )


def replay(letters: DataFrame, reasons: list[str]) -> DataFrame:
    """The newest copy of each dead letter with a chosen reason, and how many older ones it had.

    ``letters``: event_id, value, reason, dead_at. Letters without an id cannot be replayed.
    """
    newest = F.max(F.struct("dead_at", "value", "reason"))
    grouped = letters.filter(F.col("event_id").isNotNull()).groupBy("event_id").agg(
        newest.alias("__n"), (F.count("*") - 1).alias("older_copies")
    )
    return grouped.select("event_id", "__n.value", "__n.reason", "older_copies").filter(
        F.col("reason").isin(reasons)
    )


def replay_counts(letters: DataFrame, reasons: list[str]) -> DataFrame:
    """One row: replayed, older copies left behind, skipped for their reason or missing id."""
    newest = F.max_by("reason", "dead_at")
    grouped = letters.groupBy("event_id").agg(newest.alias("reason"), F.count("*").alias("copies"))
    chosen = F.col("event_id").isNotNull() & F.col("reason").isin(reasons)
    return grouped.agg(
        F.sum(chosen.cast("long")).alias("replayed"),
        F.coalesce(F.sum(F.when(chosen, F.col("copies") - 1)), F.lit(0)).alias("older_copies"),
        F.coalesce(F.sum(F.when(~chosen, F.col("copies"))), F.lit(0)).alias("skipped"),
    )
