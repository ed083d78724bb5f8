"""Streams: ingest with dead letters, windowed totals, parent waits, table sinks, feature batches.

Watermarks are a choice made here: ten minutes for payments, whose clock may run five minutes
ahead. Label streams go to a table without one, since a label may come weeks late.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tidewatch.sources import requests, topics
from tidewatch.sources.release import new_facts, upsert_profiles

WATERMARK = "10 minutes"
DAY = 86_400_000_000

PAYMENT = T.StructType(
    [
        T.StructField("tx_id", T.LongType()),
        T.StructField("account", T.LongType()),
        T.StructField("counterparty", T.LongType()),
        T.StructField("t", T.LongType()),
        T.StructField("amount", T.DecimalType(18, 4)),
        T.StructField("channel", T.StringType()),
        T.StructField("mcc", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("is_fraud", T.BooleanType()),
    ]
)


def payment_stream(spark: SparkSession, path: str, files: int = 100) -> DataFrame:
    """Payments arriving as Parquet files, with an event-time column ``ts``."""
    rows = spark.readStream.schema(PAYMENT).option("maxFilesPerTrigger", files).parquet(path)
    return rows.withColumn("ts", F.timestamp_micros("t"))


def run_available(
    stream: DataFrame, batch: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append"
) -> StreamingQuery:
    """Processes everything that has arrived, in micro-batches, and stops."""
    return (
        stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).foreachBatch(batch).start()
    )


def batch_name(spark: SparkSession, number: int) -> str:
    """A micro-batch's name: its stream's id, which lives as long as its checkpoint, and its number.

    A repeated batch has the name it had; a stream with a new checkpoint over old data has new names.
    """
    stream = spark.sparkContext.getLocalProperty("sql.streaming.queryId") or "batch"
    return f"{stream}-{number:09d}"


def append_to(path: str, *partitions: str) -> Callable[[DataFrame, int], None]:
    """A batch writer into one folder per micro-batch: a repeated batch replaces itself."""

    def write(df: DataFrame, number: int) -> None:
        target = f"{path}/batch={batch_name(df.sparkSession, number)}"
        df.write.mode("overwrite").partitionBy(*partitions).parquet(target)

    return write


def exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def stored(spark: SparkSession, path: str, schema: T.StructType, before: str | None = None, partitions: str = "") -> DataFrame:
    """What the batches have written so far; empty before the first.

    ``before`` names a batch whose own earlier attempt is left out. ``partitions``: the columns and
    types that append_to laid out as folders, which stay in the result.
    """
    folders = T.StructType.fromDDL(partitions).fields if partitions else []
    kept = [f.name for f in [*schema.fields, *folders]]
    whole = T.StructType([*schema.fields, T.StructField("batch", T.StringType()), *folders])
    if not exists(spark, path):
        return spark.createDataFrame([], whole).select(*kept)
    rows = spark.read.schema(whole).parquet(path)
    return (rows if before is None else rows.filter(F.col("batch") != before)).select(*kept)


# ---- windowed totals ------------------------------------------------------------------------------------


def tumbling(stream: DataFrame, keys: list[str], size: str, watermark: str = WATERMARK) -> DataFrame:
    """Count and sum per key and tumbling window, emitted once the watermark passes it."""
    return (
        stream.withWatermark("ts", watermark).groupBy(*keys, F.window("ts", size).alias("w"))
        .agg(F.count("*").alias("n"), F.sum("amount").alias("total"))
        .select(*keys, F.unix_micros("w.start").alias("bucket"), "n", "total")
    )


def sliding_fraud(stream: DataFrame, keys: list[str], size: str = "15 minutes", step: str = "1 minute") -> DataFrame:
    """Payments and fraud over the last ``size``, every ``step``; fraud never exceeds payments."""
    counted = (
        stream.withWatermark("ts", WATERMARK).groupBy(*keys, F.window("ts", size, step).alias("w"))
        .agg(F.count("*").alias("n"), F.sum(F.col("is_fraud").cast("long")).alias("fraud"))
    )
    return counted.select(
        *keys, F.unix_micros("w.end").alias("until"), "n", F.least("fraud", "n").alias("fraud")
    )


# ---- ingest ------------------------------------------------------------------------------------------------


def first_copies(events: DataFrame, key: str = "event_id", watermark: str = WATERMARK) -> DataFrame:
    """The first copy of each event; state is dropped behind the watermark."""
    return events.withWatermark("ts", watermark).dropDuplicatesWithinWatermark([key])


def ingest_batches(now_us: int, out: str, arrival: str | None = None) -> Callable[[DataFrame, int], None]:
    """Validates raw request bodies and settles replays and conflicts against all earlier batches.

    Three outputs: accepted requests, replays and conflicts, and dead letters with their errors.
    Within a batch the order of the column ``arrival``, such as an offset, decides who was first;
    without one the order in which rows are read.
    """

    schema = T.StructType([T.StructField("tx_id", T.StringType()), T.StructField("fingerprint", T.StringType())])

    def process(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        order = F.col(arrival) if arrival else F.monotonically_increasing_id()
        sent = df.select(F.col("value").alias("body"), "value", order.alias("arrival"))
        checked = requests.validate(sent, F.lit(now_us)).persist()
        try:
            good = checked.filter(F.size("errors") == 0).select(
                F.try_element_at("fields", F.lit("transaction_id")).alias("tx_id"),
                requests.fingerprint().alias("fingerprint"), "arrival",
            )
            earlier = stored(spark, f"{out}/accepted", schema, batch_name(spark, number))
            settled = requests.admissions(good, earlier)
            accepted = settled.filter("outcome = 'accepted'").select("tx_id", "fingerprint").distinct()
            append_to(f"{out}/accepted")(accepted, number)
            append_to(f"{out}/refused")(settled.filter("outcome <> 'accepted'").select("tx_id", "outcome"), number)
            append_to(f"{out}/dead")(
                checked.filter(F.size("errors") > 0).select(
                    "value", F.transform("errors", lambda e: F.concat_ws(":", e["field"], e["code"])).alias("errors")
                ),
                number,
            )
        finally:
            checked.unpersist()

    return process


def route(event_type: str, version: int, payload: T.StructType, out: str):
    """A batch writer that splits a topic into sound events and dead letters."""

    def process(df: DataFrame, number: int) -> None:
        parsed = topics.envelopes(df, event_type, version, payload)
        append_to(f"{out}/events")(topics.sound(parsed), number)
        append_to(f"{out}/dead")(topics.dead_letters(parsed), number)

    return process


# ---- sinks -------------------------------------------------------------------------------------------------


def fact_sink(path: str, keys: list[str], order: list[str], schema: T.StructType):
    """First write wins per key, over all batches: a left-anti join before the append."""

    def process(df: DataFrame, number: int) -> None:
        # A repeated batch must not see its own earlier attempt.
        existing = stored(df.sparkSession, path, schema, batch_name(df.sparkSession, number))
        append_to(path)(new_facts(df.select(*[f.name for f in schema.fields]), existing, keys, order), number)

    return process


PROFILE = T.StructType([T.StructField(c, T.LongType()) for c in ("account", "first_seen", "opened_at")])


def profile_sink(path: str) -> Callable[[DataFrame, int], None]:
    """Each batch appends its own accounts' profiles; what is stored is merged when it is read."""

    def process(df: DataFrame, number: int) -> None:
        rows = df.select(*[f.name for f in PROFILE.fields])
        append_to(path)(upsert_profiles(rows.limit(0), rows), number)

    return process


def profiles(spark: SparkSession, path: str) -> DataFrame:
    """The profile table: the batches of profile_sink, merged."""
    rows = stored(spark, path, PROFILE)
    return upsert_profiles(rows.limit(0), rows)


# ---- parents before children ----------------------------------------------------------------------------------


def with_parent(children: DataFrame, parents: DataFrame, key: str, budget: str = "5 minutes") -> DataFrame:
    """Children joined to a parent that occurs within the budget; NULL parent once it has run out.

    ``children`` and ``parents`` carry ``ts``. Rows without a parent go to the dead letters.
    """
    c = children.withWatermark("ts", WATERMARK).alias("c")
    p = parents.select(F.col(key).alias("p_key"), F.col("ts").alias("p_ts")).withWatermark("p_ts", WATERMARK).alias("p")
    near = F.expr(f"p_ts >= ts - interval {budget} AND p_ts <= ts + interval {budget}")
    return c.join(p, (F.col(f"c.{key}") == F.col("p_key")) & near, "left_outer")


# ---- features on new rows -----------------------------------------------------------------------------------------


def feature_batches(
    features: Callable[[DataFrame], DataFrame], history: str, out: str, schema: T.StructType, horizon_us: int,
    durable: Callable[[DataFrame], DataFrame] | None = None,
):
    """Features of each batch's new rows, from the same builders the batch path uses.

    The history folder holds earlier rows; a batch reads the horizon of it that any window can
    reach, adds its new rows, computes, and keeps the new rows' features. Within the batch rows of
    one instant do not see each other, as everywhere. ``durable`` adds facts that must come from
    all history, such as what an account had ever used.
    """

    day = f"t div {DAY}"

    def process(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        new = df.select(*[f.name for f in schema.fields])
        lowest = new.agg(F.min("t")).first()[0]
        past = stored(spark, history, schema, batch_name(spark, number), "day long")
        if lowest is not None:  # whole days outside the horizon are not read
            past = past.filter((F.col("day") >= (lowest - horizon_us) // DAY) & (F.col("t") > lowest - horizon_us))
        past = past.drop("day").join(new.select("tx_id"), "tx_id", "left_anti").select(*new.columns)
        rows = past.unionByName(new)
        computed = features(rows if durable is None else durable(rows))
        append_to(out)(computed.join(new.select("tx_id"), "tx_id", "left_semi"), number)
        append_to(history, "day")(new.withColumn("day", F.expr(day)), number)

    return process


def missing_feeds(unlabelled: DataFrame, now_us: int, days: int = 21) -> DataFrame:
    """Producers whose payments stay unlabelled past the bound: a missing feed, not a late label."""
    age = F.lit(now_us) - F.col("t")
    bound = days * 86_400_000_000
    return unlabelled.groupBy("producer").agg(
        F.count("*").alias("payments"),
        F.sum((F.col("label_at").isNull() & (age > bound)).cast("long")).alias("overdue"),
        F.max(F.when(F.col("label_at").isNull(), age)).alias("oldest_us"),
    ).withColumn("missing", F.col("overdue") > 0)
