"""Reading the payment history: explicit columns, local-month partitions, newest rows, packs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.session import prepare

#: The stored transaction schema, fixed and never inferred.
TRANSACTIONS = T.StructType(
    [
        T.StructField("transaction_id", T.StringType(), False),
        T.StructField("account_id", T.StringType(), False),
        T.StructField("counterparty_id", T.StringType(), False),
        T.StructField("amount", T.DecimalType(18, 4), False),
        T.StructField("currency", T.StringType(), False),
        T.StructField("amount_rwf", T.DecimalType(18, 4), False),
        T.StructField("channel", T.StringType(), False),
        T.StructField("merchant_category_code", T.StringType(), False),
        T.StructField("latitude", T.DoubleType(), False),
        T.StructField("longitude", T.DoubleType(), False),
        T.StructField("device_fingerprint", T.StringType(), True),
        T.StructField("agent_id", T.StringType(), True),
        T.StructField("counterparty_country", T.StringType(), False),
        T.StructField("transaction_timestamp", T.TimestampType(), False),
    ]
)
LABELS = T.StructType(
    [
        T.StructField("transaction_id", T.StringType(), False),
        T.StructField("is_fraud_observed", T.BooleanType(), False),
        T.StructField("is_fraud_true", T.BooleanType(), False),
        T.StructField("fraud_type", T.StringType(), True),
        T.StructField("scenario_variant", T.StringType(), True),
        T.StructField("label_available_at", T.TimestampType(), False),
    ]
)
ACCOUNT_EVENTS = T.StructType(
    [
        T.StructField("account_id", T.StringType(), False),
        T.StructField("event_type", T.StringType(), False),
        T.StructField("event_timestamp", T.TimestampType(), False),
    ]
)
_MONTH = T.StructField("month", T.StringType(), False)


def read_table(
    spark: SparkSession, path: str, schema: T.StructType, columns: list[str] | None = None
) -> DataFrame:
    """Month-partitioned Parquet with a declared schema; only the named columns are read."""
    df = prepare(spark).read.schema(T.StructType([*schema.fields, _MONTH])).parquet(path)
    return df.select(*columns) if columns else df


def canonical(transactions: DataFrame) -> DataFrame:
    """Stored transactions under the engine's column names."""
    return transactions.select(
        F.col("transaction_id").alias("tx_id"), F.col("account_id").alias("account"),
        F.col("counterparty_id").alias("counterparty"), F.unix_micros("transaction_timestamp").alias("t"),
        F.col("amount_rwf").alias("amount"), "currency", "channel",
        F.col("merchant_category_code").alias("mcc"), F.col("latitude").alias("lat"),
        F.col("longitude").alias("lon"), F.col("device_fingerprint").alias("device"),
        F.col("agent_id").alias("agent"), "counterparty_country",
    )


def scan_utc_month(df: DataFrame, month: str, at: str, west: bool = False) -> DataFrame:
    """Rows of a UTC month when partitions are named by local month.

    East of Greenwich the last hours of a UTC month are filed under the next local month, so the
    partition filter takes both and the clock decides; ``west`` adds the month before. Both
    filters are pushed down: the first prunes directories, the second row groups.
    """
    first = F.to_date(F.lit(f"{month}-01"))
    named = [F.date_format(F.add_months(first, k), "yyyy-MM") for k in range(-1 if west else 0, 2)]
    lo, hi = (F.unix_micros(F.add_months(first, k).cast("timestamp")) for k in (0, 1))
    return df.filter(F.col("month").isin(named) & (F.col(at) >= lo) & (F.col(at) < hi))


def tail(df: DataFrame, n: int) -> DataFrame:
    """The newest ``n`` rows by (t, id): each partition keeps its own top, then those are merged."""
    return df.orderBy(F.desc("t"), F.desc("tx_id")).limit(n)


def labels_of(labels: DataFrame, corpus: DataFrame, key: str = "transaction_id") -> DataFrame:
    return labels.join(corpus.select(key), key, "left_semi")


def events_of(events: DataFrame, kind: str) -> DataFrame:
    return events.filter(F.col("event_type") == kind)


PACK = T.StructType(
    [
        T.StructField("alpha2", T.StringType()),
        T.StructField("continent", T.StringType()),
        T.StructField("blocs", T.ArrayType(T.StringType())),
        T.StructField("utc_offset_hours", T.IntegerType()),
        T.StructField("currency", T.StringType()),
        T.StructField("currency_minor_units", T.IntegerType()),
        T.StructField("round_denominations", T.ArrayType(T.LongType())),
    ]
)


def load_packs(spark: SparkSession, path: str, one_per_line: bool = False) -> DataFrame:
    """Country packs from JSON, a file each or a line each; two that share a currency are an error, not a choice."""
    packs = spark.read.schema(PACK).option("multiLine", not one_per_line).json(path)
    sharing = F.count("*").over(Window.partitionBy("currency"))
    conflict = F.raise_error(F.concat(F.lit("packs share the currency "), F.col("currency")))
    return packs.withColumn("__n", sharing).withColumn(
        "currency", F.when(F.col("__n") > 1, conflict).otherwise(F.col("currency"))
    ).drop("__n")


def profile(df: DataFrame) -> DataFrame:
    """Rows, distinct accounts and the mean amount of each month partition."""
    return df.groupBy("month").agg(
        F.count("*").alias("rows"), F.count_distinct("account_id").alias("accounts"),
        F.avg("amount_rwf").alias("mean_amount"),
    )


def write_month(df: DataFrame, path: str, at: str = "transaction_timestamp") -> None:
    """Append to month partitions; each task writes its own files."""
    df.withColumn("month", F.date_format(at, "yyyy-MM")).write.partitionBy("month").mode("append").parquet(path)
