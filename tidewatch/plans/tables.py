"""Canonical shapes of the engine, mapped from the star-schema and event tables.

``payments`` is the transaction history: one row per event, microsecond clock ``t``. The other
views are the reference data a feature reads as of the payment: tiers, SIM swaps, agent standing,
limits, exchange rates and profiles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions.geo import geo_cell
from tidewatch.session import prepare

#: 2024-01-01T00:00:00Z, where the event stream begins.
EPOCH = 1_704_067_200_000_000
SECOND = 1_000_000
HOUR = 3_600 * SECOND
DAY = 24 * HOUR

CHANNEL_OF = {
    "view": "MOBILE_MONEY",
    "signup": "USSD",
    "purchase": "AGENT_BANKING",
    "error": "CARD",
    "click": "ONLINE",
}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def _channel(event_type: Column) -> Column:
    out = F.lit(None).cast("string")
    for raw, channel in CHANNEL_OF.items():
        out = F.when(event_type == raw, channel).otherwise(out)
    return out


def payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The payment history. Every column is a function of its own event row."""
    e = read(spark, sf_dir, "events").select(
        F.col("event_id").alias("tx_id"),
        F.col("user_id").alias("account"),
        F.get_json_object("props", "$.k").cast("long").alias("k"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("t"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.round(F.col("value") * 100).cast("long").alias("cents"),
        F.col("value").cast("decimal(18,4)").alias("amount"),
        _channel(F.col("event_type")).alias("channel"),
    )
    return (
        e.withColumn("counterparty", F.col("k"))
        .withColumn("device", F.when(F.col("channel") != "USSD", F.col("k") % 40))
        .withColumn("agent", F.when(F.col("channel") == "AGENT_BANKING", F.col("k") % 10))
        .withColumn("mcc", F.when(F.col("k") % 2 == 0, "6011").otherwise("4829"))
        .withColumn("lat", F.lit(-2.0) + (F.col("k") - 50).cast("double") / F.lit(100.0))
        .withColumn("lon", F.lit(30.0) + (F.col("account") % 50).cast("double") / F.lit(50.0))
        .withColumn("cell", geo_cell(F.col("lat"), F.col("lon")))
        .withColumn("is_fraud", (F.col("channel") == "CARD") & (F.col("cents") > 5000))
        .withColumn("label_at", F.col("t") + F.col("cents") * F.lit(36_000_000))
        .withColumn(
            "score",
            (
                ((F.col("k") * 37 + F.col("cents")) % 1000) * 6
                + F.when(F.col("channel") == "CARD", 4000).otherwise(0)
            ).cast("double")
            / F.lit(10000.0),
        )
    )


def countries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Country facts: continent, blocs, UTC offset, minor units and denominations."""
    nation = read(spark, sf_dir, "nation")
    key = F.col("n_nationkey").cast("long")
    return nation.select(
        F.col("n_name").alias("country"),
        key.alias("country_key"),
        F.col("n_regionkey").cast("string").alias("continent"),
        F.array(F.concat(F.lit("B"), (key % 3).cast("string"))).alias("blocs"),
        (key % 5 - 2).cast("int").alias("utc_offset_hours"),
        F.concat(F.lit("C"), key.cast("string")).alias("currency"),
        F.lit(2).alias("minor_units"),
        F.array((key % 4 + 1) * 50, (key % 3 + 1) * 500, F.lit(0).cast("long")).alias(
            "denominations"
        ),
    )


def with_countries(p: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adds the sender's country (its customer's nation) and the recipient's (a supplier's)."""
    facts = countries(spark, sf_dir).select("country", "country_key", "currency", "utc_offset_hours")
    sender = (
        read(spark, sf_dir, "customer")
        .select(F.col("c_custkey").alias("account"), F.col("c_nationkey").cast("long").alias("nk"))
        .join(facts.withColumnRenamed("country_key", "nk"), "nk")
        .drop("nk")
    )
    suppliers = read(spark, sf_dir, "supplier")
    recipient = (
        suppliers.select(F.col("s_suppkey").alias("sk"), F.col("s_nationkey").cast("long").alias("nk"))
        .join(
            facts.select(
                F.col("country_key").alias("nk"), F.col("country").alias("counterparty_country")
            ),
            "nk",
        )
        .drop("nk")
    )
    return (
        p.withColumn("sk", F.col("k") % suppliers.count())  # the count stands in the file footers
        .join(recipient, "sk", "left")
        .drop("sk")
        .join(sender, "account", "left")
    )


def tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """KYC tier versions per account."""
    return _scattered(read(spark, sf_dir, "orders"), 7919).select(
        F.col("o_custkey").alias("account"),
        F.col("at").alias("effective_at"),
        F.col("o_orderkey").alias("version"),
        (F.col("o_orderkey") % 3 + 1).cast("int").alias("tier"),
    )


def sim_swaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SIM-swap events per account."""
    return (
        _scattered(read(spark, sf_dir, "orders"), 104_729)
        .filter(F.col("o_orderstatus") == "F")
        .select(F.col("o_custkey").alias("account"), F.col("at").alias("swapped_at"))
    )


def _scattered(orders: DataFrame, step: int) -> DataFrame:
    at = F.lit(EPOCH) + (F.col("o_orderkey") * step) % F.lit(30 * 86_400) * F.lit(SECOND)
    return orders.withColumn("at", at)


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Opening dates; unknown for every seventh account."""
    c = F.col("c_custkey")
    return read(spark, sf_dir, "customer").select(
        c.alias("account"),
        F.when(c % 7 != 0, F.lit(EPOCH) - (c % 60) * F.lit(DAY)).alias("opened_at"),
    )


def standings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions of an agent's float balance, limit and premises."""
    s = F.col("s_suppkey")
    return read(spark, sf_dir, "supplier").select(
        (s % 10).alias("agent"),
        (F.lit(EPOCH) + (s * 8_191) % F.lit(720) * F.lit(HOUR)).alias("effective_at"),
        s.alias("version"),
        F.round(F.col("s_acctbal") * 100).cast("long").alias("balance_cents"),
        F.lit(1_000_000).cast("long").alias("limit_cents"),
        (F.lit(-2.0) + (s % 10).cast("double") / F.lit(20.0)).alias("home_lat"),
        (F.lit(30.0) + (s % 7).cast("double") / F.lit(10.0)).alias("home_lon"),
    )


def limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Channel limits: three times last week's mean amount, in force from the next week on."""
    week = F.floor((F.col("t") - F.lit(EPOCH)) / F.lit(7 * DAY)).cast("long")
    return (
        payments(spark, sf_dir)
        .groupBy("channel", week.alias("week"))
        .agg(F.sum("cents").alias("s"), F.count("*").alias("n"))
        .select(
            F.col("channel"),
            (F.lit(EPOCH) + (F.col("week") + 1) * F.lit(7 * DAY)).alias("effective_at"),
            F.expr("(s * 3) div n").alias("limit_cents"),
        )
    )


def fx_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily rates per currency with corrections: the latest recorded row of a date wins."""
    o = F.col("o_orderkey")
    return read(spark, sf_dir, "orders").select(
        F.concat(F.lit("C"), (o % 25).cast("string")).alias("currency"),
        (F.lit(EPOCH) + (o * 13) % F.lit(30) * F.lit(DAY)).alias("rate_date"),
        o.alias("recorded_at"),
        (F.lit(1_000) + o % F.lit(977)).cast("long").alias("rate_thousandths"),
    )


def payments_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long-window history with whole-day clocks, hence many exact ties."""
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    lines = read(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_extendedprice"
    )
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("tx_id"),
        F.col("o_custkey").alias("account"),
        F.col("l_suppkey").alias("counterparty"),
        F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("t"),
        F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents"),
    )
