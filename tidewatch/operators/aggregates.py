"""Grouped summaries: durable facts, shares, missingness, record reconciliation, snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import stats
from tidewatch.operators.hotkeys import HOUR, Split
from tidewatch.operators.order import quantiles
from tidewatch.operators.running import Agg, running

SECOND = 1_000_000


def first_seen(history: DataFrame, entities: list[str]) -> DataFrame:
    """(entity, id, first_seen) over the whole history: never over a date-pruned scan."""
    pairs = F.explode(
        F.array(*[F.struct(F.lit(e).alias("entity"), F.col(e).cast("string").alias("id")) for e in entities])
    ).alias("p")
    return (
        history.select("t", pairs)
        .select("t", "p.*")
        .filter(F.col("id").isNotNull())
        .groupBy("entity", "id")
        .agg(F.min("t").alias("first_seen"))
    )


def ever_used(history: DataFrame, before: int, members: list[str]) -> DataFrame:
    """Distinct (account, kind, value) pairs used before a time: joined as rows, never as sets."""
    pairs = F.explode(
        F.array(*[F.struct(F.lit(m).alias("kind"), F.col(m).cast("string").alias("value")) for m in members])
    ).alias("p")
    return (
        history.filter(F.col("t") < before)
        .select("account", pairs)
        .select("account", "p.*")
        .filter(F.col("value").isNotNull())
        .distinct()
    )


def known_before(rows: DataFrame, seen: DataFrame, earlier: DataFrame, kind: str) -> DataFrame:
    """Union of what the corpus shows with what was known before it began."""
    return earlier.filter(F.col("kind") == kind).unionByName(seen.filter(F.col("kind") == kind)).distinct()


def account_summary(history: DataFrame, before: int) -> DataFrame:
    """First and last sighting with place, and how many distinct partners, before a time."""
    rows = history.filter(F.col("t") < before)
    last = F.min(F.struct((-F.col("t")).alias("t"), "tx_id", "lat", "lon"))
    return rows.groupBy("account").agg(
        F.min("t").alias("first_seen"), last.alias("__l"),
        F.count_distinct("counterparty").alias("counterparties"),
        F.count_distinct("device").alias("devices"),
        F.count("*").alias("n"),
    ).select(
        "account", "first_seen", (-F.col("__l.t")).alias("last_seen"),
        F.col("__l.lat").alias("last_lat"), F.col("__l.lon").alias("last_lon"),
        "counterparties", "devices", "n",
    )


def fraud_intervals(rows: DataFrame, period: Column, target: float) -> DataFrame:
    """Fraud rate per period with its Wilson interval, and whether that covers the target."""
    counts = rows.groupBy(period.alias("period")).agg(
        F.count("*").alias("rows"), F.sum(F.col("is_fraud").cast("long")).alias("fraud")
    )
    low, high = stats.wilson(F.col("fraud"), F.col("rows"))
    return counts.select(
        "period", "rows", "fraud", (F.col("fraud") / F.col("rows")).alias("rate"),
        low.alias("ci_lower"), high.alias("ci_upper"), ((low <= target) & (F.lit(target) <= high)).alias("covers"),
    )


def share_deviation(rows: DataFrame, column: str, targets: dict[str, float]) -> DataFrame:
    """Share of each value against its target, in percentage points; absent values count as 0."""
    spark = rows.sparkSession
    wanted = spark.createDataFrame(sorted(targets.items()), f"{column} string, target double")
    counts = rows.groupBy(column).agg(F.count("*").alias("n"))
    k = F.lit(0).alias("__k")
    total = counts.agg(F.sum("n").alias("total")).select("*", k)
    table = F.broadcast(wanted).join(counts, column, "full_outer").select("*", k).join(F.broadcast(total), "__k")
    share = F.coalesce(F.col("n"), F.lit(0)) / F.col("total")
    return table.select(
        column, share.alias("share"), "target",
        (F.abs(share - F.coalesce("target", F.lit(0.0))) * 100).alias("deviation_pp"),
    )


def amount_profile(rows: DataFrame, group: list[str]) -> DataFrame:
    """Count, mean and median amount, and share over the mean, per group."""
    base = rows.groupBy(*group).agg(F.count("*").alias("n"), F.avg("cents").alias("mean"))
    medians = quantiles(rows, "cents", {"median": 0.5}, group)
    return base.join(medians, group)


def compare_profiles(first: DataFrame, second: DataFrame, keys: list[str], measures: list[str]) -> DataFrame:
    """Worst relative change per measure between two profiles of the same groups."""
    a = first.select(*keys, *[F.col(m).alias(f"a_{m}") for m in measures])
    b = second.select(*keys, *[F.col(m).alias(f"b_{m}") for m in measures])
    joined = a.join(b, keys, "full_outer")
    return joined.agg(
        *[
            F.max(F.abs(F.col(f"b_{m}") - F.col(f"a_{m}")) / F.nullif(F.abs(F.col(f"a_{m}").cast("double")), F.lit(0.0))).alias(m)
            for m in measures
        ]
    )


def missingness(matrix: DataFrame, names: list[str]) -> DataFrame:
    """(name, missing_rate, distinct) per column.

    The columns are unpivoted so that the exact distinct counts are one grouped aggregate and not
    one expansion of the rows per column.
    """
    pairs = F.explode(
        F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).cast("string").alias("v")) for n in names])
    ).alias("p")
    cells = matrix.select(pairs).select("p.*").groupBy("name", "v").agg(F.count("*").alias("c"))
    return cells.groupBy("name").agg(
        (F.sum(F.when(F.col("v").isNull(), F.col("c")).otherwise(0)) / F.sum("c")).alias("missing_rate"),
        F.count("v").alias("distinct"),
    )


def null_signatures(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct null patterns per class and channel."""
    return rows.select("is_fraud", "channel", *[F.col(c).isNull().alias(f"{c}_null") for c in columns]).distinct()


def unmatched_signatures(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Null patterns of fraud rows that no legitimate row of the channel has."""
    patterns = null_signatures(rows, columns)
    cols = [c for c in patterns.columns if c != "is_fraud"]
    return patterns.filter("is_fraud").select(*cols).exceptAll(patterns.filter("not is_fraud").select(*cols))


def mean_contributions(explained: DataFrame) -> DataFrame:
    one = explained.select(F.explode("contributions").alias("c"))
    return one.groupBy(F.col("c.feature").alias("feature")).agg(F.avg(F.abs(F.col("c.shap"))).alias("mean_abs"))


def ever_fraud(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value, fraud): whether a token was ever on a fraudulent row."""
    pairs = F.explode(
        F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])
    ).alias("p")
    return (
        rows.select("is_fraud", pairs)
        .select("is_fraud", "p.*")
        .filter(F.col("value").isNotNull())
        .groupBy("column", "value")
        .agg(F.bool_or("is_fraud").alias("fraud"))
    )


def reconcile(records: DataFrame, sent: DataFrame, accepted: DataFrame, valid: Column) -> DataFrame:
    """Class of every record against the ids sent and accepted.

    The first record of an id is accepted, late or foreign; every further one is a duplicate. The
    first is found by an aggregate, so an id repeated without end stays cheap.
    """
    firsts = records.filter(valid).groupBy("id").agg(F.min("offset").alias("__first"))
    known = (
        firsts.join(sent.select("id", F.lit(True).alias("__sent")).distinct(), "id", "left")
        .join(accepted.select("id", F.lit(True).alias("__acc")).distinct(), "id", "left")
    )
    joined = records.withColumn("__ok", valid).join(known, "id", "left")
    kind = (
        F.when(~F.col("__ok"), "unparsed")
        .when(F.col("offset") > F.col("__first"), "duplicate")
        .when(F.col("__acc"), "accepted")
        .when(F.col("__sent"), "late")
        .otherwise("foreign")
    )
    return joined.withColumn("kind", kind).drop("__ok", "__first", "__sent", "__acc")


def without_record(accepted: DataFrame, records: DataFrame, valid: Column) -> DataFrame:
    return accepted.select("id").distinct().join(records.filter(valid).select("id"), "id", "left_anti")


def velocity_snapshot(history: DataFrame, at: int) -> DataFrame:
    """Per account at a time: nested counts and sums, distinct partners, last place and channel."""
    spans = {"60s": 60, "1h": 3_600, "24h": 86_400, "7d": 604_800}
    rows = history.filter((F.col("t") < at) & (F.col("t") > at - spans["7d"] * SECOND))

    def inside(seconds: int) -> Column:
        return F.col("t") > at - seconds * SECOND

    counts = [F.sum(inside(s).cast("long")).alias(f"count_{n}") for n, s in spans.items()]
    last = F.min(F.struct((-F.col("t")).alias("t"), "tx_id", "lat", "lon", "channel"))
    out = rows.groupBy("account").agg(
        *counts,
        F.coalesce(F.sum(F.when(inside(spans["24h"]), F.col("cents"))), F.lit(0)).alias("cents_24h"),
        F.sum("cents").alias("cents_7d"),
        F.count_distinct(F.when(inside(spans["24h"]), F.col("counterparty"))).alias("counterparties_24h"),
        last.alias("__l"),
    )
    nested = (F.col("count_60s") <= F.col("count_1h")) & (F.col("count_1h") <= F.col("count_24h")) & (
        F.col("count_24h") <= F.col("count_7d")
    )
    return out.select(
        *[c for c in out.columns if c != "__l"], (-F.col("__l.t")).alias("last_t"),
        F.col("__l.channel").alias("last_channel"), F.col("__l.lat").alias("last_lat"), nested.alias("nested"),
    )


def across_seeds(runs: DataFrame, metric: str, baseline: str) -> DataFrame:
    """Mean and deviation over seeds, and the reduction of the mean against a baseline column."""
    return runs.agg(
        F.count("*").alias("seeds"), F.avg(metric).alias("mean"),
        F.when(F.count("*") >= 2, F.stddev_samp(metric)).alias("deviation"),
        (100 * (1 - F.avg(metric) / F.avg(baseline))).alias("reduction_pct"),
    )


def country_of_currency(countries: DataFrame) -> DataFrame:
    """One country per currency; an error when two packs share one."""
    counted = countries.groupBy("currency").agg(
        F.count("*").alias("n"), F.min("country").alias("country")
    )
    clash = F.raise_error(F.concat(F.lit("two packs share the currency "), F.col("currency")))
    return counted.select("currency", F.when(F.col("n") > 1, clash).otherwise(F.col("country")).alias("country"))


def attach_country(rows: DataFrame, countries: DataFrame) -> DataFrame:
    return rows.join(country_of_currency(countries), "currency", "left")


def history_slice(history: DataFrame, since: int, until: int) -> DataFrame:
    """Rows of [since, until) in account, time and id order, cut into ranges of that order.

    Ranges cut through a busy account where a hash partition would gather it.
    """
    part = history.filter((F.col("t") >= since) & (F.col("t") < until))
    return part.repartitionByRange("account", "t", "tx_id").sortWithinPartitions("account", "t", "tx_id")


def row_position(rows: DataFrame, file: str, at: str, tie: list[str], grain: int = HOUR) -> DataFrame:
    """Sub-second part, day of month, and relative position of each row in its file or month.

    Files are few and long: numbering is cut in time, never one file in one task.
    """
    numbered = running(
        rows.withColumn("__c", F.lit(0)), [file, "__c"], at,
        {"__i": Agg("sum", F.lit(1).cast("long"))}, Split("__c", ("0",), grain), tie=[F.col(c) for c in tie],
    ).drop("__c")
    sizes = rows.groupBy(file).agg(F.count("*").alias("__n"))
    return numbered.join(sizes, file).select(
        *rows.columns, (F.col(at) % SECOND).alias("sub_second"),
        F.dayofmonth(F.timestamp_micros(at)).alias("day"),
        (F.coalesce(F.col("__i"), F.lit(0)) / F.greatest(F.col("__n") - 1, F.lit(1))).alias("position"),
    )
