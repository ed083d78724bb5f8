"""Monitoring aggregates and alert rules over recorded decisions.

Every rule works on bucket totals: the number of buckets depends on the time span and a few labels,
never on the traffic, so the range windows over them are small whatever the load.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MINUTE = 60_000_000
HOUR = 60 * MINUTE
DAY = 24 * HOUR


def buckets(df: DataFrame, at: str, size: int, keys: list[str], **sums: Column) -> DataFrame:
    """Totals per key and tumbling bucket; ``bucket`` is the bucket's start."""
    start = (F.expr(f"{at} div {size}") * F.lit(size)).alias("bucket")
    return df.groupBy(*keys, start).agg(F.count("*").alias("n"), *[e.alias(k) for k, e in sums.items()])


def volumes(payments: DataFrame, keys: list[str], size: int) -> DataFrame:
    """Count and exact sum per key and bucket: the continuous aggregates."""
    return buckets(payments, "t", size, keys, total=F.sum("amount"))


def _past(keys: list[str], span: int, include_now: bool) -> Window:
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    return w.orderBy("bucket").rangeBetween(-(span - 1), 0 if include_now else -1)


def share_anomalies(hourly: DataFrame, keys: list[str], days: int = 30, sigmas: float = 3.0,
                    warmup_days: int = 7) -> DataFrame:
    """Hours whose ``ratio`` lies outside its trailing mean by more than ``sigmas`` deviations.

    Needs a bucket exactly ``warmup_days`` earlier, so a young series cannot alarm.
    """
    past = _past(keys, days * DAY, True)
    exact = Window.partitionBy(*keys).orderBy("bucket").rangeBetween(-warmup_days * DAY, -warmup_days * DAY)
    out = hourly.select(
        "*", F.avg("ratio").over(past).alias("mean"), F.stddev_pop("ratio").over(past).alias("sigma"),
        F.max("ratio").over(exact).alias("__then"),
    )
    off = F.abs(F.col("ratio") - F.col("mean")) > F.lit(sigmas) * F.col("sigma")
    return out.withColumn("alarm", off & F.col("__then").isNotNull()).drop("__then")


def rate_anomalies(quarters: DataFrame, factor: float = 3.0, floor_per_s: float = 1 / 60,
                   days: int = 7, size: int = 15 * MINUTE) -> DataFrame:
    """Buckets whose rate exceeds a multiple of its trailing mean and an absolute floor.

    A bucket with no events has no row, so the mean divides by the buckets of the span.
    """
    seconds = size / 1e6
    past = _past([], days * DAY, True)
    first = F.min("bucket").over(Window.partitionBy(F.lit(0)).orderBy("bucket").rangeBetween(Window.unboundedPreceding, 0))
    span = F.least(F.lit(days * DAY // size), F.expr("1") + (F.col("bucket") - first) / F.lit(size))
    out = quarters.select("*", (F.col("n") / F.lit(seconds)).alias("rate"),
                          (F.sum("n").over(past) / span / F.lit(seconds)).alias("mean_rate"))
    return out.withColumn(
        "alarm", (F.col("rate") > F.lit(factor) * F.col("mean_rate")) & (F.col("rate") > floor_per_s)
    )


def traffic_drops(fives: DataFrame, drop: float = 0.2, floor: float = 1.0, size: int = 5 * MINUTE) -> DataFrame:
    """Buckets with over ``drop`` less traffic than the same bucket a week earlier."""
    week = Window.partitionBy(F.lit(0)).orderBy("bucket").rangeBetween(-7 * DAY, -7 * DAY)
    rate = F.col("n") / F.lit(size / 1e6)
    out = fives.select("*", rate.alias("rate"), (F.max("n").over(week) / F.lit(size / 1e6)).alias("week_ago"))
    return out.withColumn(
        "alarm",
        F.coalesce((F.col("rate") < F.lit(1 - drop) * F.col("week_ago")) & (F.col("week_ago") > floor), F.lit(False)),
    )


def auc_drops(hourly: DataFrame, min_coverage: float = 0.30, drop: float = 0.03, min_hours: int = 72,
              days: int = 30) -> DataFrame:
    """Hours whose covered AUC fell below the trailing mean of covered hours.

    An hour with too few labels neither alarms nor enters the baseline.
    """
    covered = F.when(F.col("coverage") >= min_coverage, F.col("auc"))
    past = _past([], days * DAY, True)
    out = hourly.withColumn("covered_auc", covered).select(
        "*", F.avg("covered_auc").over(past).alias("baseline"), F.count("covered_auc").over(past).alias("covered_hours")
    )
    fell = (F.col("covered_auc") < F.col("baseline") - drop) & (F.col("covered_hours") >= min_hours)
    return out.withColumn("alarm", F.coalesce(fell, F.lit(False)))


def suppressed_cells(events: DataFrame, cell: str, minimum: int = 10) -> DataFrame:
    """Cell totals safe to publish: cells under the minimum are merged into one other row.

    The merged row is published only when it reaches the minimum itself.
    """
    per_cell = events.groupBy(cell).agg(F.count("*").alias("n"), F.sum(F.col("is_fraud").cast("long")).alias("fraud"))
    named = F.when(F.col("n") >= minimum, F.col(cell)).otherwise("other").alias(cell)
    return (
        per_cell.select(named, "n", "fraud")
        .groupBy(cell)
        .agg(F.sum("n").alias("events"), F.sum("fraud").alias("fraud"))
        .filter(F.col("events") >= minimum)
    )


def alert_condition_held(rows: DataFrame, keys: list[str], size: int, hold: int) -> DataFrame:
    """Buckets at which ``alarm`` has been true in every bucket of the hold period."""
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    recent = w.orderBy("bucket").rangeBetween(-(hold - size), 0)
    need = hold // size
    held = F.sum(F.col("alarm").cast("long")).over(recent) >= need
    return rows.withColumn("firing", held)
