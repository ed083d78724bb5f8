"""Reference data read as of an event, latest rows per key, and the next event after one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.operators.hotkeys import Split
from tidewatch.operators.running import Agg, running, sweep


def asof(
    events: DataFrame,
    versions: DataFrame,
    key: str,
    at: str,
    effective: str,
    values: list[str],
    *,
    tie: Column | None = None,
    strict: bool = False,
    split: Split | None = None,
) -> DataFrame:
    """The version of ``key`` in force at each event; NULL before the first one.

    Equal effective times keep the version with the smallest ``tie``. Both sides go through one
    shuffle as a union; a version is a row that later events of the key see.
    """
    order = -tie if tie is not None else F.lit(0)
    seen_from = F.col(effective) if strict else F.col(effective) - 1
    table = versions.select(
        key,
        seen_from.alias("at"),
        F.struct(F.col(effective).alias("__e"), order.alias("__o"), *values).alias("__v"),
    )
    out = sweep(events, key, at, [], {"__v": "max"}, [table], split, nullable_key=True)
    return out.select(*events.columns, *[F.col(f"__v.{v}").alias(v) for v in values])


def asof_small(
    events: DataFrame, versions: DataFrame, key: str, at: str, effective: str, value: str
) -> DataFrame:
    """The same for configuration-sized versions: each key's versions travel as one sorted array.

    How the arrays are joined is left to the sizes that Spark measures.
    """
    packed = versions.groupBy(key).agg(
        F.sort_array(F.collect_list(F.struct(effective, value))).alias("__vs")
    )
    in_force = F.filter("__vs", lambda v: v[effective] <= F.col(at))
    joined = events.join(packed, key, "left")
    return joined.withColumn(value, F.try_element_at(in_force, F.lit(-1))[value]).drop("__vs")


def rates_on(rates: DataFrame) -> DataFrame:
    """One rate per currency and date: a later recording of a date corrects an earlier one."""
    return rates.groupBy("currency", "rate_date").agg(
        F.max_by("rate_thousandths", "recorded_at").alias("rate_thousandths")
    )


def latest(df: DataFrame, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    """The last row per key in ``order``: an aggregate, so a busy key combines before the shuffle."""
    top = F.max(F.struct(*order, *[v for v in values if v not in order])).alias("__top")
    return df.groupBy(*keys).agg(top).select(
        *keys, *[F.col(f"__top.{v}").alias(v) for v in values]
    )


def next_event(
    marks: DataFrame, events: DataFrame, key: str, mark_at: str, event_at: str, name: str,
    split: Split | None = None,
) -> DataFrame:
    """For each mark, the time of the first event of its key at or after it, or NULL.

    Looking forward is looking back with time negated: the largest -event_at not above -mark_at.
    """
    cols = marks.columns
    rows = marks.select(
        F.col(key), (-F.col(mark_at)).alias("__at"), F.struct(*cols).alias("__row")
    ).unionByName(
        events.select(
            F.col(key),
            (-F.col(event_at) - 1).alias("__at"),  # one earlier, so an equal time is seen
            (-F.col(event_at)).alias("__e"),
        ),
        allowMissingColumns=True,
    )
    out = running(rows, [key], "__at", {"__n": Agg("max", F.col("__e"))}, split)
    return out.filter(F.col("__row").isNotNull()).select(
        "__row.*", (-F.col("__n")).alias(name)
    )
