"""What analysts look at: alert queues, account history, behaviour profiles, networks' inputs."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions import clock, reasons
from tidewatch.operators.asof import latest
from tidewatch.operators.order import quantiles

DAY = 86_400_000_000

# Amount bucket edges, each bucket half-open; and the history a judgement needs.
AMOUNT_EDGES = (
    0, 1_000, 5_000, 10_000, 50_000, 100_000, 500_000, 1_000_000, 5_000_000, 10_000_000, 50_000_000,
    100_000_000, 500_000_000, 1_000_000_000, 10_000_000_000, 100_000_000_000, 1_000_000_000_000,
    99_999_999_999_999,
)
MINIMUM_HISTORY = 10
_ROLE = {"ANALYST": 1, "SENIOR_ANALYST": 2, "RISK_OFFICER": 3}


# ---- filters ----------------------------------------------------------------------------------------


def for_institution(df: DataFrame, institution: str) -> DataFrame:
    """The tenant filter every read starts with."""
    return df.filter(F.col("institution") == institution)


@dataclass(frozen=True)
class AlertFilter:
    """Optional conditions; an absent one does not filter."""

    tx_id: int | None = None
    account: int | None = None
    amount_min: float | None = None
    amount_max: float | None = None
    channels: list[str] = field(default_factory=list)
    since: int | None = None
    until: int | None = None
    tiers: list[str] = field(default_factory=list)
    analyst: int | None = None
    statuses: list[str] = field(default_factory=list)


def alert_filter(alerts: DataFrame, f: AlertFilter) -> DataFrame:
    """Rows that satisfy every given condition; time is half-open, unasked status means undecided."""
    conditions: list[Column] = []
    for column, value in (("tx_id", f.tx_id), ("account", f.account), ("analyst_id", f.analyst)):
        if value is not None:
            conditions.append(F.col(column) == value)
    if f.amount_min is not None:
        conditions.append(F.col("amount") >= f.amount_min)
    if f.amount_max is not None:
        conditions.append(F.col("amount") <= f.amount_max)
    if f.since is not None:
        conditions.append(F.col("t") >= f.since)
    if f.until is not None:
        conditions.append(F.col("t") < f.until)
    if f.channels:
        conditions.append(F.col("channel").isin(f.channels))
    if f.tiers:
        conditions.append(F.col("tier").isin(f.tiers))
    conditions.append(F.col("status").isin(f.statuses or ["PENDING", "IN_REVIEW"]))
    for condition in conditions:
        alerts = alerts.filter(condition)
    return alerts


def visible_to(alerts: DataFrame, decisions: DataFrame, role: str, user: int) -> DataFrame:
    """Alerts a caller may see: not escalated, escalated to at most their rank, or by themselves."""
    rank = F.when(F.col("target_role") == "SENIOR_ANALYST", 2).when(
        F.col("target_role") == "RISK_OFFICER", 3
    )
    own = decisions.filter((F.col("decision") == "ESCALATE") & (F.col("analyst_id") == user)).select(
        F.col("alert_id").alias("escalated_from"), F.lit(True).alias("__own")
    )
    seen = alerts.join(own.distinct(), "escalated_from", "left")
    allowed = (
        F.col("escalated_from").isNull() | (rank <= _ROLE[role]) | F.coalesce("__own", F.lit(False))
    )
    return seen.filter(allowed).select(*alerts.columns)


def audit_filter(
    rows: DataFrame, user: int | None = None, event_type: str | None = None,
    since: int | None = None, until: int | None = None, entity: int | None = None,
) -> DataFrame:
    for column, value in (("user_id", user), ("event_type", event_type), ("entity_id", entity)):
        if value is not None:
            rows = rows.filter(F.col(column) == value)
    if since is not None:
        rows = rows.filter(F.col("event_at") >= since)
    if until is not None:
        rows = rows.filter(F.col("event_at") < until)
    return rows


# ---- pages -------------------------------------------------------------------------------------------


def page(
    df: DataFrame, keys: list[Column], id_column: str, limit: int, after: tuple | None = None
) -> DataFrame:
    """One keyset page: rows after the cursor in ascending key order, and whether more follow.

    Keys that sort descending are passed negated. Spark takes the top rows of each partition and
    merges those, so nothing is sorted globally; the numbering sees at most ``limit`` + 1 rows.
    """
    names = [f"__k{i}" for i in range(len(keys))]
    keyed = df.select("*", *[k.alias(n) for k, n in zip(keys, names)])
    order = [*names, id_column]
    if after is not None:
        cursor = [F.lit(v).cast(keyed.schema[c].dataType).alias(c) for v, c in zip(after, order)]
        keyed = keyed.filter(F.struct(*order) > F.struct(*cursor))
    top = keyed.orderBy(*order).limit(limit + 1)
    ordered = Window.orderBy(*order)
    numbered = top.withColumn("position", F.row_number().over(ordered)).withColumn(
        "has_more", F.count("*").over(Window.partitionBy()) > limit
    )
    return numbered.filter(F.col("position") <= limit).drop(*names)


def priority_keys(queue: str = "STANDARD") -> list[Column]:
    """Sort keys of the default order; an unknown score sorts last."""
    if queue == "ANOMALY":
        return [-F.coalesce(F.col("anomaly"), F.lit(-1.0))]
    rank = F.when(F.col("tier") == "HIGH", 0).when(F.col("tier") == "MEDIUM", 1).otherwise(2)
    return [rank.cast("double"), -F.col("fraud_probability")]


def expected_loss_keys() -> list[Column]:
    return [-F.coalesce(F.col("expected_loss").cast("double"), F.lit(-1.0))]


def newest_keys() -> list[Column]:
    return [-F.col("created_at")]


# ---- joined views ---------------------------------------------------------------------------------------


def alert_queue(alerts: DataFrame, payments: DataFrame, scores: DataFrame) -> DataFrame:
    """Alerts with their payment and the exact score revision that raised them."""
    p = payments.select("tx_id", "counterparty", "mcc", "ts")
    s = scores.select("tx_id", F.col("scored_at").alias("created_at"), "revision", "fallback")
    return alerts.join(p, "tx_id").join(s, ["tx_id", "created_at"])


def scored_history(payments: DataFrame, scores: DataFrame, states: DataFrame) -> DataFrame:
    """Each payment with its latest score and what became of it."""
    score = latest(scores, ["tx_id"], ["scored_at", "revision"], ["revision", "score"])
    state = latest(states, ["tx_id"], ["seq"], ["decision"])
    return (
        payments.drop("score")
        .join(score, "tx_id")
        .join(state, "tx_id", "left")
        .withColumn("outcome", reasons.outcome(F.col("decision")))
    )


def decision_views(decisions: DataFrame, commits: DataFrame, undos: DataFrame) -> DataFrame:
    """Whether each analyst decision stands, was undone, or can still be undone."""
    return (
        decisions.join(commits, "decision_id", "left")
        .join(undos, "decision_id", "left")
        .withColumn(
            "state",
            F.when(F.col("committed_at").isNotNull(), "COMMITTED")
            .when(F.col("undone_at").isNotNull(), "UNDONE")
            .otherwise("PENDING_COMMIT"),
        )
    )


def block_status(
    blocks: DataFrame, answers: DataFrame, unblocks: DataFrame, notices: DataFrame, frozen: DataFrame
) -> DataFrame:
    """Blocked payments with the customer's answer, the unblock, notice sent and latest freeze."""
    told = notices.select("tx_id").distinct().withColumn("notified", F.lit(True))
    last_freeze = frozen.groupBy("account").agg(F.max("frozen_at").alias("frozen_at"))
    return (
        blocks.join(answers, "tx_id", "left")
        .join(unblocks, "tx_id", "left")
        .join(told, "tx_id", "left")
        .join(last_freeze, "account", "left")
        .withColumn("notified", F.coalesce("notified", F.lit(False)))
        .withColumn(
            "status",
            F.when(F.col("unblocked_at").isNotNull(), "UNBLOCKED")
            .when(F.col("answer").isNotNull(), "ANSWERED")
            .otherwise("AWAITING_CUSTOMER"),
        )
    )


def unapplied_unblocks(unblocks: DataFrame, states: DataFrame) -> DataFrame:
    """Unblocks whose payment has no later approving state."""
    applied = states.filter("seq > 1 and decision = 'APPROVE'").select("tx_id")
    return unblocks.join(applied, "tx_id", "left_anti").select("tx_id", "unblocked_at").distinct()


# ---- behaviour profile --------------------------------------------------------------------------------------


def amount_bucket(amount: Column) -> Column:
    """Index of the amount's bucket; the last one is open upwards."""
    out = F.lit(len(AMOUNT_EDGES) - 2)
    for i in range(len(AMOUNT_EDGES) - 3, -1, -1):
        out = F.when(amount < AMOUNT_EDGES[i + 1], i).otherwise(out)
    return out


def hour_range(hours: Column, total: Column) -> Column:
    """Shortest circular hour range (start, end) holding 90%, the earliest start among equals."""
    twice = F.concat(hours, hours)

    def candidate(i: Column) -> Column:
        length, start = F.floor(i / 24) + 1, i % 24
        held = F.aggregate(
            F.slice(twice, start.cast("int") + 1, length.cast("int")),
            F.lit(0).cast("long"),
            lambda a, x: a + x,
        )
        return F.when(held * 10 >= total * 9, i)

    best = F.array_min(F.transform(F.sequence(F.lit(0), F.lit(575)), candidate))
    start = (best % 24).cast("int")
    return F.struct(
        start.alias("start"), ((start + F.floor(best / 24)) % 24).cast("int").alias("end")
    )


def profiles(payments: DataFrame, compared: DataFrame, days: int = 90) -> DataFrame:
    """How one payment per account compares with the account's 90 days before it.

    Counts are grouped aggregates and the percentiles come from per-account histograms, so a busy
    account is combined before it is shuffled and never gathered.
    """
    c = compared.select(
        "account", F.col("t").alias("__t"), F.col("hour").alias("c_hour"), F.col("cents").alias("c_cents"),
        F.col("channel").alias("c_channel"), F.col("counterparty").alias("c_cp"),
        F.col("device").alias("c_device"), F.col("counterparty_country").alias("c_country"),
    )
    rows = payments.join(c, "account").filter(
        (F.col("t") >= F.col("__t") - days * DAY) & (F.col("t") < F.col("__t"))
    )

    def n(condition: Column) -> Column:
        return F.sum(condition.cast("long"))

    totals = rows.groupBy("account").agg(
        F.count("*").alias("n"),
        F.array(*[n(F.col("hour") == h) for h in range(24)]).alias("hours"),
        F.array(
            *[n(amount_bucket(F.col("amount")) == b) for b in range(len(AMOUNT_EDGES) - 1)]
        ).alias("buckets"),
        F.coalesce(n(F.col("channel") == F.col("c_channel")), F.lit(0)).alias("same_channel"),
        F.coalesce(n(F.col("counterparty") == F.col("c_cp")), F.lit(0)).alias("prior_counterparty"),
        F.coalesce(n(F.col("device") == F.col("c_device")), F.lit(0)).alias("prior_device"),
        F.coalesce(n(F.col("counterparty_country") == F.col("c_country")), F.lit(0)).alias("prior_country"),
    )
    usual = mode(rows, ["account"], "channel").withColumnRenamed("channel", "usual_channel")
    spread = quantiles(rows, "cents", {"p5": 0.05, "p95": 0.95}, ["account"], nearest_rank=True)
    out = c.join(totals, "account", "left").join(usual, "account", "left").join(spread, "account", "left")
    count = F.coalesce(F.col("n"), F.lit(0))
    enough = count >= MINIMUM_HISTORY
    usual_hours = hour_range(F.col("hours"), F.col("n"))
    h = F.col("c_hour")
    start, end = F.col("__r.start"), F.col("__r.end")
    inside = F.when(start <= end, (h >= start) & (h <= end)).otherwise((h >= start) | (h <= end))
    return out.withColumn("__r", F.when(enough, usual_hours)).select(
        "account", count.alias("n"), "hours", trimmed(F.col("buckets")).alias("histogram"),
        start.alias("hour_start"), end.alias("hour_end"),
        F.coalesce(enough & ~inside, F.lit(False)).alias("unusual_hour"),
        F.when(enough, F.col("p5")).alias("p5"), F.when(enough, F.col("p95")).alias("p95"),
        F.coalesce(enough & ((F.col("c_cents") < F.col("p5")) | (F.col("c_cents") > F.col("p95"))), F.lit(False)).alias("unusual_amount"),
        F.when(enough, F.col("usual_channel")).alias("usual_channel"),
        (enough & (F.coalesce("same_channel", F.lit(0)) * 20 < count)).alias("unusual_channel"),
        F.coalesce("prior_counterparty", F.lit(0)).alias("prior_counterparty"),
        (enough & (F.coalesce("prior_counterparty", F.lit(0)) == 0)).alias("new_counterparty"),
        (enough & F.col("c_device").isNotNull() & (F.coalesce("prior_device", F.lit(0)) == 0)).alias("new_device"),
        (enough & F.col("c_country").isNotNull() & (F.coalesce("prior_country", F.lit(0)) == 0)).alias("new_country"),
    )


def trimmed(buckets: Column) -> Column:
    """(bucket, count) from the first used bucket to the last, empty ones between kept."""
    used = F.filter(
        F.transform(buckets, lambda n, i: F.struct(i.alias("bucket"), n.alias("count"))),
        lambda b: b["count"] > 0,
    )
    first, last = F.try_element_at(used, F.lit(1))["bucket"], F.try_element_at(used, F.lit(-1))["bucket"]
    every = F.transform(buckets, lambda n, i: F.struct(i.alias("bucket"), n.alias("count")))
    return F.filter(every, lambda b: (b["bucket"] >= first) & (b["bucket"] <= last))


def mode(rows: DataFrame, group: list[str], column: str) -> DataFrame:
    """Most frequent value per group, the first in order among equals."""
    counts = rows.filter(F.col(column).isNotNull()).groupBy(*group, column).agg(F.count("*").alias("__c"))
    best = F.min(F.struct((-F.col("__c")).alias("c"), F.col(column).alias("v"))).alias("__m")
    return counts.groupBy(*group).agg(best).select(*group, F.col("__m.v").alias(column))


def with_local_hour(payments: DataFrame) -> DataFrame:
    return payments.withColumn("hour", F.hour(clock.local_time(F.col("t"), F.col("utc_offset_hours"))))
