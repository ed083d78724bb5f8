"""Tiers, freezes, circuit breakers, holds and the decision itself, over whole histories.

Each is the closed form of a sequential rule, so it is a window or an as-of lookup and not a loop
over events.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions import reasons
from tidewatch.operators.asof import latest
from tidewatch.operators.hotkeys import HotKeys, Split
from tidewatch.operators.order import quantiles
from tidewatch.operators.running import Agg, Trailing, running, sweep, trailing

MINUTE = 60_000_000

# Freezes and the score used while no model is available.
FREEZE_COUNT, FREEZE_WINDOW = 3, 60 * MINUTE
FALLBACK_REVIEW_AMOUNT = 2_000_000
RANK = {"LOW": 0, "MEDIUM": 1, "HIGH": 2}

# Transitions a decision may make, as (from, to, decided by).
TRANSITIONS = (
    ("HOLD", "APPROVE", "ANALYST"),
    ("HOLD", "DECLINE", "ANALYST"),
    ("HOLD", "TIMEOUT_RELEASE", "TIMEOUT_POLICY"),
    ("HOLD", "DECLINE", "TIMEOUT_POLICY"),
    ("DECLINE", "APPROVE", "CUSTOMER_VERIFICATION"),
    ("DECLINE", "APPROVE", "SENIOR_OVERRIDE"),
    ("APPROVE", "DECLINE", "SENIOR_OVERRIDE"),
    ("TIMEOUT_RELEASE", "DECLINE", "SENIOR_OVERRIDE"),
)


def tier(score: Column, medium: Column | float = 0.60, high: Column | float = 0.85) -> Column:
    """Half-open tiers: a score on a threshold belongs to the upper tier."""
    return F.when(score >= high, "HIGH").when(score >= medium, "MEDIUM").otherwise("LOW")


def tiered(df: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Tier by the channel's thresholds, the defaults where a channel has none."""
    medium, high = F.coalesce("medium", F.lit(0.60)), F.coalesce("high", F.lit(0.85))
    return (
        df.join(thresholds, "channel", "left")
        .withColumn("tier", tier(F.col("score"), medium, high))
        .drop("medium", "high")
    )


def fallback_tier(amount: Column, review: Column | float = FALLBACK_REVIEW_AMOUNT) -> Column:
    return F.when(amount >= review, "MEDIUM").otherwise("LOW")


# ---- freezes ---------------------------------------------------------------------------------------


def freezes(
    decisions: DataFrame, hot: HotKeys | None = None, window: int = FREEZE_WINDOW
) -> DataFrame:
    """Whether an account is frozen by each HIGH decision, and which one froze it.

    A decision freezes when at least three HIGH ones, itself included, lie in the window ending at it. The
    account then stays frozen, so the freeze fires at its first such decision.
    """
    split = hot.split("account") if hot else None
    high = decisions.filter("tier = 'HIGH'")
    one = F.lit(1).cast("long")
    # Simultaneous decisions count too: those strictly before, plus those at the very instant.
    counted = trailing(high, ["account"], "t", {"__n": Trailing(one, window)}, None, split)
    now = F.count("*").over(Window.partitionBy("account", "t"))
    marked = counted.withColumn("high_in_window", F.col("__n") + now).withColumn(
        "freezes", F.col("high_in_window") >= FREEZE_COUNT
    )
    seen = running(
        marked, ["account"], "t",
        {"__earlier": Agg("max", F.col("freezes").cast("int"))}, split,
    )
    first_of_instant = F.min("tx_id").over(Window.partitionBy("account", "t")) == F.col("tx_id")
    fires = F.col("freezes") & (F.coalesce(F.col("__earlier"), F.lit(0)) == 0) & first_of_instant
    return seen.withColumn("fires", fires).drop("__n", "__earlier")


def freeze_episodes(
    decisions: DataFrame, releases: DataFrame, hot: HotKeys | None = None, window: int = FREEZE_WINDOW
) -> DataFrame:
    """The decisions that freeze an account, where a release (account, released_at) arms it again.

    A decision with enough HIGH ones in its window freezes unless the one before it did and no release
    came since. At one instant decisions come before releases.
    """
    split = hot.split("account") if hot else None
    marked = freezes(decisions, hot, window).drop("fires")
    seen = running(
        marked, ["account"], "t", {"__earlier": Agg("max", F.when(F.col("freezes"), F.col("t")))}, split,
    )
    armed = releases.select("account", F.col("released_at").alias("at"), F.col("released_at").alias("__armed"))
    seen = sweep(seen, "account", "t", [], {"__armed": "max"}, [armed], split)
    first_of_instant = F.min("tx_id").over(Window.partitionBy("account", "t")) == F.col("tx_id")
    free = F.col("__earlier").isNull() | F.coalesce(F.col("__earlier") <= F.col("__armed"), F.lit(False))
    return seen.withColumn("__fires", F.col("freezes") & free & first_of_instant).filter("__fires").select("account", "tx_id", "t")


def frozen_since(decisions: DataFrame, frozen: DataFrame, split: Split | None = None) -> DataFrame:
    """Marks payments of an account that come after its freeze."""
    starts = frozen.filter("fires").select(
        "account", F.col("t").alias("at"), F.col("t").alias("__f")
    )
    out = sweep(decisions, "account", "t", [], {"__f": "min"}, [starts], split)
    return out.withColumn("frozen", F.col("__f").isNotNull()).drop("__f")


# ---- circuit breakers ---------------------------------------------------------------------------------


@dataclass(frozen=True)
class Breaker:
    threshold: str = "0.05"
    minutes: int = 15
    minimum: int = 20
    reset_minutes: int = 60


def breaker_minutes(p: DataFrame, keys: list[str]) -> DataFrame:
    """Payments and confirmed fraud per key and minute of the payment."""
    return p.groupBy(*keys, F.expr(f"t div {MINUTE}").alias("minute")).agg(
        F.count("*").alias("n"), F.sum(F.col("is_fraud").cast("long")).alias("fraud")
    )


def breakers(minutes: DataFrame, keys: list[str], settings: Breaker = Breaker()) -> DataFrame:
    """State of each key's breaker at each of its minutes, with the open and close events.

    The sum runs over the current minute and the ones before it in the window. Hysteresis has a
    closed form: the breaker is open at a minute exactly when its last breach, if any, is less
    than the reset time old. The rows are minute totals: few per key, whatever the traffic.
    """
    w = Window.partitionBy(*keys).orderBy("minute")
    recent = w.rangeBetween(-(settings.minutes - 1), 0)
    n, fraud = F.sum("n").over(recent), F.sum("fraud").over(recent)
    counted = minutes.select(*keys, "minute", n.alias("n"), F.least(fraud, n).alias("fraud"))
    breach = (F.col("n") >= settings.minimum) & (
        F.col("fraud") > F.lit(settings.threshold).cast("decimal(6,4)") * F.col("n")
    )
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    last = F.max(F.when(F.col("breach"), F.col("minute"))).over(upto)
    stated = counted.withColumn("breach", breach).withColumn("last_breach", last)
    opened = F.coalesce(
        F.col("minute") < F.col("last_breach") + settings.reset_minutes, F.lit(False)
    )
    stated = stated.withColumn("open", opened)
    before = F.coalesce(F.lag("open").over(w), F.lit(False))
    change = F.when(F.col("open") & ~before, "OPENED").when(~F.col("open") & before, "CLOSED")
    return stated.withColumn("change", change)


# ---- holds -------------------------------------------------------------------------------------------


def overdue_holds(states: DataFrame, now_us: int, review_us: int, grace_us: int = 0) -> DataFrame:
    """Holds past their deadline and grace with no later state: an anti join on the sequence."""
    holds = states.filter("seq = 1 and decision = 'HOLD'").withColumn(
        "deadline", F.col("at") + review_us
    )
    answered = states.filter("seq > 1").select("tx_id")
    return holds.filter(F.col("deadline") + grace_us <= now_us).join(answered, "tx_id", "left_anti")


def resolve_holds(overdue: DataFrame, policies: DataFrame, now_us: int) -> DataFrame:
    """The next state of each overdue hold, by the policy in force when it was decided.

    Policies are ordered by version, not by time: the highest version effective by then.
    """
    packed = policies.groupBy("scope").agg(
        F.sort_array(F.collect_list(F.struct("version", "effective_at", "policy"))).alias("__ps")
    )
    in_force = F.filter("__ps", lambda v: v["effective_at"] <= F.col("at"))
    policy = F.coalesce(
        F.try_element_at(in_force, F.lit(-1))["policy"], F.lit("RELEASE_WITH_TIMEOUT_LABEL")
    )
    release = F.col("policy") == "RELEASE_WITH_TIMEOUT_LABEL"
    return (
        overdue.withColumn("scope", F.lit(0))
        .join(packed, "scope", "left")
        .withColumn("policy", policy)
        .select(
            "tx_id", (F.col("seq") + 1).alias("seq"), "policy",
            F.when(release, "TIMEOUT_RELEASE").otherwise("DECLINE").alias("decision"),
            F.lit("TIMEOUT_POLICY").alias("decided_by"), F.lit(now_us).alias("at"),
            F.when(release, "REVIEW_TIMEOUT").otherwise("REVIEW_TIMEOUT_DECLINED").alias("reason"),
        )
    )


def transition_errors(states: DataFrame) -> DataFrame:
    """States that skip a sequence number or make a move their decider may not make."""
    w = Window.partitionBy("tx_id").orderBy("seq")
    before = states.select(
        "*", F.lag("seq").over(w).alias("__seq"), F.lag("decision").over(w).alias("__from")
    )
    allowed = F.lit(False)
    for source, target, by in TRANSITIONS:
        allowed = allowed | (
            (F.col("__from") == source) & (F.col("decision") == target) & (F.col("decided_by") == by)
        )
    problem = F.when(F.col("seq") != F.coalesce(F.col("__seq"), F.lit(0)) + 1, "sequence").when(
        F.col("__from").isNotNull() & ~allowed, "transition"
    )
    return before.withColumn("problem", problem).filter("problem is not null").drop("__seq", "__from")


def labels_from_answers(states: DataFrame) -> DataFrame:
    """The label an analyst's or customer's answer implies."""
    answered = states.filter(
        "seq > 1 and decided_by in ('ANALYST', 'CUSTOMER_VERIFICATION', 'SENIOR_OVERRIDE')"
    )
    return answered.select(
        "tx_id", "seq",
        F.when(F.col("decision") == "DECLINE", "FRAUD").otherwise("LEGITIMATE").alias("label"),
        F.col("decided_by").alias("source"), F.col("at").alias("label_at"),
    )


# ---- the decision ----------------------------------------------------------------------------------------


def decide(df: DataFrame, review_us: int, anomaly_threshold: float = 0.95) -> DataFrame:
    """Decision, tier, alert, deadline and up to three reasons of each payment, in one projection.

    Needs: score, anomaly, fallback, amount, contributions, rule_override, breaker_open, frozen, t.
    """
    fallback = F.col("fallback")
    base = F.when(fallback, fallback_tier(F.col("amount"))).otherwise(tier(F.col("score")))
    rank = _rank(base)
    ruled = F.coalesce(_rank(F.col("rule_override")), F.lit(-1))
    after_rules = F.greatest(rank, ruled)
    by_breaker = F.col("breaker_open") & (after_rules == 0)
    final = F.when(by_breaker, 1).otherwise(after_rules)
    none = F.array().cast("array<string>")
    raised = F.concat(
        F.when(ruled > rank, F.array(F.lit("CUSTOM_RULE"))).otherwise(none),
        F.when(by_breaker, F.array(F.lit("MCC_CIRCUIT_BREAKER"))).otherwise(none),
    )
    leading = F.when(fallback, F.array(F.lit("ML_UNAVAILABLE"))).otherwise(none)
    scored = reasons.model_reasons(F.col("contributions"))
    scored = F.when(fallback, F.when(rank == 1, F.array(F.lit("AMOUNT_ABOVE_NORMAL"))).otherwise(none)).when(
        F.size(scored) == 0, F.array(F.lit(reasons.MODEL_RISK))
    ).otherwise(scored)
    out = df.select(
        "*", final.alias("__rank"), leading.alias("__lead"),
        reasons.merge(leading, raised, scored).alias("__merged"),
    )
    r, frozen = F.col("__rank"), F.col("frozen")
    names = F.when(r == 2, "HIGH").when(r == 1, "MEDIUM").otherwise("LOW")
    decision = F.when(frozen | (r == 2), "DECLINE").when(r == 1, "HOLD").otherwise("APPROVE")
    alert = F.when(frozen, None).when(r > 0, names).when(
        ~fallback & (F.col("anomaly") >= anomaly_threshold), "ANOMALY"
    )
    return out.select(
        *df.columns,
        decision.alias("decision"),
        names.alias("decision_tier"),
        alert.alias("alert"),
        F.when(~frozen & (r == 1), F.col("t") + review_us).alias("review_deadline"),
        (~frozen & (r == 2)).alias("auto_block"),
        F.when(frozen, F.array(F.lit("ACCOUNT_FROZEN")))
        .when(r > 0, F.col("__merged"))
        .otherwise(F.col("__lead"))
        .alias("reasons"),
    )


def _rank(name: Column) -> Column:
    out = F.lit(None).cast("int")
    for tier_name, rank in RANK.items():
        out = F.when(name == tier_name, rank).otherwise(out)
    return out


def status_quo_rules(
    p: DataFrame, train: Column, blocklist: list[str], quantile: float = 0.99
) -> DataFrame:
    """0, 1 or 2 fired rules: an amount over the legitimate training quantile, a listed category."""
    k = F.lit(0).alias("__k")
    legitimate = p.filter(train & ~F.col("is_fraud")).select(
        F.log1p(F.col("amount").cast("double")).alias("__x")
    )
    limit = quantiles(legitimate, "__x", {"__limit": quantile})
    rows = p.select("*", k).join(F.broadcast(limit.select("*", k)), "__k")
    over = F.log1p(F.col("amount").cast("double")) > F.col("__limit")
    fired = over.cast("int") + F.col("mcc").isin(blocklist).cast("int")
    return rows.withColumn("rules_fired", fired).drop("__k", "__limit")


def current_state(states: DataFrame) -> DataFrame:
    return latest(states, ["tx_id"], ["seq"], ["seq", "decision", "at", "decided_by"])
