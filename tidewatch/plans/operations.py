"""Operational tables of the platform, derived row by row from payments.

Scores and their revisions, decision states, label events, alerts and what analysts did with them,
hold policies, explanations, audit rows. Each is a projection, so it grows with the payments.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.plans.tables import DAY, EPOCH, SECOND, read

EXPLAINED = (
    "amount_zscore_90d",
    "counterparty_confirmed_fraud_90d",
    "device_is_new_for_account",
    "is_local_night",
    "tx_count_1h",
    "velocity_ratio_1h_vs_30d",
)


def _k() -> Column:
    return F.col("k")


def _cents() -> Column:
    return F.col("cents")


def second_score() -> Column:
    """A second model's score of the same payment."""
    raised = F.when(F.col("channel") == "CARD", 5000).otherwise(0)
    return (((_k() * 53 + _cents() * 7) % 1000) * 5 + raised).cast("double") / F.lit(10000.0)


def anomaly_score() -> Column:
    return ((_k() * 11 + _cents() * 3) % 1000).cast("double") / F.lit(1000.0)


def institution() -> Column:
    return F.concat(F.lit("I"), (F.col("account") % 4).cast("string"))


def scores(p: DataFrame) -> DataFrame:
    """One score per payment, a revised one for every fifth counterparty."""
    first = F.struct(
        F.lit(1).alias("revision"), F.col("t").alias("scored_at"), F.col("score").alias("score")
    )
    second = F.struct(
        F.lit(2).alias("revision"), (F.col("t") + SECOND).alias("scored_at"),
        second_score().alias("score"),
    )
    both = F.array_compact(F.array(first, F.when(_k() % 5 == 0, second)))
    return p.select(
        "tx_id", "account", "channel", institution().alias("institution"),
        anomaly_score().alias("anomaly"), (_cents() % 50 == 0).alias("fallback"),
        F.explode(both).alias("s"),
    ).select("tx_id", "account", "channel", "institution", "anomaly", "fallback", "s.*")


def tier_of(score: Column, medium: float = 0.60, high: float = 0.85) -> Column:
    return F.when(score >= high, "HIGH").when(score >= medium, "MEDIUM").otherwise("LOW")


def decision_states(p: DataFrame) -> DataFrame:
    """(tx_id, seq, decision, at, decided_by): holds are answered by an analyst or left open."""
    tier = tier_of(F.col("score"))
    first = F.when(tier == "HIGH", "DECLINE").when(tier == "MEDIUM", "HOLD").otherwise("APPROVE")
    start = F.struct(
        F.lit(1).alias("seq"), first.alias("decision"), (F.col("t") + SECOND).alias("at"),
        F.lit("SYSTEM").alias("decided_by"),
    )
    answer = F.struct(
        F.lit(2).alias("seq"),
        F.when(_k() % 3 == 0, "APPROVE").otherwise("DECLINE").alias("decision"),
        (F.col("t") + SECOND + _cents() * 100_000).alias("at"),
        F.lit("ANALYST").alias("decided_by"),
    )
    reversal = F.struct(
        F.lit(2).alias("seq"), F.lit("APPROVE").alias("decision"),
        (F.col("t") + DAY).alias("at"), F.lit("CUSTOMER_VERIFICATION").alias("decided_by"),
    )
    items = F.array_compact(
        F.array(
            start,
            F.when((tier == "MEDIUM") & (_k() % 3 != 2), answer),
            F.when((tier == "HIGH") & (_k() % 4 == 0), reversal),
        )
    )
    return p.select("tx_id", "account", "channel", F.explode(items).alias("s")).select(
        "tx_id", "account", "channel", "s.*"
    )


def label_events(p: DataFrame) -> DataFrame:
    """(tx_id, label_id, label, label_at): some labels are corrected at the very same instant."""
    def one(i: int, label: Column) -> Column:
        return F.struct(
            (F.col("tx_id") * 2 + i).alias("label_id"), label.alias("label"), F.col("label_at")
        )

    fraud = F.when(F.col("is_fraud"), "FRAUD").otherwise("LEGITIMATE")
    flipped = F.when(F.col("is_fraud"), "LEGITIMATE").otherwise("FRAUD")
    items = F.array_compact(F.array(one(0, fraud), F.when(_k() % 6 == 0, one(1, flipped))))
    return p.select("tx_id", "account", "t", F.explode(items).alias("l")).select(
        "tx_id", "account", "t", "l.*"
    )


def alerts(p: DataFrame) -> DataFrame:
    """One alert per payment that is not plainly approved."""
    tier = tier_of(F.col("score"))
    shown = F.when(tier != "LOW", tier).when(anomaly_score() >= 0.95, "ANOMALY")
    escalated = _k() % 9 == 0
    return p.select(
        F.col("tx_id").alias("alert_id"), "tx_id", "account", "channel", "amount", "cents", "k", "t",
        F.col("score").alias("fraud_probability"), anomaly_score().alias("anomaly"),
        institution().alias("institution"), shown.alias("tier"),
        F.when(_k() % 4 == 0, "PENDING").when(_k() % 4 == 1, "IN_REVIEW").otherwise("DECIDED").alias("status"),
        (_k() % 7).alias("analyst_id"),
        F.when(escalated, F.when(_cents() % 2 == 0, "SENIOR_ANALYST").otherwise("RISK_OFFICER")).alias(
            "target_role"
        ),
        F.when(escalated, F.col("tx_id")).alias("escalated_from"),
        F.col("t").alias("created_at"),
    ).filter(F.col("tier").isNotNull())


def alert_decisions(p: DataFrame) -> DataFrame:
    """What analysts decided, with its duration."""
    return alerts(p).filter("status = 'DECIDED'").select(
        F.col("alert_id").alias("decision_id"), "alert_id", "tx_id", "analyst_id", "tier", "cents",
        F.when(F.col("escalated_from").isNotNull(), "ESCALATE")
        .when(F.col("k") % 3 == 0, "CONFIRM_FRAUD")
        .otherwise("MARK_LEGITIMATE")
        .alias("decision"),
        (F.col("cents") % 1800).alias("duration_s"),
        (F.col("t") + (F.col("cents") % 1800) * SECOND).alias("created_at"), "k",
    )


def decision_commits(p: DataFrame) -> DataFrame:
    return alert_decisions(p).filter("k % 5 <> 2").select(
        "decision_id", (F.col("created_at") + 60 * SECOND).alias("committed_at")
    )


def decision_undos(p: DataFrame) -> DataFrame:
    return alert_decisions(p).filter("k % 10 = 2").select(
        "decision_id", (F.col("created_at") + 30 * SECOND).alias("undone_at")
    )


def hold_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions of what happens to a hold nobody answered."""
    r = F.col("r_regionkey").cast("long")
    return read(spark, sf_dir, "region").select(
        r.alias("version"), (F.lit(EPOCH) + (r + 1) * F.lit(5 * DAY)).alias("effective_at"),
        F.when(r % 2 == 0, "DECLINE_AND_VERIFY").otherwise("RELEASE_WITH_TIMEOUT_LABEL").alias("policy"),
        F.lit(0).alias("scope"),
    )


def contributions(p: DataFrame) -> DataFrame:
    """Signed contributions of six features to each payment's margin."""
    items = []
    for i, name in enumerate(EXPLAINED):
        shap = ((_k() * (7 + i) + _cents() * (3 + 2 * i)) % 2001 - 1000).cast("double") / F.lit(1000.0)
        items.append(F.struct(F.lit(name).alias("feature"), shap.alias("shap")))
    return p.select(
        "tx_id", "channel", "score", F.array(*items).alias("contributions"),
        (_k() % 10 != 0).alias("explained"), (_cents() % 50 == 0).alias("fallback"),
    )


def audit_rows(p: DataFrame) -> DataFrame:
    """Audit events of eight writers, numbered per writer by the payment's id."""
    content = F.concat_ws("|", "tx_id", "account", "cents", "channel")
    return p.select(
        (F.col("tx_id") % 8).alias("writer"), F.expr("tx_id div 8 + 1").alias("seq"),
        F.col("t").alias("event_at"), (F.col("account") % 12).alias("user_id"),
        F.col("channel").alias("event_type"), F.col("tx_id").alias("entity_id"),
        content.alias("content"), "cents",
    )
