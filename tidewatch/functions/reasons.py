"""Reason codes: from a feature's name, merged by priority, and the summary shown to a reader."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The reason group of every feature.
REASON_OF = {
    "velocity_ratio_1h_vs_30d": "VELOCITY_SPIKE",
    "tx_count_60s": "VELOCITY_SPIKE",
    "tx_count_1h": "VELOCITY_SPIKE",
    "tx_count_24h": "VELOCITY_SPIKE",
    "tx_count_7d": "VELOCITY_SPIKE",
    "unique_counterparties_24h": "MANY_COUNTERPARTIES",
    "amount_sum_24h": "HIGH_RECENT_VOLUME",
    "amount_sum_7d": "HIGH_RECENT_VOLUME",
    "amount_log1p": "AMOUNT_ABOVE_NORMAL",
    "amount_zscore_90d": "AMOUNT_ABOVE_NORMAL",
    "amount_to_max_90d_ratio": "AMOUNT_ABOVE_NORMAL",
    "round_sum_flag": "ROUND_AMOUNT",
    "just_below_limit_flag": "JUST_BELOW_LIMIT",
    "local_hour_sin": "UNUSUAL_HOUR",
    "local_hour_cos": "UNUSUAL_HOUR",
    "local_day_of_week": "UNUSUAL_HOUR",
    "is_local_night": "UNUSUAL_HOUR",
    "is_month_end_window": "MONTH_END_PATTERN",
    "seconds_since_last_tx": "RAPID_SUCCESSION",
    "distance_from_last_tx_km": "UNUSUAL_LOCATION",
    "distance_from_home_centroid_km": "UNUSUAL_LOCATION",
    "implied_speed_kmh": "IMPLAUSIBLE_TRAVEL",
    "is_new_country_for_account": "NEW_COUNTRY",
    "geo_cell_fraud_rate_30d": "HIGH_RISK_AREA",
    "counterparty_is_new_for_account": "NEW_COUNTERPARTY",
    "counterparty_account_age_days": "NEW_COUNTERPARTY_ACCOUNT",
    "counterparty_unique_senders_24h": "MULE_PATTERN",
    "counterparty_confirmed_fraud_90d": "COUNTERPARTY_FRAUD_HISTORY",
    "tx_count_to_counterparty_30d": "COUNTERPARTY_PATTERN",
    "channel": "CHANNEL_RISK",
    "device_is_new_for_account": "NEW_DEVICE",
    "accounts_per_device_7d": "SHARED_DEVICE",
    "device_changes_24h": "DEVICE_CHANGES",
    "device_age_days": "NEW_DEVICE",
    "account_age_days": "NEW_ACCOUNT",
    "kyc_tier": "LOW_KYC_TIER",
    "days_since_sim_swap": "RECENT_SIM_SWAP",
    "dormancy_reactivation_flag": "DORMANT_REACTIVATION",
    "agent_float_utilisation_ratio": "AGENT_RISK",
    "agent_cashout_count_1h": "AGENT_RISK",
    "agent_unique_customers_1h": "AGENT_RISK",
    "agent_distance_from_registered_km": "AGENT_RISK",
    "corridor_class": "CROSS_BORDER",
    "synthetic_identity_score": "SYNTHETIC_IDENTITY",
}
MODEL_RISK = "MODEL_RISK_SCORE"
MAX_REASONS = 3


def reason_of(feature: Column) -> Column:
    pairs = [F.lit(x) for kv in REASON_OF.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), feature), F.lit(MODEL_RISK))


def ranked(contributions: Column) -> Column:
    """Contributions by descending size, ties by feature name."""
    return F.transform(
        F.array_sort(
            F.transform(
                contributions,
                lambda c: F.struct(
                    (-F.abs(c["shap"])).alias("o"), c["feature"].alias("feature"), c["shap"].alias("shap")
                ),
            )
        ),
        lambda c: F.struct(c["feature"].alias("feature"), c["shap"].alias("shap")),
    )


def top(contributions: Column, n: int = 5) -> Column:
    return F.slice(ranked(contributions), 1, n)


def model_reasons(contributions: Column) -> Column:
    """Reason codes of the contributions that raise the risk, strongest first."""
    raising = F.filter(ranked(contributions), lambda c: c["shap"] > 0)
    return F.array_distinct(F.transform(raising, lambda c: reason_of(c["feature"])))


def merge(*lists: Column) -> Column:
    """Lists in order of priority, without repeats, the first three."""
    return F.slice(F.array_distinct(F.concat(*lists)), 1, MAX_REASONS)


def summary_key(tier: Column, fallback: Column, contributions: Column) -> Column:
    strongest = F.try_element_at(ranked(contributions), F.lit(1))["feature"]
    return (
        F.when(fallback, "summary.rule_fallback")
        .when(tier == "ANOMALY", "summary.anomaly")
        .when(F.size(contributions) == 0, "summary.model")
        .otherwise(F.concat(F.lit("summary."), strongest))
    )


def outcome(decision: Column) -> Column:
    """What a reader is told about a payment, from its latest decision state."""
    return (
        F.when(decision.isin("APPROVE", "TIMEOUT_RELEASE"), "APPROVED")
        .when(decision == "DECLINE", "BLOCKED")
        .otherwise("PENDING")
    )
