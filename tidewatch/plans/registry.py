"""What each feature promises: type, trailing window, key. The builders read their spans from here."""

from __future__ import annotations

from dataclasses import dataclass

_UNIT = {"s": 1, "m": 60, "h": 3_600, "d": 86_400}


def micros(window: str) -> int:
    """'60s', '1h', '30d' as microseconds."""
    return int(window[:-1]) * _UNIT[window[-1]] * 1_000_000


@dataclass(frozen=True)
class Feature:
    name: str
    dtype: str
    window: str | None = None
    key: str = "account"
    minimum_history: int = 0
    alpha: float | None = None

    @property
    def span(self) -> int:
        if self.window is None or self.window == "unbounded":
            raise ValueError(f"{self.name} has no single trailing window")
        return micros(self.window)


# Feature names, types and windows are the public contract of the feature set.
FEATURES: dict[str, Feature] = {
    f.name: f
    for f in (
        Feature("velocity_ratio_1h_vs_30d", "double", "30d", alpha=1.0),
        Feature("tx_count_60s", "long", "60s"),
        Feature("tx_count_1h", "long", "1h"),
        Feature("tx_count_24h", "long", "24h"),
        Feature("tx_count_7d", "long", "7d"),
        Feature("amount_sum_24h", "double", "24h"),
        Feature("amount_sum_7d", "double", "7d"),
        Feature("unique_counterparties_24h", "long", "24h"),
        Feature("amount_log1p", "double"),
        Feature("amount_zscore_90d", "double", "90d", minimum_history=5),
        Feature("amount_to_max_90d_ratio", "double", "90d", minimum_history=1),
        Feature("round_sum_flag", "boolean"),
        Feature("just_below_limit_flag", "boolean"),
        Feature("local_hour_sin", "double"),
        Feature("local_hour_cos", "double"),
        Feature("local_day_of_week", "int"),
        Feature("is_local_night", "boolean"),
        Feature("is_month_end_window", "boolean"),
        Feature("seconds_since_last_tx", "double", "unbounded"),
        Feature("distance_from_last_tx_km", "double", "unbounded"),
        Feature("implied_speed_kmh", "double", "unbounded"),
        Feature("distance_from_home_centroid_km", "double", "90d", minimum_history=1),
        Feature("is_new_country_for_account", "boolean", "unbounded"),
        Feature("geo_cell_fraud_rate_30d", "double", "30d", "cell", alpha=50.0),
        Feature("counterparty_is_new_for_account", "boolean", "unbounded"),
        Feature("counterparty_account_age_days", "double", None, "counterparty"),
        Feature("counterparty_unique_senders_24h", "long", "24h", "counterparty"),
        Feature("counterparty_confirmed_fraud_90d", "long", "90d", "counterparty"),
        Feature("tx_count_to_counterparty_30d", "long", "30d"),
        Feature("channel", "string"),
        Feature("device_is_new_for_account", "boolean", "unbounded"),
        Feature("accounts_per_device_7d", "long", "7d", "device"),
        Feature("device_changes_24h", "long", "24h"),
        Feature("device_age_days", "double", "unbounded", "device"),
        Feature("account_age_days", "double"),
        Feature("kyc_tier", "int"),
        Feature("days_since_sim_swap", "double"),
        Feature("dormancy_reactivation_flag", "boolean", "60d", minimum_history=1),
        Feature("agent_float_utilisation_ratio", "double", None, "agent"),
        Feature("agent_cashout_count_1h", "long", "1h", "agent"),
        Feature("agent_unique_customers_1h", "long", "1h", "agent"),
        Feature("agent_distance_from_registered_km", "double", None, "agent"),
        Feature("corridor_class", "string"),
        Feature("synthetic_identity_score", "double", "30d"),
    )
}

# Category domains and numeric constants of the feature set.
CHANNELS = ("MOBILE_MONEY", "USSD", "AGENT_BANKING", "CARD", "ONLINE", "BANK_TRANSFER")
CORRIDORS = ("DOMESTIC", "INTRA_BLOC", "CROSS_BLOC_AFRICA", "INTERCONTINENTAL")
EARTH_RADIUS_KM = 6371.0088
MAD_TO_SIGMA = 1.4826
LIMIT_BAND = 0.05
MAX_SPEED_KMH = 1000.0
CELL_DEGREES = 0.05
CASH_OUT_CODES = ("6011",)
KYC_TIERS = (1, 3)

DEVICE_FEATURES = (
    "device_is_new_for_account",
    "accounts_per_device_7d",
    "device_changes_24h",
    "device_age_days",
)
AGENT_FEATURES = (
    "agent_float_utilisation_ratio",
    "agent_cashout_count_1h",
    "agent_unique_customers_1h",
    "agent_distance_from_registered_km",
)


def trainable() -> list[str]:
    """Numeric and boolean features in contract order; categories are encoded separately."""
    return [f.name for f in FEATURES.values() if f.dtype != "string"]
