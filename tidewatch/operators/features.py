"""The feature set over a payment history, one keyed stage at a time.

The account stages take the rows, shuffle them by account and hand on the same rows with more
columns. What they give is written once; the counterparty, device, agent and cell sweeps each read
only their own few columns of it, since their keys are few and large, and their answers are joined
to the rows by row number. No history is joined to itself.

Rules shared by all stages: a window W at time t is the open interval (t - W, t); simultaneous rows
do not see each other; a label counts only once it is available; reference data is read as of the
payment; missing is NULL, never zero and never NaN.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions import clock
from tidewatch.functions.geo import corridor_class, haversine_km
from tidewatch.operators.hotkeys import HotKeys
from tidewatch.operators.running import (
    Agg,
    Delta,
    Trailing,
    distinct_deltas,
    label_deltas,
    sweep,
    trailing,
)
from tidewatch.plans.registry import (
    CASH_OUT_CODES,
    CHANNELS,
    FEATURES,
    KYC_TIERS,
    LIMIT_BAND,
    MAX_SPEED_KMH,
    micros,
)
from tidewatch.session import cut, dealt, stored, tasks_for

DAY_US = 86_400_000_000.0
#: Static facts are placed before any payment, so every row of the key sees them.
_BEGINNING = -(2**52)



def _span(name: str) -> int:
    return FEATURES[name].span


# ---- account ------------------------------------------------------------------------------------


def account_history(p: DataFrame, hot: HotKeys | None = None) -> DataFrame:
    """Velocity, sums, recency and the last place: all trailing aggregates of the account.

    Adds working columns (prefixed ``_``) that later stages read. One shuffle by account.
    """
    split = hot.split("account") if hot else None
    one = F.lit(1).cast("long")
    windows = {
        "tx_count_60s": Trailing(one, _span("tx_count_60s")),
        "tx_count_1h": Trailing(one, _span("tx_count_1h")),
        "tx_count_24h": Trailing(one, _span("tx_count_24h")),
        "tx_count_7d": Trailing(one, _span("tx_count_7d")),
        "_n_30d": Trailing(one, micros("30d")),
        "_sum_24h": Trailing(F.col("amount"), _span("amount_sum_24h")),
        "_sum_7d": Trailing(F.col("amount"), _span("amount_sum_7d")),
    }
    last = F.struct((-F.col("t")).alias("t"), F.col("tx_id"), F.col("lat"), F.col("lon"))
    extra = {"_last": Agg("min", last), "_first_t": Agg("min", F.col("t"))}
    out = trailing(p, ["account"], "t", windows, extra, split)
    last_t = -F.col("_last.t")
    km = haversine_km(F.col("_last.lat"), F.col("_last.lon"), F.col("lat"), F.col("lon"))
    speed = km / ((F.col("t") - last_t) / F.lit(3.6e9))
    observed = F.least(F.lit(micros("30d")), F.col("t") - F.coalesce("_first_t", "t"))
    hours = observed / F.lit(3.6e9) - F.lit(1.0)
    mean = F.when(hours > 0, (F.col("_n_30d") - F.col("tx_count_1h")) / hours).otherwise(0.0)
    alpha = F.lit(FEATURES["velocity_ratio_1h_vs_30d"].alpha)
    return (
        out.withColumn("velocity_ratio_1h_vs_30d", (F.col("tx_count_1h") + alpha) / (mean + alpha))
        .withColumn("amount_sum_24h", F.col("_sum_24h").cast("double"))
        .withColumn("amount_sum_7d", F.col("_sum_7d").cast("double"))
        .withColumn("seconds_since_last_tx", (F.col("t") - last_t) / F.lit(1e6))
        .withColumn("distance_from_last_tx_km", km)
        .withColumn(
            "implied_speed_kmh", F.when(speed > MAX_SPEED_KMH, MAX_SPEED_KMH).otherwise(speed)
        )
        .withColumn(
            "dormancy_reactivation_flag",
            F.coalesce(
                last_t <= F.col("t") - F.lit(_span("dormancy_reactivation_flag")), F.lit(False)
            ),
        )
        .drop("_sum_24h", "_sum_7d", "_last", "_first_t")
    )


def pair_history(
    p: DataFrame, member: str, prefix: str, hot: HotKeys | None = None, span: int | None = None
) -> DataFrame:
    """For the pair (account, member): its previous time, and its count over a trailing span.

    Partitions by (account, member), which rows already laid out by account satisfy, so after
    ``account_history`` it sorts without shuffling.
    """
    split = hot.split("account") if hot else None
    keys = ["account", member]
    windows = {f"{prefix}_n": Trailing(F.lit(1).cast("long"), span)} if span else {}
    out = trailing(p, keys, "t", windows, {f"{prefix}_prev": Agg("max", F.col("t"))}, split)
    same_time = Window.partitionBy(*keys, "t")
    return out.withColumn(f"{prefix}_first", F.min("tx_id").over(same_time) == F.col("tx_id"))


def novelty(p: DataFrame, hot: HotKeys | None = None) -> DataFrame:
    """Never-before-used counterparty, country and device of an account, over all its history."""
    out = pair_history(
        p, "counterparty", "_cp", hot, _span("tx_count_to_counterparty_30d")
    )
    out = out.withColumnRenamed("_cp_n", "tx_count_to_counterparty_30d").withColumn(
        "counterparty_is_new_for_account", F.col("_cp_prev").isNull()
    )
    out = pair_history(out, "device", "_dev", hot).withColumn(
        "device_is_new_for_account",
        F.when(F.col("device").isNotNull(), F.col("_dev_prev").isNull()),
    )
    if "counterparty_country" in p.columns:
        out = (
            pair_history(out, "counterparty_country", "_ctry", hot)
            .withColumn("is_new_country_for_account", F.col("_ctry_prev").isNull())
            .drop("_ctry_prev", "_ctry_first")
        )
    return out


def account_sweep(
    p: DataFrame,
    hot: HotKeys | None = None,
    tiers: DataFrame | None = None,
    swaps: DataFrame | None = None,
    profiles: DataFrame | None = None,
    tasks: int | None = None,
) -> DataFrame:
    """Distinct counterparties and devices in 24 h, tier and SIM swap as of the payment, age.

    Reference versions ride through the same shuffle as the rows, or come to where rows lie in ``tasks``
    by account. A tier is in force from its own instant on, so it is placed one microsecond early; a SIM
    swap counts strictly later.
    """
    t, aggs, versions = F.col("t"), {"_ucp": "sum", "_udev": "sum"}, []
    span = _span("unique_counterparties_24h")
    deltas = _when(distinct_deltas(t, F.col("_cp_prev"), span, "_ucp"), F.col("_cp_first"))
    dev_span = _span("device_changes_24h")
    deltas += _when(
        distinct_deltas(t, F.col("_dev_prev"), dev_span, "_udev"),
        F.col("device").isNotNull() & F.col("_dev_first"),
    )
    if tiers is not None:
        # Equal effective times keep the first version: order by time, then by earliest version.
        versions.append(
            tiers.select(
                "account",
                (F.col("effective_at") - 1).alias("at"),
                F.struct("effective_at", (-F.col("version")).alias("v"), "tier").alias("_tier"),
            )
        )
        aggs["_tier"] = "max"
    if swaps is not None:
        versions.append(
            swaps.select("account", F.col("swapped_at").alias("at"), F.col("swapped_at").alias("_swap"))
        )
        aggs["_swap"] = "max"
    if profiles is not None:
        versions.append(_static(profiles, "account", "_opened"))
        aggs["_opened"] = "max"
    split = hot.split("account") if hot else None
    out = sweep(p, "account", "t", deltas, aggs, versions, split, tasks=tasks)
    own_device_seen = F.coalesce(F.col("_dev_prev") > t - F.lit(dev_span), F.lit(False))
    out = out.withColumn(
        "unique_counterparties_24h", F.coalesce(F.col("_ucp"), F.lit(0))
    ).withColumn(
        "device_changes_24h",
        F.when(
            F.col("device").isNotNull(),
            F.coalesce(F.col("_udev"), F.lit(0)) - own_device_seen.cast("long"),
        ),
    )
    if tiers is not None:
        out = out.withColumn("kyc_tier", F.col("_tier.tier"))
    if swaps is not None:
        out = out.withColumn("days_since_sim_swap", (t - F.col("_swap")) / F.lit(DAY_US))
    if profiles is not None:
        out = out.withColumn("account_age_days", (t - F.col("_opened")) / F.lit(DAY_US))
    return out.drop("_ucp", "_udev", "_tier", "_swap")


# ---- counterparty, device, agent, cell ------------------------------------------------------------


def counterparty_sweep(
    p: DataFrame, hot: HotKeys | None = None, profiles: DataFrame | None = None
) -> DataFrame:
    """Distinct senders in 24 h, confirmed fraud in 90 d by availability, age of the recipient."""
    t = F.col("t")
    deltas = _when(
        distinct_deltas(t, F.col("_cp_prev"), _span("counterparty_unique_senders_24h"), "_snd"),
        F.col("_cp_first"),
    )
    deltas += _when(
        label_deltas(
            t, F.col("label_at"), _span("counterparty_confirmed_fraud_90d"),
            {"_fraud": F.lit(1).cast("long")},
        ),
        F.col("is_fraud") & F.col("label_at").isNotNull(),
    )
    aggs, versions = {"_snd": "sum", "_fraud": "sum"}, []
    if profiles is not None:
        versions.append(
            _static(profiles.withColumnRenamed("account", "counterparty"), "counterparty", "_open")
        )
        aggs["_open"] = "max"
    split = hot.split("counterparty") if hot else None
    out = sweep(p, "counterparty", "t", deltas, aggs, versions, split)
    out = out.withColumn(
        "counterparty_unique_senders_24h", F.coalesce(F.col("_snd"), F.lit(0))
    ).withColumn("counterparty_confirmed_fraud_90d", F.coalesce(F.col("_fraud"), F.lit(0)))
    if profiles is not None:
        out = out.withColumn("counterparty_account_age_days", (t - F.col("_open")) / F.lit(DAY_US))
    return out.drop("_snd", "_fraud", "_open")


def device_sweep(p: DataFrame, hot: HotKeys | None = None) -> DataFrame:
    """Accounts sharing the device in 7 d, and the device's age since first seen anywhere."""
    t, span = F.col("t"), _span("accounts_per_device_7d")
    deltas = _when(distinct_deltas(t, F.col("_dev_prev"), span, "_acc"), F.col("_dev_first"))
    deltas.append(Delta(t, {"_seen": t}))
    out = sweep(
        p, "device", "t", deltas, {"_acc": "sum", "_seen": "min"},
        split=hot.split("device") if hot else None, nullable_key=True,
    )
    here = F.col("device").isNotNull()
    own_seen = F.coalesce(F.col("_dev_prev") > t - F.lit(span), F.lit(False))
    return (
        out.withColumn(
            "accounts_per_device_7d",
            F.when(here, F.coalesce(F.col("_acc"), F.lit(0)) + 1 - own_seen.cast("long")),
        )
        .withColumn(
            "device_age_days",
            F.when(here, (t - F.least(F.coalesce(F.col("_seen"), t), t)) / F.lit(DAY_US)),
        )
        .drop("_acc", "_seen")
    )


def agent_sweep(
    p: DataFrame, hot: HotKeys | None = None, standings: DataFrame | None = None
) -> DataFrame:
    """Cash-outs and distinct customers in 1 h at the agent; its float and distance as of then."""
    t, span = F.col("t"), _span("agent_unique_customers_1h")
    cash_span = _span("agent_cashout_count_1h")
    one = F.lit(1).cast("long")
    cash = F.col("mcc").isin(list(CASH_OUT_CODES))
    deltas = _when(distinct_deltas(t, F.col("_agt_prev"), span, "_cust"), F.col("_agt_first"))
    deltas += _when(
        [Delta(t, {"_cash": one}), Delta(t + F.lit(cash_span - 1), {"_cash": -one})], cash
    )
    aggs, versions = {"_cust": "sum", "_cash": "sum"}, []
    if standings is not None:
        versions.append(
            standings.select(
                "agent",
                (F.col("effective_at") - 1).alias("at"),
                F.struct(
                    "effective_at", (-F.col("version")).alias("v"), "balance_cents",
                    "limit_cents", "home_lat", "home_lon",
                ).alias("_std"),
            )
        )
        aggs["_std"] = "max"
    out = sweep(
        p, "agent", "t", deltas, aggs, versions,
        split=hot.split("agent") if hot else None, nullable_key=True,
    )
    here = F.col("agent").isNotNull()
    own_seen = F.coalesce(F.col("_agt_prev") > t - F.lit(span), F.lit(False))
    out = out.withColumn(
        "agent_cashout_count_1h", F.when(here, F.coalesce(F.col("_cash"), F.lit(0)))
    ).withColumn(
        "agent_unique_customers_1h",
        F.when(here, F.coalesce(F.col("_cust"), F.lit(0)) + 1 - own_seen.cast("long")),
    )
    if standings is not None:
        out = out.withColumn(
            "agent_float_utilisation_ratio",
            F.when(here, F.col("_std.balance_cents") / F.col("_std.limit_cents")),
        ).withColumn(
            "agent_distance_from_registered_km",
            F.when(
                here,
                haversine_km(
                    F.col("_std.home_lat"), F.col("_std.home_lon"), F.col("lat"), F.col("lon")
                ),
            ),
        )
    return out.drop("_cust", "_cash", "_std")


def cell_sweep(p: DataFrame, prior: float, hot: HotKeys | None = None) -> DataFrame:
    """Smoothed confirmed-fraud rate of the payment's cell over 30 days of available labels.

    ``prior`` is fitted on training rows by the caller; ``p`` must hold training rows only when the
    feature is computed for training.
    """
    feature = FEATURES["geo_cell_fraud_rate_30d"]
    one = F.lit(1).cast("long")
    deltas = _when(
        label_deltas(
            F.col("t"), F.col("label_at"), feature.span,
            {"_lab": one, "_frd": F.col("is_fraud").cast("long")},
        ),
        F.col("label_at").isNotNull(),
    )
    out = sweep(
        p, "cell", "t", deltas, {"_lab": "sum", "_frd": "sum"},
        split=hot.split("cell") if hot else None,
    )
    alpha = F.lit(feature.alpha)
    rate = (F.coalesce(F.col("_frd"), F.lit(0)) + alpha * F.lit(prior)) / (
        F.coalesce(F.col("_lab"), F.lit(0)) + alpha
    )
    return out.withColumn("geo_cell_fraud_rate_30d", rate).drop("_lab", "_frd")


def agent_pairs(p: DataFrame, hot: HotKeys | None = None) -> DataFrame:
    return pair_history(p, "agent", "_agt", hot)


# ---- features of the row itself --------------------------------------------------------------------


def own_row(p: DataFrame) -> DataFrame:
    """Features that need no history: amount, local time, declared channel."""
    out = p.withColumn("amount_log1p", F.log1p(F.col("amount").cast("double")))
    if "utc_offset_hours" in p.columns:
        local = clock.local_time(F.col("t"), F.col("utc_offset_hours"))
        out = (
            out.withColumn("local_hour_sin", clock.hour_sin(local))
            .withColumn("local_hour_cos", clock.hour_cos(local))
            .withColumn("local_day_of_week", F.weekday(local))
            .withColumn("is_local_night", clock.is_night(local))
            .withColumn("is_month_end_window", clock.is_month_end(local))
        )
    return out


def declared_channel(channel: Column) -> Column:
    """The channel, or an error naming a value outside the declared domain."""
    return F.when(channel.isin(list(CHANNELS)), channel).otherwise(
        F.raise_error(F.concat(F.lit("undeclared channel: "), F.coalesce(channel, F.lit("NULL"))))
    )


def round_sum(p: DataFrame, countries: DataFrame) -> DataFrame:
    """Whether the minor-unit amount is an exact multiple of a denomination of its currency."""
    packs = countries.select("currency", "denominations")
    hit = F.exists("denominations", lambda d: (d > 0) & (F.col("cents") % F.nullif(d, F.lit(0)) == 0))
    return (
        p.join(packs, "currency", "left")
        .withColumn("round_sum_flag", F.coalesce(hit, F.lit(False)))
        .drop("denominations")
    )


def just_below_limit(
    p: DataFrame, limits: DataFrame, tier_limits: DataFrame | None = None
) -> DataFrame:
    """Whether the amount lies in the band just under a limit in force at the payment.

    Limits are configuration: few versions. Each version is given its validity interval, the
    versions of a key are gathered into one array, and the array is looked up by an equi-join.
    """
    out = _limit_hit(p, limits, "channel", "_by_channel")
    flag = F.coalesce(F.col("_by_channel"), F.lit(False))
    if tier_limits is not None:
        out = _limit_hit(out, tier_limits, "kyc_tier", "_by_tier")
        flag = flag | F.coalesce(F.col("_by_tier"), F.lit(False))
    return out.withColumn("just_below_limit_flag", flag).drop("_by_channel", "_by_tier")


def _limit_hit(p: DataFrame, limits: DataFrame, key: str, name: str) -> DataFrame:
    ends = F.lead("effective_at").over(Window.partitionBy(key).orderBy("effective_at"))
    intervals = (
        limits.groupBy(key, "effective_at")
        .agg(F.first("limit_cents").alias("limit_cents"))
        .withColumn("until", ends)
        .groupBy(key)
        .agg(F.collect_list(F.struct("effective_at", "until", "limit_cents")).alias("_iv"))
    )
    low = 1.0 - LIMIT_BAND

    def inside(v: Column) -> Column:
        return (
            (v["effective_at"] <= F.col("t"))
            & (v["until"].isNull() | (F.col("t") < v["until"]))
            & (F.col("cents") >= v["limit_cents"] * F.lit(low))
            & (F.col("cents") < v["limit_cents"])
        )

    return p.join(intervals, key, "left").withColumn(
        name, F.exists("_iv", inside)
    ).drop("_iv")


def corridors(p: DataFrame, countries: DataFrame) -> DataFrame:
    """Class of the corridor between the sender's and the recipient's country."""
    facts = countries.select("country", "blocs", "continent")
    home = facts.select(
        F.col("country"), F.col("blocs").alias("_hb"), F.col("continent").alias("_hc")
    )
    away = facts.select(
        F.col("country").alias("counterparty_country"),
        F.col("blocs").alias("_ab"),
        F.col("continent").alias("_ac"),
    )
    klass = corridor_class(
        F.col("country"), F.col("_hb"), F.col("_hc"), F.col("counterparty_country"),
        F.col("_ab"), F.col("_ac"),
    )
    known = F.col("_hc").isNotNull() & F.col("_ac").isNotNull()
    return (
        p.join(home, "country", "left")
        .join(away, "counterparty_country", "left")
        .withColumn("corridor_class", F.when(known, klass))
        .drop("_hb", "_hc", "_ab", "_ac")
    )


def synthetic_identity(p: DataFrame) -> DataFrame:
    """Mean of four bits of evidence in [0, 1]; evidence that is missing adds nothing."""
    low, high = KYC_TIERS
    even = 7.0 / 30.0

    def unit(c: Column) -> Column:
        return F.when(c > 1.0, 1.0).when(c > 0.0, c).otherwise(0.0)

    tier = unit((F.lit(high) - F.col("kyc_tier")) / F.lit(float(high - low)))
    young = F.coalesce((F.col("account_age_days") < 30).cast("double"), F.lit(0.0))
    sharing = unit((F.col("accounts_per_device_7d") - 1) / F.lit(2.0))
    share = F.col("tx_count_7d") / F.nullif(F.col("_n_30d"), F.lit(0))
    ramp = unit((share - F.lit(even)) / F.lit(1.0 - even))
    return p.withColumn("synthetic_identity_score", (tier + young + sharing + ramp) / F.lit(4.0))


# ---- the whole vector ------------------------------------------------------------------------------

#: What each sweep reads beside its key and the time.
_SWEPT = {
    "counterparty": ["_cp_prev", "_cp_first", "is_fraud", "label_at"],
    "device": ["_dev_prev", "_dev_first"],
    "agent": ["_agt_prev", "_agt_first", "mcc", "lat", "lon"],
    "cell": ["is_fraud", "label_at"],
}


def feature_matrix(
    p: DataFrame,
    *,
    prior: float,
    countries: DataFrame,
    limits: DataFrame,
    tiers: DataFrame,
    swaps: DataFrame,
    profiles: DataFrame,
    standings: DataFrame,
    hot: HotKeys | None = None,
    keep: list[str] | None = None,
) -> DataFrame:
    """All features of every payment, in contract order, next to ``tx_id`` and ``keep``."""
    from tidewatch.operators.quantiles import amount_and_home

    def stage(df: DataFrame, key: str) -> DataFrame:
        # A split stage reads its input twice, once for the bucket totals: end the lineage first.
        return cut(df) if hot and hot.split(key) else df

    rows = round_sum(corridors(own_row(p), countries), countries)
    size = p.count()
    rows = dealt(stage(rows, "account"), "account", size)
    rows = novelty(account_history(rows, hot), hot)
    rows = agent_pairs(rows, hot)
    # A split account is laid out by its buckets, so nothing lies by account then.
    tasks = None if hot and hot.split("account") else tasks_for(p.sparkSession, size)
    rows = account_sweep(stage(rows, "account"), hot, tiers, swaps, profiles, tasks)
    wanted = {"tx_id", *(keep or []), *FEATURES, "cents", "_n_30d", "t", *_SWEPT, *(c for needs in _SWEPT.values() for c in needs)}
    rows = rows.select(*[c for c in rows.columns if c in wanted])
    # Numbers made while writing stay what they are: ids of payments may repeat or be missing.
    rows = stored(rows.withColumn("__row", F.monotonically_increasing_id()), "accounts")

    def swept(key: str, sweep_of: Callable[[DataFrame], DataFrame]) -> DataFrame:
        needs = ["__row", "t", key, *_SWEPT[key]]
        out = sweep_of(rows.select(*needs))
        return out.drop(*[c for c in needs if c != "__row"])

    answers = [
        swept("counterparty", lambda p: counterparty_sweep(p, hot, profiles)),
        # A row without a device or agent has no answer.
        swept("device", lambda p: device_sweep(p.filter("device is not null"), hot)),
        swept("agent", lambda p: agent_sweep(p.filter("agent is not null"), hot, standings)),
        swept("cell", lambda p: cell_sweep(p, prior, hot)),
        # Found by payment, handed on by row: the wide rows are shuffled by row alone.
        rows.select("__row", "tx_id").join(amount_and_home(p, hot), "tx_id").drop("tx_id"),
    ]
    rows = dealt(rows, "__row", rows.count())  # the count stands in the file footers
    for answer in answers:
        rows = rows.join(answer, "__row", "left")
    rows = just_below_limit(synthetic_identity(rows), limits)
    rows = rows.withColumn("channel", declared_channel(F.col("channel")))
    return assemble(rows, ["tx_id", *(keep or [])])


def assemble(rows: DataFrame, ids: list[str]) -> DataFrame:
    """Contract order and types; a registered feature without a column is an error."""
    missing = [name for name in FEATURES if name not in rows.columns]
    if missing:
        raise ValueError(f"features without a column: {missing}")
    extra = [c for c in ids if c not in FEATURES]
    return rows.select(*extra, *[F.col(f.name).cast(f.dtype) for f in FEATURES.values()])


def _static(profiles: DataFrame, key: str, name: str) -> DataFrame:
    return profiles.filter(F.col("opened_at").isNotNull()).select(
        key, F.lit(_BEGINNING).cast("long").alias("at"), F.col("opened_at").alias(name)
    )


def _when(deltas: list[Delta], condition: Column) -> list[Delta]:
    return [
        Delta(d.at, d.measures, condition if d.when is None else d.when & condition)
        for d in deltas
    ]
