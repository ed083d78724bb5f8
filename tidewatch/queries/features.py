"""One query per feature, each running only the stage it needs, and the whole vector."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.operators import features as ft
from tidewatch.operators.hotkeys import HotKeys, find_hot_keys
from tidewatch.operators.quantiles import amount_and_home
from tidewatch.plans import tables
from tidewatch.plans.registry import FEATURES, micros
from tidewatch.queries.registry import query
from tidewatch.queries.views import EPOCH, haversine, sql
from tidewatch.session import stored

KEYS = ["account", "counterparty", "device", "agent", "cell", "score"]
_HOT: dict[tuple[str, ...], HotKeys] = {}


def hot_keys(spark, sf_dir: str, p: DataFrame) -> HotKeys:
    """Found once for the files that the rows come from: a layout hint, read from a hash sample."""
    files = tuple(sorted(p.inputFiles()))
    if files not in _HOT:
        _HOT[files] = find_hot_keys(p, KEYS, "tx_id")
    return _HOT[files]


def _out(df: DataFrame, name: str) -> DataFrame:
    value: Column = F.col(name)
    if FEATURES[name].dtype == "double":
        value = F.round(value.cast("double"), 6)
    return df.select("tx_id", value.alias(name))


def prior(p: DataFrame) -> float:
    """Fraud rate of the training period, the first twenty days."""
    train = p.filter(F.col("t") < EPOCH + 20 * tables.DAY)
    row = train.agg(F.sum(F.col("is_fraud").cast("long")).alias("f"), F.count("*").alias("n")).first()
    return row["f"] / max(row["n"], 1)


_COLUMNS = ["tx_id", "account", "t"]


def _account(name):
    def run(spark, sf):
        p = tables.payments(spark, sf)
        hot = hot_keys(spark, sf, p)
        return _out(ft.account_history(p, hot), name)

    return run


def _own(name):
    def run(spark, sf):
        p = tables.with_countries(tables.payments(spark, sf), spark, sf)
        return _out(ft.own_row(p), name)

    return run


def _novel(name):
    def run(spark, sf):
        p = tables.payments(spark, sf)
        if name == "is_new_country_for_account":
            p = tables.with_countries(p, spark, sf)
        return _out(ft.novelty(p, hot_keys(spark, sf, tables.payments(spark, sf))), name)

    return run


def _staged(name):
    """Sweeps: the pair history they need, then the one sweep."""

    def run(spark, sf):
        p = tables.payments(spark, sf)
        hot = hot_keys(spark, sf, p)
        prof = tables.profiles(spark, sf)
        key = FEATURES[name].key
        if key == "counterparty":
            rows = p.select(*_COLUMNS, "counterparty", "is_fraud", "label_at")
            rows = ft.pair_history(rows, "counterparty", "_cp", hot)
            return _out(ft.counterparty_sweep(rows, hot, prof), name)
        if key == "device":
            rows = ft.pair_history(p.select(*_COLUMNS, "device"), "device", "_dev", hot)
            return _out(ft.device_sweep(rows, hot), name)
        if key == "agent":
            rows = ft.agent_pairs(p.select(*_COLUMNS, "agent", "mcc", "lat", "lon"), hot)
            return _out(ft.agent_sweep(rows, hot, tables.standings(spark, sf)), name)
        if key == "cell":
            rows = p.select("tx_id", "cell", "t", "is_fraud", "label_at")
            return _out(ft.cell_sweep(rows, prior(p), hot), name)
        rows = p.select(*_COLUMNS, "counterparty", "device")
        rows = ft.pair_history(rows, "counterparty", "_cp", hot)
        rows = ft.pair_history(rows, "device", "_dev", hot)
        return _out(
            ft.account_sweep(
                rows, hot, tables.tiers(spark, sf), tables.sim_swaps(spark, sf), prof
            ),
            name,
        )

    return run


def _spread(name):
    def run(spark, sf):
        p = tables.payments(spark, sf)
        return _out(amount_and_home(p, hot_keys(spark, sf, p)), name)

    return run


def _w(span: str, key: str = "account") -> str:
    return f"(PARTITION BY {key} ORDER BY t RANGE BETWEEN {micros(span) - 1} PRECEDING AND 1 PRECEDING)"


_PREV = "max(t) OVER (PARTITION BY account ORDER BY t RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


def _count(name, span, key="account"):
    return sql(f"SELECT tx_id, count(*) OVER {_w(span, key)} AS {name} FROM payments", "payments")


def _sum(name, span):
    return sql(
        f"SELECT tx_id, round(CAST(coalesce(sum(amount) OVER {_w(span)}, 0) AS DOUBLE), 6) AS {name} FROM payments",
        "payments",
    )


def _local(name, expr):
    return sql(
        f"""SELECT tx_id, {expr} AS {name} FROM (
  SELECT tx_id, make_timestamp(t + utc_offset_hours * 3600000000) AS lt FROM located)""",
        "located",
    )


def _new(name, member, table="payments", null_if="FALSE"):
    return sql(
        f"""SELECT tx_id, CASE WHEN NOT ({null_if}) THEN
  count(*) OVER (PARTITION BY account, {member} ORDER BY t
    RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) = 0 END AS {name} FROM {table}""",
        table,
    )


_LAST = """last_place AS (
  SELECT p.tx_id, p.t, p.lat, p.lon, q.t AS pt, q.lat AS plat, q.lon AS plon
  FROM payments p ASOF LEFT JOIN (
    SELECT account, t, arg_min(lat, tx_id) AS lat, arg_min(lon, tx_id) AS lon
    FROM payments GROUP BY account, t) q
  ON p.account = q.account AND p.t > q.t)"""

_KM = haversine("plat", "plon", "lat", "lon")
_STATS = f"""stats AS (SELECT tx_id, CAST(amount AS DOUBLE) AS x, lat, lon,
  count(*) OVER w AS n, median(CAST(amount AS DOUBLE)) OVER w AS med,
  mad(CAST(amount AS DOUBLE)) OVER w AS mad, max(CAST(amount AS DOUBLE)) OVER w AS top,
  median(lat) OVER w AS mlat, median(lon) OVER w AS mlon
  FROM payments WINDOW w AS {_w("90d")})"""


def _labels(key, span, measure):
    """Rows of the key inside the window whose label was available, per scored row."""
    return f"""SELECT p.tx_id, {measure} AS v FROM payments p LEFT JOIN payments h
  ON h.{key} = p.{key} AND h.t < p.t AND h.t > p.t - {micros(span)} AND h.label_at < p.t
  GROUP BY p.tx_id"""


def _shared(name, key, span):
    return sql(
        f"""SELECT p.tx_id, CASE WHEN p.{key} IS NOT NULL THEN
  count(DISTINCT h.account) + 1 - max(CASE WHEN h.account = p.account THEN 1 ELSE 0 END) END AS {name}
FROM payments p LEFT JOIN payments h ON h.{key} = p.{key} AND h.t < p.t AND h.t > p.t - {micros(span)}
GROUP BY p.tx_id, p.{key}""",
        "payments",
    )


_STAND = """standing AS (SELECT p.*, v.balance_cents, v.limit_cents, v.home_lat, v.home_lon
  FROM payments p ASOF LEFT JOIN standings v ON p.agent = v.agent AND p.t >= v.effective_at)"""


def _age(name, key):
    return sql(
        f"""SELECT tx_id, round((t - opened_at) / 86400000000.0::DOUBLE, 6) AS {name}
FROM payments p LEFT JOIN profiles f ON f.account = p.{key}""",
        "payments",
        "profiles",
    )


_TIER = """tiered AS (SELECT p.*, v.tier AS kyc_tier FROM payments p
  ASOF LEFT JOIN tiers v ON p.account = v.account AND p.t >= v.effective_at)"""

_SPECS: dict[str, tuple] = {
    "velocity_ratio_1h_vs_30d": (
        _account,
        sql(
            f"""SELECT tx_id, round((n1 + 1.0) / (CASE WHEN hours > 0 THEN (n30 - n1) / hours ELSE 0 END + 1.0), 6)
  AS velocity_ratio_1h_vs_30d FROM (
  SELECT tx_id, count(*) OVER {_w("1h")} AS n1, count(*) OVER {_w("30d")} AS n30,
    least({micros("30d")}, t - min(t) OVER (PARTITION BY account)) / 3.6e9::DOUBLE - 1.0::DOUBLE AS hours
  FROM payments)""",
            "payments",
        ),
    ),
    "tx_count_60s": (_account, _count("tx_count_60s", "60s")),
    "tx_count_1h": (_account, _count("tx_count_1h", "1h")),
    "tx_count_24h": (_account, _count("tx_count_24h", "24h")),
    "tx_count_7d": (_account, _count("tx_count_7d", "7d")),
    "amount_sum_24h": (_account, _sum("amount_sum_24h", "24h")),
    "amount_sum_7d": (_account, _sum("amount_sum_7d", "7d")),
    "unique_counterparties_24h": (
        _staged,
        sql(
            f"SELECT tx_id, count(DISTINCT counterparty) OVER {_w('24h')} AS unique_counterparties_24h FROM payments",
            "payments",
        ),
    ),
    "amount_log1p": (
        _own,
        sql("SELECT tx_id, round(ln(1 + CAST(amount AS DOUBLE)), 6) AS amount_log1p FROM payments", "payments"),
    ),
    "amount_zscore_90d": (
        _spread,
        sql(
            "SELECT tx_id, CASE WHEN n >= 5 AND mad > 0 THEN round((x - med) / (1.4826::DOUBLE * mad), 6) END"
            " AS amount_zscore_90d FROM stats",
            "payments",
            then=_STATS,
        ),
    ),
    "amount_to_max_90d_ratio": (
        _spread,
        sql(
            "SELECT tx_id, CASE WHEN top > 0 THEN round(x / top, 6) END AS amount_to_max_90d_ratio FROM stats",
            "payments",
            then=_STATS,
        ),
    ),
    "round_sum_flag": (
        lambda name: lambda spark, sf: _out(
            ft.round_sum(
                tables.with_countries(tables.payments(spark, sf), spark, sf), tables.countries(spark, sf)
            ),
            name,
        ),
        sql(
            """SELECT tx_id, cents % d1 = 0 OR cents % d2 = 0 AS round_sum_flag
FROM located l JOIN countries c ON c.currency = l.currency""",
            "located",
        ),
    ),
    "just_below_limit_flag": (
        lambda name: lambda spark, sf: _out(
            ft.just_below_limit(tables.payments(spark, sf), tables.limits(spark, sf)), name
        ),
        sql(
            """SELECT tx_id, EXISTS (SELECT 1 FROM limits v WHERE v.channel = p.channel
  AND v.effective_at <= p.t AND (v.until IS NULL OR p.t < v.until)
  AND p.cents >= v.limit_cents * 0.95::DOUBLE AND p.cents < v.limit_cents) AS just_below_limit_flag
FROM payments p""",
            "payments",
            "limits",
        ),
    ),
    "local_hour_sin": (_own, _local("local_hour_sin", "round(sin(2 * pi() * hour(lt) / 24.0::DOUBLE), 6) + 0.0::DOUBLE")),
    "local_hour_cos": (_own, _local("local_hour_cos", "round(cos(2 * pi() * hour(lt) / 24.0::DOUBLE), 6) + 0.0::DOUBLE")),
    "local_day_of_week": (_own, _local("local_day_of_week", "CAST(isodow(lt) - 1 AS INTEGER)")),
    "is_local_night": (_own, _local("is_local_night", "hour(lt) < 5")),
    "is_month_end_window": (
        _own,
        _local("is_month_end_window", "day(lt) <= 2 OR day(lt) > day(last_day(lt)) - 3"),
    ),
    "seconds_since_last_tx": (
        _account,
        sql(f"SELECT tx_id, round((t - {_PREV}) / 1e6::DOUBLE, 6) AS seconds_since_last_tx FROM payments", "payments"),
    ),
    "distance_from_last_tx_km": (
        _account,
        sql(f"SELECT tx_id, round({_KM}, 6) AS distance_from_last_tx_km FROM last_place", "payments", then=_LAST),
    ),
    "implied_speed_kmh": (
        _account,
        sql(
            f"""SELECT tx_id, CASE WHEN pt IS NOT NULL THEN
  round(least({_KM} / ((t - pt) / 3.6e9::DOUBLE), 1000.0::DOUBLE), 6) END AS implied_speed_kmh FROM last_place""",
            "payments",
            then=_LAST,
        ),
    ),
    "distance_from_home_centroid_km": (
        _spread,
        sql(
            f"""SELECT tx_id, CASE WHEN n > 0 THEN round({haversine("mlat", "mlon", "lat", "lon")}, 6) END
  AS distance_from_home_centroid_km FROM stats""",
            "payments",
            then=_STATS,
        ),
    ),
    "is_new_country_for_account": (
        _novel,
        _new("is_new_country_for_account", "counterparty_country", "located"),
    ),
    "geo_cell_fraud_rate_30d": (
        _staged,
        sql(
            f"""SELECT tx_id, round((fraud + 50.0::DOUBLE * prior) / (labelled + 50.0::DOUBLE), 6)
  AS geo_cell_fraud_rate_30d FROM
  (SELECT p.tx_id, count(h.tx_id) AS labelled, count(h.tx_id) FILTER (WHERE h.is_fraud) AS fraud
   FROM payments p LEFT JOIN payments h ON h.cell = p.cell AND h.t < p.t
     AND h.t > p.t - {micros("30d")} AND h.label_at < p.t GROUP BY p.tx_id),
  (SELECT CAST(count(*) FILTER (WHERE is_fraud) AS DOUBLE) / count(*) AS prior FROM payments
   WHERE t < {EPOCH + 20 * 86_400_000_000})""",
            "payments",
        ),
    ),
    "counterparty_is_new_for_account": (_novel, _new("counterparty_is_new_for_account", "counterparty")),
    "counterparty_account_age_days": (_staged, _age("counterparty_account_age_days", "counterparty")),
    "counterparty_unique_senders_24h": (
        _staged,
        sql(
            f"SELECT tx_id, count(DISTINCT account) OVER {_w('24h', 'counterparty')} AS counterparty_unique_senders_24h FROM payments",
            "payments",
        ),
    ),
    "counterparty_confirmed_fraud_90d": (
        _staged,
        sql(
            f"""SELECT tx_id, v AS counterparty_confirmed_fraud_90d FROM (
{_labels("counterparty", "90d", "count(h.tx_id) FILTER (WHERE h.is_fraud)")})""",
            "payments",
        ),
    ),
    "tx_count_to_counterparty_30d": (
        _novel,
        _count("tx_count_to_counterparty_30d", "30d", "account, counterparty"),
    ),
    "channel": (
        lambda name: lambda spark, sf: tables.payments(spark, sf).select(
            "tx_id", ft.declared_channel(F.col("channel")).alias("channel")
        ),
        sql("SELECT tx_id, channel FROM payments", "payments"),
    ),
    "device_is_new_for_account": (
        _novel,
        _new("device_is_new_for_account", "device", null_if="device IS NULL"),
    ),
    "accounts_per_device_7d": (_staged, _shared("accounts_per_device_7d", "device", "7d")),
    "device_changes_24h": (
        _staged,
        sql(
            f"""SELECT p.tx_id, CASE WHEN p.device IS NOT NULL THEN
  count(DISTINCT h.device) - max(CASE WHEN h.device = p.device THEN 1 ELSE 0 END) END AS device_changes_24h
FROM payments p LEFT JOIN payments h ON h.account = p.account AND h.t < p.t AND h.t > p.t - {micros("24h")}
GROUP BY p.tx_id, p.device""",
            "payments",
        ),
    ),
    "device_age_days": (
        _staged,
        sql(
            """SELECT tx_id, CASE WHEN device IS NOT NULL THEN
  round((t - min(t) OVER (PARTITION BY device)) / 86400000000.0::DOUBLE, 6) END AS device_age_days
FROM payments""",
            "payments",
        ),
    ),
    "account_age_days": (_staged, _age("account_age_days", "account")),
    "kyc_tier": (
        _staged,
        sql("SELECT tx_id, kyc_tier FROM tiered", "payments", "tiers", then=_TIER),
    ),
    "days_since_sim_swap": (
        _staged,
        sql(
            """SELECT p.tx_id, round((p.t - v.swapped_at) / 86400000000.0::DOUBLE, 6) AS days_since_sim_swap
FROM payments p ASOF LEFT JOIN swaps v ON p.account = v.account AND p.t > v.swapped_at""",
            "payments",
            "swaps",
        ),
    ),
    "dormancy_reactivation_flag": (
        lambda name: lambda spark, sf: _dormancy(spark, sf),
        sql(
            f"""SELECT tx_id, coalesce({_PREV} <= t - {micros("60d")}, FALSE) AS dormancy_reactivation_flag
FROM payments_days""",
            "payments_days",
        ),
    ),
    "agent_float_utilisation_ratio": (
        _staged,
        sql(
            "SELECT tx_id, round(CAST(balance_cents AS DOUBLE) / limit_cents, 6) AS agent_float_utilisation_ratio FROM standing",
            "payments",
            "standings",
            then=_STAND,
        ),
    ),
    "agent_cashout_count_1h": (
        _staged,
        sql(
            f"""SELECT tx_id, CASE WHEN agent IS NOT NULL THEN
  count(*) FILTER (WHERE mcc = '6011') OVER {_w("1h", "agent")} END AS agent_cashout_count_1h FROM payments""",
            "payments",
        ),
    ),
    "agent_unique_customers_1h": (_staged, _shared("agent_unique_customers_1h", "agent", "1h")),
    "agent_distance_from_registered_km": (
        _staged,
        sql(
            f"SELECT tx_id, round({haversine('home_lat', 'home_lon', 'lat', 'lon')}, 6) AS agent_distance_from_registered_km FROM standing",
            "payments",
            "standings",
            then=_STAND,
        ),
    ),
    "corridor_class": (
        lambda name: lambda spark, sf: _out(
            ft.corridors(
                tables.with_countries(tables.payments(spark, sf), spark, sf), tables.countries(spark, sf)
            ),
            name,
        ),
        sql(
            """SELECT tx_id, CASE WHEN h.country = a.country THEN 'DOMESTIC'
  WHEN h.bloc = a.bloc THEN 'INTRA_BLOC' WHEN h.continent = a.continent THEN 'CROSS_BLOC_AFRICA'
  ELSE 'INTERCONTINENTAL' END AS corridor_class
FROM located l JOIN countries h ON h.country = l.country
JOIN countries a ON a.country = l.counterparty_country""",
            "located",
        ),
    ),
    "synthetic_identity_score": (
        lambda name: lambda spark, sf: _identity(spark, sf),
        sql(
            f"""SELECT a.tx_id, round((
  greatest(0.0::DOUBLE, least(1.0::DOUBLE, coalesce((3 - kyc_tier) / 2.0::DOUBLE, 0)))
  + CASE WHEN (a.t - opened_at) / 86400000000.0::DOUBLE < 30 THEN 1.0::DOUBLE ELSE 0 END
  + greatest(0.0::DOUBLE, least(1.0::DOUBLE, coalesce((shared - 1) / 2.0::DOUBLE, 0)))
  + greatest(0.0::DOUBLE, least(1.0::DOUBLE, coalesce(
      (n7 / nullif(n30, 0)::DOUBLE - 7.0::DOUBLE / 30.0::DOUBLE) / (1.0::DOUBLE - 7.0::DOUBLE / 30.0::DOUBLE), 0)))
  ) / 4.0::DOUBLE, 6) AS synthetic_identity_score
FROM (SELECT tx_id, account, t, kyc_tier, count(*) OVER {_w("7d")} AS n7, count(*) OVER {_w("30d")} AS n30 FROM tiered) a
LEFT JOIN profiles f ON f.account = a.account
JOIN sharing s ON s.tx_id = a.tx_id""",
            "payments",
            "tiers",
            "profiles",
            then=_TIER
            + f""", sharing AS (SELECT p.tx_id, CASE WHEN p.device IS NOT NULL THEN
  count(DISTINCT h.account) + 1 - max(CASE WHEN h.account = p.account THEN 1 ELSE 0 END) END AS shared
  FROM payments p LEFT JOIN payments h ON h.device = p.device AND h.t < p.t AND h.t > p.t - {micros("7d")}
  GROUP BY p.tx_id, p.device)""",
        ),
    ),
}


def _dormancy(spark, sf):
    """Over the day-clock history, whose gaps are long enough to go dormant."""
    p = tables.payments_days(spark, sf).select(
        "tx_id", "account", "t", F.lit(0).cast("decimal(18,4)").alias("amount"),
        F.lit(0.0).alias("lat"), F.lit(0.0).alias("lon"),
    )
    return _out(ft.account_history(p, find_hot_keys(p, ["account"], "tx_id", grain=tables.DAY)),
                "dormancy_reactivation_flag")


def _identity(spark, sf):
    p = tables.payments(spark, sf)
    hot = hot_keys(spark, sf, p)
    rows = p.select("tx_id", "account", "t", "device", "counterparty", "amount", "lat", "lon")
    rows = ft.account_history(rows, hot).select(
        "tx_id", "account", "t", "device", "counterparty", "tx_count_7d", "_n_30d"
    )
    rows = ft.pair_history(ft.pair_history(rows, "counterparty", "_cp", hot), "device", "_dev", hot)
    rows = ft.account_sweep(
        rows, hot, tables.tiers(spark, sf), tables.sim_swaps(spark, sf), tables.profiles(spark, sf)
    )
    return _out(ft.synthetic_identity(ft.device_sweep(rows, hot)), "synthetic_identity_score")


for _i, (_name, (_make, _sql)) in enumerate(_SPECS.items(), 1):
    query(f"f{_i:02d}_{_name}", _sql)(_make(_name))


def matrix(spark, sf, keep=None) -> DataFrame:
    """All features of every payment."""
    base = tables.payments(spark, sf)
    p = tables.with_countries(base, spark, sf)
    return ft.feature_matrix(
        p,
        prior=prior(base),
        countries=tables.countries(spark, sf),
        limits=tables.limits(spark, sf),
        tiers=tables.tiers(spark, sf),
        swaps=tables.sim_swaps(spark, sf),
        profiles=tables.profiles(spark, sf),
        standings=tables.standings(spark, sf),
        hot=hot_keys(spark, sf, base),
        keep=keep,
    )


def stored_features(spark, sf, keep: list[str]) -> DataFrame:
    """All features, reals at six places as their own queries give them, written once for several passes."""
    m = matrix(spark, sf, keep=keep)
    return stored(m.select(*[F.round(c, 6).alias(c) if c in FEATURES and FEATURES[c].dtype == "double" else F.col(c) for c in m.columns]), "features")


# Payments are a month long, so the dormancy of the day-clock history has its own window here.
_TWINS = {n: text for n, (_, text) in _SPECS.items()} | {
    "dormancy_reactivation_flag": sql(
        f"SELECT tx_id, coalesce({_PREV} <= t - {micros('60d')}, FALSE) AS dormancy_reactivation_flag FROM payments", "payments"),
}
#: The twin of stored_features: each feature's own twin, side by side.
FEATURE_TABLE = (
    "feats AS MATERIALIZED (SELECT p.tx_id, p.is_fraud, p.t, " + ", ".join(f"f{i}.{n}" for i, n in enumerate(FEATURES)) + "\nFROM payments p\n"
    + "\n".join(f"LEFT JOIN ({_TWINS[n]}) f{i} ON f{i}.tx_id = p.tx_id" for i, n in enumerate(FEATURES)) + ")"
)


@query("f45_all_features", sql("SELECT * EXCLUDE (is_fraud, t) FROM feats", "payments", then=FEATURE_TABLE))
def all_features(spark, sf):
    """Every feature of the vector at every payment, next to its own twin's value."""
    return stored_features(spark, sf, [])


@query(
    "f45_feature_vector",
    sql(
        f"""SELECT p.tx_id, count(*) OVER {_w("60s")} AS tx_count_60s, count(*) OVER {_w("1h")} AS tx_count_1h,
  count(*) OVER {_w("24h")} AS tx_count_24h, count(*) OVER {_w("7d")} AS tx_count_7d,
  count(DISTINCT counterparty) OVER {_w("24h")} AS unique_counterparties_24h,
  count(DISTINCT account) OVER {_w("24h", "counterparty")} AS counterparty_unique_senders_24h,
  count(*) OVER {_w("30d", "account, counterparty")} AS tx_count_to_counterparty_30d,
  channel, kyc_tier, 44 AS slots
FROM tiered p""",
        "payments",
        "tiers",
        then=_TIER,
    ),
)
def feature_vector(spark, sf):
    """The vector's exact columns beside the number of its slots; reals are checked one by one."""
    m = matrix(spark, sf)
    filled = F.size(F.array(*[F.lit(n) for n in m.columns if n != "tx_id"]))
    return m.select(
        "tx_id", "tx_count_60s", "tx_count_1h", "tx_count_24h", "tx_count_7d",
        "unique_counterparties_24h", "counterparty_unique_senders_24h",
        "tx_count_to_counterparty_30d", "channel", "kyc_tier", filled.alias("slots"),
    )
