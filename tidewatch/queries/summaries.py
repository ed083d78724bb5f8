"""Grouped summaries and set operations over payments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import geo, keys, money, stats
from tidewatch.operators import aggregates as ag
from tidewatch.operators import encode, monitor
from tidewatch.operators.analyst import amount_bucket
from tidewatch.operators.order import quantiles
from tidewatch.plans import operations, tables
from tidewatch.plans.registry import trainable
from tidewatch.queries.evaluation import PLAN, rounded
from tidewatch.queries.features import FEATURE_TABLE
from tidewatch.queries.registry import query
from tidewatch.queries.views import EPOCH, haversine, sql

DAY, HOUR, SECOND = tables.DAY, tables.HOUR, tables.SECOND
CUT = EPOCH + 15 * DAY


def _p(spark, sf) -> DataFrame:
    return tables.payments(spark, sf)


def _bucketed(keys_sql: str, size: int) -> str:
    return sql(
        f"""SELECT {keys_sql}, t // {size} * {size} AS bucket, count(*) AS n, CAST(sum(amount) AS DOUBLE) AS total
FROM (SELECT *, 'I' || CAST(account % 4 AS VARCHAR) AS institution FROM payments) GROUP BY ALL""",
        "payments",
    )


@query("a01_k06_hourly_volumes", _bucketed("institution, account", HOUR))
def hourly(spark, sf):
    p = _p(spark, sf).withColumn("institution", operations.institution())
    out = monitor.volumes(p, ["institution", "account"], HOUR)
    return out.withColumn("total", F.col("total").cast("double"))


@query("a02_k06_quarter_hour_volumes", _bucketed("institution, mcc, channel", 15 * 60 * SECOND))
def quarters(spark, sf):
    p = _p(spark, sf).withColumn("institution", operations.institution())
    out = monitor.volumes(p, ["institution", "mcc", "channel"], 15 * 60 * SECOND)
    return out.withColumn("total", F.col("total").cast("double"))


@query(
    "a03_first_seen",
    sql(
        """SELECT 'account' AS entity, CAST(account AS VARCHAR) AS id, min(t) AS first_seen FROM payments GROUP BY 2
UNION ALL SELECT 'device', CAST(device AS VARCHAR), min(t) FROM payments WHERE device IS NOT NULL GROUP BY 2""",
        "payments",
    ),
)
def first_seen(spark, sf):
    return ag.first_seen(_p(spark, sf), ["account", "device"])


_USED = f"""SELECT DISTINCT account, 'counterparty' AS kind, CAST(counterparty AS VARCHAR) AS value FROM payments WHERE t < {CUT}
UNION SELECT DISTINCT account, 'device', CAST(device AS VARCHAR) FROM payments WHERE t < {CUT} AND device IS NOT NULL
UNION SELECT DISTINCT account, 'mcc', mcc FROM payments WHERE t < {CUT}"""


@query("a04_ever_used_sets", sql(_USED, "payments"))
def ever_used(spark, sf):
    return ag.ever_used(_p(spark, sf), CUT, ["counterparty", "device", "mcc"])


@query(
    "u01_known_before_union",
    sql(
        f"""SELECT DISTINCT account, 'counterparty' AS kind, CAST(counterparty AS VARCHAR) AS value
FROM payments WHERE t < {CUT} OR t >= {EPOCH + 20 * DAY}""",
        "payments",
    ),
)
def known_before(spark, sf):
    """What was used before a cut, united with what a later corpus shows."""
    p = _p(spark, sf)
    earlier = ag.ever_used(p, CUT, ["counterparty"])
    corpus = ag.ever_used(p.filter(F.col("t") >= EPOCH + 20 * DAY), EPOCH + 400 * DAY, ["counterparty"])
    return ag.known_before(p, corpus, earlier, "counterparty")


@query(
    "a05_account_summary",
    sql(
        f"""SELECT account, min(t) AS first_seen, max(t) AS last_seen, arg_min(lat, (-t, tx_id)) AS last_lat,
  arg_min(lon, (-t, tx_id)) AS last_lon, count(DISTINCT counterparty) AS counterparties, count(DISTINCT device) AS devices,
  count(*) AS n FROM payments WHERE t < {CUT} GROUP BY account""",
        "payments",
    ),
)
def account_summary(spark, sf):
    return ag.account_summary(_p(spark, sf), CUT)


@query(
    "a07_category_rates",
    sql(
        """SELECT channel, count(*) FILTER (WHERE is_fraud) AS fraud, count(*) AS n,
  round((count(*) FILTER (WHERE is_fraud) + 50.0::DOUBLE * (SELECT count(*) FILTER (WHERE is_fraud) / CAST(count(*) AS DOUBLE) FROM payments))
    / (count(*) + 50.0::DOUBLE), 6) AS rate FROM payments GROUP BY channel""",
        "payments",
    ),
)
def category_rates(spark, sf):
    return rounded(encode.category_rates(_p(spark, sf), "channel"), "rate")


def _wilson_sql(sign: str) -> str:
    return f"""((fraud / CAST(rows AS DOUBLE) + 3.8416::DOUBLE / (2 * rows)) {sign} 1.96::DOUBLE * sqrt(fraud / CAST(rows AS DOUBLE)
  * (1 - fraud / CAST(rows AS DOUBLE)) / rows + 3.8416::DOUBLE / (4.0::DOUBLE * rows * rows))) / (1 + 3.8416::DOUBLE / rows)"""


@query(
    "a09_x14_rate_intervals",
    sql(
        f"""SELECT period, rows, fraud, round(fraud / CAST(rows AS DOUBLE), 6) AS rate, round(greatest(0.0::DOUBLE, {_wilson_sql("-")}), 6) AS ci_lower,
  round(least(1.0::DOUBLE, {_wilson_sql("+")}), 6) AS ci_upper,
  greatest(0.0::DOUBLE, {_wilson_sql("-")}) <= 0.07::DOUBLE AND 0.07::DOUBLE <= least(1.0::DOUBLE, {_wilson_sql("+")}) AS covers
FROM (SELECT (t - {EPOCH}) // {7 * DAY} AS period, count(*) AS rows, count(*) FILTER (WHERE is_fraud) AS fraud FROM payments GROUP BY 1)""",
        "payments",
    ),
)
def rate_intervals(spark, sf):
    period = F.expr(f"(t - {EPOCH}) div {7 * DAY}")
    return rounded(ag.fraud_intervals(_p(spark, sf), period, 0.07), "rate", "ci_lower", "ci_upper")


MIX = {"MOBILE_MONEY": 0.2, "USSD": 0.2, "AGENT_BANKING": 0.2, "CARD": 0.2, "ONLINE": 0.15, "BANK_TRANSFER": 0.05}


@query(
    "a10_share_deviation",
    sql(
        """SELECT channel, round(coalesce(n, 0) / CAST((SELECT count(*) FROM payments) AS DOUBLE), 6) AS share, target,
  round(abs(coalesce(n, 0) / CAST((SELECT count(*) FROM payments) AS DOUBLE) - target) * 100, 6) AS deviation_pp
FROM (VALUES ('MOBILE_MONEY', 0.2::DOUBLE), ('USSD', 0.2), ('AGENT_BANKING', 0.2), ('CARD', 0.2), ('ONLINE', 0.15), ('BANK_TRANSFER', 0.05)) m(channel, target)
LEFT JOIN (SELECT channel, count(*) AS n FROM payments GROUP BY 1) USING (channel)""",
        "payments",
    ),
)
def share_deviation(spark, sf):
    return rounded(ag.share_deviation(_p(spark, sf), "channel", MIX), "share", "deviation_pp")


@query(
    "a11_a12_exact_distinct",
    sql(
        "SELECT count(DISTINCT account) AS accounts, count(DISTINCT counterparty) AS counterparties, count(DISTINCT agent) AS agents FROM payments",
        "payments",
    ),
)
def distinct_counts(spark, sf):
    return _p(spark, sf).agg(
        F.count_distinct("account").alias("accounts"),
        F.count_distinct("counterparty").alias("counterparties"),
        F.count_distinct("agent").alias("agents"),
    )


@query(
    "a13_s07_amount_profile",
    sql(
        "SELECT channel, count(*) AS n, round(avg(cents), 6) AS mean, round(median(cents), 6) AS median FROM payments GROUP BY 1",
        "payments",
    ),
)
def amount_profile(spark, sf):
    return rounded(ag.amount_profile(_p(spark, sf), ["channel"]), "mean", "median")


@query(
    "a13_q19_profile_comparison",
    sql(
        f"""SELECT round(max(abs(b.n - a.n) / CAST(a.n AS DOUBLE)), 6) AS n, round(max(abs(b.mean - a.mean) / abs(a.mean)), 6) AS mean,
  round(max(abs(b.median - a.median) / abs(a.median)), 6) AS median FROM
  (SELECT channel, count(*) AS n, avg(cents) AS mean, median(cents) AS median FROM payments WHERE t < {CUT} GROUP BY 1) a
FULL JOIN (SELECT channel, count(*) AS n, avg(cents) AS mean, median(cents) AS median FROM payments WHERE t >= {CUT} GROUP BY 1) b USING (channel)""",
        "payments",
    ),
)
def profile_comparison(spark, sf):
    p = _p(spark, sf)
    a = ag.amount_profile(p.filter(F.col("t") < CUT), ["channel"])
    b = ag.amount_profile(p.filter(F.col("t") >= CUT), ["channel"])
    return rounded(ag.compare_profiles(a, b, ["channel"], ["n", "mean", "median"]), "n", "mean", "median")


@query(
    "a14_q14_missing_and_distinct",
    sql(
        """SELECT 'device' AS name, round(1 - count(device) / CAST(count(*) AS DOUBLE), 6) AS missing_rate, count(DISTINCT device) AS distinct FROM payments
UNION ALL SELECT 'agent', round(1 - count(agent) / CAST(count(*) AS DOUBLE), 6), count(DISTINCT agent) FROM payments
UNION ALL SELECT 'mcc', round(1 - count(mcc) / CAST(count(*) AS DOUBLE), 6), count(DISTINCT mcc) FROM payments
UNION ALL SELECT 'cents', round(1 - count(cents) / CAST(count(*) AS DOUBLE), 6), count(DISTINCT cents) FROM payments""".replace(
            "AS distinct", 'AS "distinct"'
        ),
        "payments",
    ),
)
def missingness(spark, sf):
    return rounded(ag.missingness(_p(spark, sf), ["device", "agent", "mcc", "cents"]), "missing_rate")


@query(
    "a15_training_medians",
    sql(
        f"""SELECT round(median(cents), 6) AS cents, round(median(agent), 6) AS agent, round(median(lat), 6) AS lat FROM payments WHERE t < {PLAN.validation}""",
        "payments",
    ),
)
def training_medians(spark, sf):
    train = _p(spark, sf).filter(F.col("t") < PLAN.validation)
    k = F.lit(0).alias("k")
    out = None
    for c in ("cents", "agent", "lat"):
        one = quantiles(train, c, {c: 0.5}).select(c, k)
        out = one if out is None else out.join(one, "k")
    return rounded(out.drop("k"), "cents", "agent", "lat")


@query(
    "a17_null_signatures",
    sql("SELECT DISTINCT is_fraud, channel, device IS NULL AS device_null, agent IS NULL AS agent_null FROM payments", "payments"),
)
def null_signatures(spark, sf):
    return ag.null_signatures(_p(spark, sf), ["device", "agent"])


@query(
    "u02_q11_unmatched_signatures",
    sql(
        """SELECT DISTINCT channel, device IS NULL AS device_null, agent IS NULL AS agent_null FROM payments WHERE is_fraud
EXCEPT SELECT channel, device IS NULL, agent IS NULL FROM payments WHERE NOT is_fraud""",
        "payments",
    ),
)
def unmatched(spark, sf):
    return ag.unmatched_signatures(_p(spark, sf), ["device", "agent"])


_STRIPPED = "CASE WHEN is_fraud AND k % 10 = 0 THEN NULL ELSE device END"


@query(
    "u02_q11_planted_signature",
    sql(
        f"""SELECT DISTINCT channel, {_STRIPPED} IS NULL AS device_null, agent IS NULL AS agent_null FROM payments WHERE is_fraud
EXCEPT SELECT channel, {_STRIPPED} IS NULL, agent IS NULL FROM payments WHERE NOT is_fraud""",
        "payments",
    ),
)
def planted_signature(spark, sf):
    """Some fraud loses its device, which legitimate rows of its channel never do."""
    p = _p(spark, sf).withColumn("device", F.when(~(F.col("is_fraud") & (F.col("k") % 10 == 0)), F.col("device")))
    return ag.unmatched_signatures(p, ["device", "agent"])


@query(
    "a20_fraud_type_rollup",
    sql(
        """SELECT week, kind, count(*) AS n FROM (SELECT t // 604800000000 AS week, 'V' || CAST(k % 5 AS VARCHAR) AS kind FROM payments WHERE is_fraud)
GROUP BY ROLLUP (week, kind)""",
        "payments",
    ),
)
def fraud_types(spark, sf):
    rows = _p(spark, sf).filter("is_fraud").select(
        F.expr("t div 604800000000").alias("week"), F.concat(F.lit("V"), (F.col("k") % 5).cast("string")).alias("kind")
    )
    return rows.rollup("week", "kind").agg(F.count("*").alias("n"))


_SEEDS = """runs AS (SELECT s, avg(CAST((k * (s + 3) + cents) % 100 AS DOUBLE)) AS metric, avg(CAST((k + cents) % 100 AS DOUBLE)) AS base
  FROM payments, range(5) r(s) GROUP BY s)"""


@query(
    "a21_across_seeds",
    sql(
        "SELECT count(*) AS seeds, round(avg(metric), 6) AS mean, round(stddev_samp(metric), 6) AS deviation, round(100 * (1 - avg(metric) / avg(base)), 6) AS reduction_pct FROM runs",
        "payments",
        then=_SEEDS,
    ),
)
def across_seeds(spark, sf):
    rows = _p(spark, sf).select("k", "cents", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("s"))
    runs = rows.groupBy("s").agg(
        F.avg(((F.col("k") * (F.col("s") + 3) + F.col("cents")) % 100).cast("double")).alias("metric"),
        F.avg(((F.col("k") + F.col("cents")) % 100).cast("double")).alias("base"),
    )
    return rounded(ag.across_seeds(runs, "metric", "base"), "mean", "deviation", "reduction_pct")


@query("a22_fraud_accounts", sql("SELECT account, bool_or(is_fraud) AS fraud FROM payments GROUP BY 1", "payments"))
def fraud_accounts(spark, sf):
    return _p(spark, sf).groupBy("account").agg(F.bool_or("is_fraud").alias("fraud"))


@query(
    "a23_ever_fraud_tokens",
    sql(
        """SELECT 'account' AS column, CAST(account AS VARCHAR) AS value, bool_or(is_fraud) AS fraud FROM payments GROUP BY 2
UNION ALL SELECT 'counterparty', CAST(counterparty AS VARCHAR), bool_or(is_fraud) FROM payments GROUP BY 2
UNION ALL SELECT 'device', CAST(device AS VARCHAR), bool_or(is_fraud) FROM payments WHERE device IS NOT NULL GROUP BY 2""".replace(
            "AS column", 'AS "column"'
        ),
        "payments",
    ),
)
def ever_fraud(spark, sf):
    return ag.ever_fraud(_p(spark, sf), ["account", "counterparty", "device"])


_RECORDS = """records AS (SELECT label_id AS "offset", CASE WHEN label_id % 97 = 0 THEN 'bad' ELSE CAST(tx_id + CASE WHEN label_id % 89 = 0 THEN 100000000 ELSE 0 END AS VARCHAR) END AS id FROM label_events),
sent AS (SELECT CAST(tx_id AS VARCHAR) AS id FROM payments), accepted AS (SELECT CAST(tx_id AS VARCHAR) AS id FROM payments WHERE k % 10 < 7),
kinds AS (SELECT r.*, CASE WHEN id = 'bad' THEN 'unparsed' WHEN row_number() OVER (PARTITION BY id ORDER BY "offset") > 1 THEN 'duplicate'
  WHEN id IN (SELECT id FROM accepted) THEN 'accepted' WHEN id IN (SELECT id FROM sent) THEN 'late' ELSE 'foreign' END AS kind FROM records r)"""


def _records(p: DataFrame):
    events = operations.label_events(p)
    shift = F.when(F.col("label_id") % 89 == 0, 100_000_000).otherwise(0)
    records = events.select(
        F.col("label_id").alias("offset"),
        F.when(F.col("label_id") % 97 == 0, "bad").otherwise((F.col("tx_id") + shift).cast("string")).alias("id"),
    )
    ids = p.select(F.col("tx_id").cast("string").alias("id"), "k")
    return records, ids.select("id"), ids.filter(F.col("k") % 10 < 7).select("id")


@query("a24_record_classes", sql('SELECT "offset", id, kind FROM kinds', "label_events", then=_RECORDS))
def record_classes(spark, sf):
    records, sent, accepted = _records(_p(spark, sf))
    return ag.reconcile(records, sent, accepted, F.col("id").rlike("^[0-9]+$")).select("offset", "id", "kind")


@query(
    "u03_accepted_without_record",
    sql("SELECT DISTINCT id FROM accepted WHERE id NOT IN (SELECT id FROM records)", "label_events", then=_RECORDS),
)
def without_record(spark, sf):
    records, _, accepted = _records(_p(spark, sf))
    return ag.without_record(accepted, records, F.col("id").rlike("^[0-9]+$"))


_AT = EPOCH + 20 * DAY


@query(
    "a25_velocity_snapshot",
    sql(
        f"""SELECT account, count(*) FILTER (WHERE t > {_AT - 60 * SECOND}) AS count_60s, count(*) FILTER (WHERE t > {_AT - HOUR}) AS count_1h,
  count(*) FILTER (WHERE t > {_AT - DAY}) AS count_24h, count(*) AS count_7d,
  CAST(coalesce(sum(cents) FILTER (WHERE t > {_AT - DAY}), 0) AS BIGINT) AS cents_24h, CAST(sum(cents) AS BIGINT) AS cents_7d,
  count(DISTINCT counterparty) FILTER (WHERE t > {_AT - DAY}) AS counterparties_24h, max(t) AS last_t,
  arg_min(channel, (-t, tx_id)) AS last_channel, arg_min(lat, (-t, tx_id)) AS last_lat, TRUE AS nested
FROM payments WHERE t < {_AT} AND t > {_AT - 7 * DAY} GROUP BY account""",
        "payments",
    ),
)
def velocity_snapshot(spark, sf):
    return ag.velocity_snapshot(_p(spark, sf), _AT)


# ---- scalar functions ------------------------------------------------------------------------------------


@query(
    "x01_haversine",
    sql(f"SELECT tx_id, round({haversine('lat', 'lon', '0.0::DOUBLE', '30.0::DOUBLE')}, 6) AS km FROM payments", "payments"),
)
def haversine_query(spark, sf):
    p = _p(spark, sf)
    return rounded(p.select("tx_id", geo.haversine_km(F.col("lat"), F.col("lon"), F.lit(0.0), F.lit(30.0)).alias("km")), "km")


@query("x02_grid_cell", sql("SELECT tx_id, cell FROM payments", "payments"))
def grid_cell(spark, sf):
    return _p(spark, sf).select("tx_id", geo.geo_cell(F.col("lat"), F.col("lon")).alias("cell"))


@query(
    "x06_minor_units",
    sql("SELECT tx_id, cents AS minor, cents * 10 AS in_three, CASE WHEN cents % 10 = 0 THEN cents // 10 END AS in_one FROM payments", "payments"),
)
def minor_units(spark, sf):
    p = _p(spark, sf)
    units = {"minor": 2, "in_three": 3, "in_one": 1}
    return p.select("tx_id", *[money.minor_units(F.col("amount"), F.lit(u)).alias(n) for n, u in units.items()])


_HASH = """CAST(list_reduce(list_prepend(0, list_transform(string_split(CAST(account AS VARCHAR), ''), lambda c: ascii(c))),
  lambda a, b: CAST((CAST(a AS BIGINT) * 131 + b) % 2147483647 AS BIGINT)) % 7 AS INTEGER)"""


@query("x08_account_fold", sql(f"SELECT DISTINCT account, {_HASH} AS fold FROM payments", "payments"))
def account_fold(spark, sf):
    return _p(spark, sf).select("account").distinct().select("account", keys.fold_of(F.col("account"), 7).alias("fold"))


@query(
    "p11_x09_sample_hash",
    sql(
        """SELECT tx_id, is_fraud FROM payments
WHERE is_fraud OR CAST('0x' || left(md5('7:' || CAST(tx_id AS VARCHAR)), 8) AS BIGINT) % 1000 < 40""",
        "payments",
    ),
)
def sample_hash(spark, sf):
    """All positives and a keyed share of the rest: kept or not by id alone, wherever the row lies."""
    p = _p(spark, sf)
    return p.filter(F.col("is_fraud") | keys.sampled(F.col("tx_id"), 7, 40)).select("tx_id", "is_fraud")


@query(
    "x10_identifier_formats",
    sql(
        """SELECT p_partkey, regexp_matches('tok_' || repeat(CAST(p_partkey AS VARCHAR), 8), '^tok_[A-Za-z0-9]{24,64}$') AS token,
  regexp_matches(CAST(p_partkey AS VARCHAR), '^[0-9]{4}$') AS mcc, regexp_matches(upper(left(p_name, 2)), '^[A-Z]{2}$') AS country FROM part"""
    ),
)
def identifier_formats(spark, sf):
    part = tables.read(spark, sf, "part")
    key = F.col("p_partkey").cast("string")
    return part.select(
        "p_partkey", F.concat(F.lit("tok_"), F.repeat(key, F.lit(8))).rlike(keys.TOKEN).alias("token"),
        key.rlike(keys.MCC).alias("mcc"), F.upper(F.substring("p_name", 1, 2)).rlike(keys.COUNTRY).alias("country"),
    )


@query(
    "x11_identifier_bytes",
    sql(
        """SELECT p_partkey, list_reduce(list_prepend(0, list_transform(range(16), lambda i: CAST(('0x' || substr(h, i * 2 + 1, 2)) AS INTEGER))), lambda a, b: a + b) AS byte_sum,
  CAST(('0x' || left(h, 2)) AS INTEGER) AS first_byte FROM (SELECT p_partkey, md5(CAST(p_partkey AS VARCHAR)) AS h FROM part)"""
    ),
)
def identifier_bytes(spark, sf):
    part = tables.read(spark, sf, "part")
    bytes_ = keys.uuid_bytes(keys.derived_id(F.col("p_partkey")))
    return part.select(
        "p_partkey", F.aggregate(bytes_, F.lit(0), lambda a, b: a + b).alias("byte_sum"), bytes_[0].alias("first_byte")
    )


@query(
    "x12_row_position",
    sql(
        """SELECT tx_id, t % 1000000 AS sub_second, CAST(day(make_timestamp(t)) AS INTEGER) AS day,
  round((row_number() OVER (PARTITION BY day(make_timestamp(t)) ORDER BY t, tx_id) - 1)
    / CAST(greatest(count(*) OVER (PARTITION BY day(make_timestamp(t))) - 1, 1) AS DOUBLE), 6) AS position FROM payments""",
        "payments",
    ),
)
def row_position(spark, sf):
    p = _p(spark, sf).withColumn("file", F.dayofmonth(F.timestamp_micros("t")))
    return rounded(ag.row_position(p, "file", "t", ["tx_id"]).select("tx_id", "sub_second", "day", "position"), "position")


@query(
    "x13_amount_bucket",
    sql(
        """SELECT tx_id, CAST(CASE WHEN a < 1000 THEN 0 WHEN a < 5000 THEN 1 WHEN a < 10000 THEN 2 WHEN a < 50000 THEN 3 WHEN a < 100000 THEN 4
  WHEN a < 500000 THEN 5 WHEN a < 1000000 THEN 6 WHEN a < 5000000 THEN 7 WHEN a < 10000000 THEN 8 ELSE 9 END AS INTEGER) AS bucket
FROM (SELECT tx_id, cents * 20 AS a FROM payments)""",
        "payments",
    ),
)
def amount_buckets(spark, sf):
    return _p(spark, sf).select("tx_id", amount_bucket(F.col("cents") * 20).alias("bucket"))


@query(
    "x15_auc_errors",
    sql(
        """SELECT account, round(sqrt((pos + neg + 1) / (12.0::DOUBLE * pos * neg)), 6) AS null_error,
  round(1.96::DOUBLE * 1.62::DOUBLE * sqrt((pos + neg + 1) / (12.0::DOUBLE * pos * neg)), 6) AS band FROM (
  SELECT account, count(*) FILTER (WHERE is_fraud) AS pos, count(*) FILTER (WHERE NOT is_fraud) AS neg FROM payments GROUP BY 1) WHERE pos > 0 AND neg > 0""",
        "payments",
    ),
)
def auc_errors(spark, sf):
    y = F.col("is_fraud").cast("long")
    counts = _p(spark, sf).groupBy("account").agg(F.sum(y).alias("pos"), F.sum(1 - y).alias("neg"))
    counts = counts.filter("pos > 0 and neg > 0")
    out = counts.select(
        "account", stats.null_auc_error(F.col("pos"), F.col("neg")).alias("null_error"),
        stats.cv_null_band(F.col("pos"), F.col("neg"), 1.96).alias("band"),
    )
    return rounded(out, "null_error", "band")


@query(
    "x16_operating_points",
    sql(
        """SELECT channel, round(b / (b + 0.01::DOUBLE * (1 - b)), 6) AS ceiling,
  round(0.8::DOUBLE * 0.75::DOUBLE / (2 * 0.75::DOUBLE - 0.8::DOUBLE), 6) AS precision,
  round(0.75::DOUBLE * b * (1 - 0.8::DOUBLE * 0.75::DOUBLE / 0.7::DOUBLE) / (0.8::DOUBLE * 0.75::DOUBLE / 0.7::DOUBLE * (1 - b)), 6) AS fpr
FROM (SELECT channel, (count(*) FILTER (WHERE is_fraud) + 1) / CAST(count(*) + 2 AS DOUBLE) AS b FROM payments GROUP BY 1)""",
        "payments",
    ),
)
def operating_points(spark, sf):
    y = F.col("is_fraud").cast("long")
    base = _p(spark, sf).groupBy("channel").agg(((F.sum(y) + 1) / (F.count("*") + 2)).alias("b"))
    implied = stats.implied_operating_point(F.lit(0.8), F.lit(0.75), F.col("b"))
    out = base.select(
        "channel", stats.precision_ceiling(F.col("b"), F.lit(0.01)).alias("ceiling"), implied.alias("i")
    ).select("channel", "ceiling", "i.precision", "i.fpr")
    return rounded(out, "ceiling", "precision", "fpr")


@query(
    "x18_platt_map",
    sql("SELECT tx_id, round(1 / (1 + exp(-(1.5::DOUBLE * ln(c / (1 - c)) - 0.25::DOUBLE))), 6) AS calibrated FROM (SELECT tx_id, least(greatest(score, 1e-9::DOUBLE), 1 - 1e-9::DOUBLE) AS c FROM payments)", "payments"),
)
def platt(spark, sf):
    p = _p(spark, sf)
    return rounded(p.select("tx_id", stats.platt(F.col("score"), 1.5, -0.25).alias("calibrated")), "calibrated")


@query(
    "x24_derived_id",
    sql(
        """SELECT tx_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12) AS id
FROM (SELECT tx_id, md5('hold|' || tx_id || '|' || account) AS h FROM payments)""",
        "payments",
    ),
)
def derived_id(spark, sf):
    return _p(spark, sf).select("tx_id", keys.derived_id(F.lit("hold"), F.col("tx_id"), F.col("account")).alias("id"))


@query(
    "p05_country_of_currency",
    sql("SELECT tx_id, country FROM located", "located"),
)
def currency_country(spark, sf):
    p = tables.with_countries(_p(spark, sf), spark, sf).drop("country")
    return ag.attach_country(p, tables.countries(spark, sf)).select("tx_id", "country")


@query(
    "u05_p06_feature_columns",
    sql(
        " UNION ALL ".join(f"SELECT {i} AS position, '{n}' AS name, count({n}) AS present FROM feats" for i, n in enumerate(trainable())),
        "payments",
        then=FEATURE_TABLE,
    ),
)
def feature_columns(spark, sf):
    """The trainable columns of the matrix in contract order, with each one's non-missing rows."""
    from tidewatch.queries.features import matrix

    names = trainable()
    m = matrix(spark, sf).select(*names)
    counts = m.agg(*[F.count(n).alias(n) for n in names])
    pairs = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(n).alias("name"), F.col(n).alias("present")) for i, n in enumerate(names)])
    return counts.select(F.explode(pairs).alias("p")).select("p.*")


@query(
    "s03_newest_rows",
    sql("SELECT tx_id, t FROM payments ORDER BY t DESC, tx_id DESC LIMIT 100", "payments"),
)
def newest(spark, sf):
    from tidewatch.sources.history import tail

    return tail(_p(spark, sf), 100).select("tx_id", "t")


