"""Quality and model queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import keys
from tidewatch.operators import features as ft
from tidewatch.operators import models, quality as q
from tidewatch.plans import operations, registry, tables
from tidewatch.queries.evaluation import PLAN, rounded
from tidewatch.queries.features import FEATURE_TABLE, hot_keys, matrix, stored_features
from tidewatch.queries.registry import query
from tidewatch.queries.summaries import MIX
from tidewatch.queries.views import EPOCH, sql
from tidewatch.session import scratch_dir

DAY = tables.DAY


def _p(spark, sf) -> DataFrame:
    return tables.payments(spark, sf)


def _separation(expr: str) -> str:
    """Exact AUC by mid-ranks over one expression of payments."""
    return f"""(SELECT CAST(sum(pos * (2 * nb + neg)) AS DOUBLE) / (2.0::DOUBLE * sum(pos) * sum(neg)) FROM (
  SELECT *, coalesce(sum(neg) OVER (ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nb FROM (
  SELECT {expr} AS v, count(*) FILTER (WHERE is_fraud) AS pos, count(*) FILTER (WHERE NOT is_fraud) AS neg FROM payments GROUP BY 1)))"""


_RAW = {
    "cents": "cents", "lat": "lat", "lon": "lon", "device_missing": "CAST(device IS NULL AS INTEGER)",
    "agent_present": "CAST(agent IS NOT NULL AS INTEGER)", "hour": "(t // 3600000000) % 24",
}


@query(
    "q01_raw_column_auc",
    sql(
        " UNION ALL ".join(
            f"SELECT 'single-feature AUC: {n}' AS check_name, greatest(a, 1 - a) <= 0.8 AS passed, round(greatest(a, 1 - a), 6) AS value, '<= 0.8' AS requirement FROM (SELECT {_separation(e)} AS a)"
            for n, e in _RAW.items()
        ),
        "payments",
    ),
)
def raw_columns(spark, sf):
    p = _p(spark, sf)
    rows = p.select(
        "is_fraud", "cents", "lat", "lon", F.col("device").isNull().cast("int").alias("device_missing"),
        F.col("agent").isNotNull().cast("int").alias("agent_present"), F.expr("(t div 3600000000) % 24").alias("hour"),
    )
    return rounded(q.raw_column_auc(rows, list(_RAW)), "value")


@query("q02_shortcut_detector")
def shortcut(spark, sf):
    rows, names = q.shortcut_columns(_p(spark, sf), keys.derived_id(F.lit("tx"), F.col("tx_id")))
    return q.shortcut_detector(rows, names)


@query("q03_event_construction")
def events(spark, sf):
    swaps = tables.sim_swaps(spark, sf).select("account", F.col("swapped_at").alias("at"))
    return q.event_construction(swaps, _p(spark, sf))


@query(
    "q04_file_order_auc",
    sql(
        f"SELECT 'file order' AS check_name, greatest(a, 1 - a) <= 0.53::DOUBLE AS passed, round(greatest(a, 1 - a), 6) AS value, '<= 0.53' AS requirement FROM (SELECT {_separation('t // 604800000000')} AS a)",
        "payments",
    ),
)
def file_order(spark, sf):
    return rounded(q.order_auc(_p(spark, sf), F.expr("t div 604800000000")), "value")


@query("q05_identifier_construction")
def identifiers(spark, sf):
    """Tokens are derived from the ids, so their characters should tell nothing."""
    p = _p(spark, sf)

    def token(name: str):
        return F.concat(F.lit("tok_"), F.substring(F.sha2(F.concat_ws(":", F.lit(name), F.col(name)), 256), 1, 32))

    rows = p.select("is_fraud", token("account").alias("account"), token("counterparty").alias("counterparty"))
    return q.identifier_construction(rows, ["account", "counterparty"])


_OBSERVED = "CASE WHEN tx_id % 61 = 0 THEN NOT is_fraud ELSE is_fraud END"


@query(
    "q07_label_noise",
    sql(
        f"""SELECT 'label noise: ' || kind AS check_name, rate BETWEEN 0.01::DOUBLE AND 0.02::DOUBLE AS passed, round(rate, 6) AS value, '0.01 to 0.02' AS requirement FROM (
  SELECT 'missed' AS kind, count(*) FILTER (WHERE is_fraud AND NOT {_OBSERVED}) / CAST(count(*) FILTER (WHERE is_fraud) AS DOUBLE) AS rate FROM payments
  UNION ALL SELECT 'false', count(*) FILTER (WHERE NOT is_fraud AND {_OBSERVED}) / CAST(count(*) FILTER (WHERE is_fraud) AS DOUBLE) FROM payments)""",
        "payments",
    ),
)
def label_noise(spark, sf):
    p = _p(spark, sf)
    seen = F.when(F.col("tx_id") % 61 == 0, ~F.col("is_fraud")).otherwise(F.col("is_fraud"))
    rows = p.select(F.col("is_fraud").alias("is_fraud_true"), seen.alias("is_fraud_observed"))
    return rounded(q.label_noise(rows), "value")


@query(
    "q08_novel_variant_placement",
    sql(
        f"""SELECT 'novel variant placement' AS check_name, count(*) = 0 AS passed, CAST(count(*) AS DOUBLE) AS value, 'none before the test start' AS requirement
FROM payments WHERE is_fraud AND k % 5 = 4 AND t < {PLAN.test}""",
        "payments",
    ),
)
def novel(spark, sf):
    p = _p(spark, sf).filter("is_fraud").withColumn("variant", F.concat(F.lit("V"), (F.col("k") % 5).cast("string")))
    return q.novel_placement(p, "V4", PLAN.test)


@query(
    "q09_duplicate_ids",
    sql(
        "SELECT 'identifier uniqueness' AS check_name, count(*) = count(DISTINCT tx_id) AS passed, CAST(count(*) - count(DISTINCT tx_id) AS DOUBLE) AS value, 'no duplicates' AS requirement FROM label_events",
        "label_events",
    ),
)
def duplicates(spark, sf):
    """Over label events, where a corrected payment does occur twice."""
    return q.duplicate_ids(operations.label_events(_p(spark, sf)))


@query(
    "q10_value_formats",
    sql(
        """SELECT 'value formats: ' || name AS check_name, n = 0 AS passed, CAST(n AS DOUBLE) AS value, 'no violations' AS requirement FROM (
  SELECT 'token_format' AS name, count(*) FILTER (WHERE NOT regexp_matches('tok_' || repeat(CAST(account AS VARCHAR), 12), '^tok_[A-Za-z0-9]{24,64}$')) AS n FROM payments
  UNION ALL SELECT 'mcc_format', count(*) FILTER (WHERE NOT regexp_matches(mcc, '^[0-9]{4}$')) FROM payments
  UNION ALL SELECT 'amount_scale', count(*) FILTER (WHERE cents % 10 <> 0) FROM payments
  UNION ALL SELECT 'coordinate_precision', count(*) FILTER (WHERE round(lat, 6) <> lat OR round(lon, 6) <> lon) FROM payments)""",
        "payments",
    ),
)
def formats(spark, sf):
    """Judged as a currency with one decimal, so that the scale check has something to find."""
    p = _p(spark, sf).withColumn("token", F.concat(F.lit("tok_"), F.repeat(F.col("account").cast("string"), F.lit(12))))
    return q.value_formats(p, ["token"], minor_units=1)


@query(
    "q12_distribution_checks",
    sql(
        """SELECT 'fraud rate' AS check_name, abs(avg(CAST(is_fraud AS INTEGER)) - 0.07::DOUBLE) * 100 <= 0.5 AS passed, round(avg(CAST(is_fraud AS INTEGER)), 6) AS value, '0.07 +/- 0.5 pp' AS requirement FROM payments
UNION ALL SELECT 'channel mix', max(d) <= 0.5, round(max(d), 6), 'within 0.5 pp' FROM (
  SELECT abs(coalesce(n, 0) / CAST((SELECT count(*) FROM payments) AS DOUBLE) - target) * 100 AS d
  FROM (VALUES ('MOBILE_MONEY', 0.2::DOUBLE), ('USSD', 0.2), ('AGENT_BANKING', 0.2), ('CARD', 0.2), ('ONLINE', 0.15), ('BANK_TRANSFER', 0.05)) m(channel, target)
  LEFT JOIN (SELECT channel, count(*) AS n FROM payments GROUP BY 1) USING (channel))
UNION ALL SELECT 'size', count(*) >= 5000000, CAST(count(*) AS DOUBLE), '>= 5000000' FROM payments
UNION ALL SELECT 'label before its payment', count(*) FILTER (WHERE label_at < t) = 0, CAST(count(*) FILTER (WHERE label_at < t) AS DOUBLE), 'none' FROM payments
UNION ALL SELECT 'null signatures per channel', count(*) = 0, CAST(count(*) AS DOUBLE), 'every fraud pattern also legitimate' FROM (
  SELECT DISTINCT channel, device IS NULL AS d, agent IS NULL AS a FROM payments WHERE is_fraud
  EXCEPT SELECT channel, device IS NULL, agent IS NULL FROM payments WHERE NOT is_fraud)""",
        "payments",
    ),
)
def distributions(spark, sf):
    p = _p(spark, sf)
    out = (
        q.fraud_rate(p, 0.07).unionByName(q.mix(p, "channel", MIX)).unionByName(q.size(p))
        .unionByName(q.early_labels(p)).unionByName(q.null_signature_check(p, ["device", "agent"]))
    )
    return rounded(out, "value")


@query(
    "q13_early_labels",
    sql(
        "SELECT 'label before its payment' AS check_name, count(*) = 0 AS passed, CAST(count(*) AS DOUBLE) AS value, 'none' AS requirement FROM payments WHERE label_at - 3600000000 < t",
        "payments",
    ),
)
def early(spark, sf):
    """With every label moved an hour earlier, so that some come too early."""
    return q.early_labels(_p(spark, sf).withColumn("label_at", F.col("label_at") - 3_600_000_000))


def _together_sql(group: str, nulls: str, size: int, rows: str) -> str:
    return f"""SELECT '{group} features missing together' AS check_name, count(*) FILTER (WHERE {nulls} BETWEEN 1 AND {size - 1}) = 0 AS passed,
  CAST(count(*) FILTER (WHERE {nulls} BETWEEN 1 AND {size - 1}) AS DOUBLE) AS value, 'all or none' AS requirement FROM {rows}"""


def _nulls(names) -> str:
    return "(" + " + ".join(f"CAST({n} IS NULL AS INTEGER)" for n in names) + ")"


@query(
    "q15_missing_together",
    sql(
        _together_sql("device", _nulls(registry.DEVICE_FEATURES), 4, "feats") + " UNION ALL "
        + _together_sql("agent", "(2 * CAST(p.agent IS NULL AS INTEGER) + 2 * CAST(s.agent IS NULL AS INTEGER))", 4,
                        "payments p LEFT JOIN (SELECT DISTINCT agent FROM standings) s ON s.agent = p.agent"),
        "payments",
        "standings",
        then=FEATURE_TABLE,
    ),
)
def missing_together(spark, sf):
    p = _p(spark, sf)
    hot = hot_keys(spark, sf, p)
    rows = ft.agent_pairs(ft.novelty(p, hot), hot)
    rows = ft.account_sweep(rows, hot)
    rows = ft.agent_sweep(ft.device_sweep(rows, hot), hot, _complete_standings(spark, sf))
    return q.missing_together(rows)


@query(
    "q15_partly_missing",
    sql(
        _together_sql("device", _nulls(registry.DEVICE_FEATURES), 4, "feats") + " UNION ALL " + _together_sql("agent", _nulls(registry.AGENT_FEATURES), 4, "feats"),
        "payments",
        then=FEATURE_TABLE,
    ),
)
def partly_missing(spark, sf):
    """Where an agent's standing begins later than its payments, two of its features are missing and two are not."""
    return q.missing_together(stored_features(spark, sf, []))


def _complete_standings(spark, sf) -> DataFrame:
    """Standings that are in force from the start, so that only agentless rows lack them."""
    return tables.standings(spark, sf).withColumn("effective_at", F.lit(EPOCH - DAY) + F.col("version"))


@query(
    "q16_t06_fingerprint",
    sql(
        """SELECT (SELECT count(*) FROM payments) AS rows, sha256(string_agg(row, chr(10) ORDER BY t, tx_id)) AS digest FROM (
  SELECT t, tx_id, '["' || tx_id || '","' || account || '","' || cents || '","' || channel || '"]' AS row FROM payments ORDER BY t, tx_id LIMIT 1024)""",
        "payments",
    ),
)
def fingerprint(spark, sf):
    return q.fingerprint(_p(spark, sf), ["tx_id", "account", "cents", "channel"], ["t", "tx_id"])


# ---- models --------------------------------------------------------------------------------------------------

CATEGORIES = ["feature_channel", "corridor_class"]


def model_matrix(spark, sf) -> DataFrame:
    """All features with the split and the encoded categories; written once, since fitting reads it often."""
    rows = matrix(spark, sf, keep=["account", "t", "is_fraud", "country"]).withColumnRenamed("channel", "feature_channel")
    path = f"{scratch_dir(spark, 'matrix')}/rows"
    models.training_matrix(rows, PLAN, CATEGORIES, hot_keys(spark, sf, _p(spark, sf))).write.parquet(path)
    return spark.read.parquet(path)


FEATURES = registry.trainable() + [f"{c}_rate" for c in CATEGORIES]
ENSEMBLE = (models.Boost(seed=7), models.Boost(depth=4, subsample=0.7, seed=11))


@query(
    "m01_training_matrix",
    sql(
        f"""SELECT segment, count(*) AS rows, count(*) FILTER (WHERE t >= {PLAN.calibration} AND t < {PLAN.embargo}) AS calibration FROM (
  SELECT t, CASE WHEN t < {PLAN.validation} THEN 'train' WHEN t < {PLAN.embargo} THEN 'validation' WHEN t < {PLAN.test} THEN 'embargo' ELSE 'test' END AS segment FROM payments)
GROUP BY segment""",
        "payments",
    ),
)
def training_matrix(spark, sf):
    return model_matrix(spark, sf).groupBy("segment").agg(
        F.count("*").alias("rows"), F.sum(F.col("calibration").cast("long")).alias("calibration")
    )


@query("m02_m03_boosted_ensemble")
def ensemble(spark, sf):
    """Calibrated scores of the test rows."""
    m = model_matrix(spark, sf)
    fitted = models.fit_ensemble(m, FEATURES, *ENSEMBLE)
    return fitted.score(m.filter("segment = 'test'")).select("tx_id", "is_fraud", "raw_score", "score")


@query("m04_m05_baselines")
def baselines(spark, sf):
    """Logistic regression, its Platt map, and a random forest on the same test rows."""
    return models.baselines(model_matrix(spark, sf), FEATURES)


@query("m06_isolation_forest")
def anomalies(spark, sf):
    m = model_matrix(spark, sf)
    forest = models.fit_isolation_forest(m.filter("segment = 'train'"), FEATURES)
    return forest.score(m.filter("segment = 'test'")).select("tx_id", "is_fraud", "anomaly")


@query("m07_m08_batch_scoring")
def batch_scoring(spark, sf):
    """Score, tier and the strongest contributions of every test payment, from the model that scored it."""
    from tidewatch.functions import reasons
    from tidewatch.operators.decide import tier

    m = model_matrix(spark, sf)
    model = models.fit_logistic(m, FEATURES)
    out = models.linear_contributions(model, model.score(m.filter("segment = 'test'")), FEATURES)
    return out.select(
        "tx_id", "score", tier(F.col("score")).alias("tier"),
        F.concat_ws(",", F.transform(reasons.top(F.col("contributions")), lambda c: c["feature"])).alias("top"),
    )


@query(
    "m08_contributions_add_up",
    sql(
        f"""SELECT tx_id, {len(FEATURES)} AS features, TRUE AS additive, TRUE AS ranked FROM payments WHERE t >= {PLAN.test}""",
        "payments",
    ),
)
def contributions_add_up(spark, sf):
    """Per test payment: base and contributions give the score's own logit within 1e-9, strongest first."""
    from tidewatch.functions import reasons

    m = model_matrix(spark, sf)
    model = models.fit_logistic(m, FEATURES)
    out = models.linear_contributions(model, model.score(m.filter("segment = 'test'")), FEATURES)
    total = F.col("base") + F.aggregate("contributions", F.lit(0.0), lambda a, c: a + c["shap"])
    top = reasons.top(F.col("contributions"))
    order = F.forall(F.sequence(F.lit(1), F.size(top) - 1), lambda k: F.abs(F.element_at(top, k)["shap"]) >= F.abs(F.element_at(top, k + 1)["shap"]))
    # The probability is compared where its logit would lose digits.
    near = F.abs(F.lit(1.0) / (F.lit(1.0) + F.exp(-total)) - F.col("score")) <= 1e-9
    return out.select("tx_id", F.size("contributions").alias("features"), near.alias("additive"), order.alias("ranked"))


@query("e17_ablations")
def ablation(spark, sf):
    m = model_matrix(spark, sf)
    groups: dict[str, list[str]] = {"category": [f"{c}_rate" for c in CATEGORIES]}
    for name in registry.trainable():
        groups.setdefault(registry.FEATURES[name].key, []).append(name)
    return models.ablations(m, groups)


@query("e18_leave_one_country_out")
def leave_one_out(spark, sf):
    m = model_matrix(spark, sf)
    held = m.filter("segment = 'test' and is_fraud").select("country").filter("country is not null").distinct()
    return models.leave_one_out(m, "country", sorted(r[0] for r in held.collect()), FEATURES)  # the countries of one pack


#: Seeds of the seed study, at the default size, and (trees, depth) of the size grid.
SEEDS = (1, 2, 3, 4, 5)
GRID = ((50, 3), (100, 4), (200, 5), (400, 6), (800, 8))


@query("e19_m09_seed_variance_and_size_grid")
def seeds(spark, sf):
    m = model_matrix(spark, sf)
    by_seed = models.seed_variance(m, FEATURES, list(SEEDS)).select(
        F.concat(F.lit("seed "), "seed").alias("run"), "auc", "recall"
    )
    by_size = models.size_grid(m, FEATURES, [models.Boost(trees, depth) for trees, depth in GRID]).select(
        F.concat_ws(" x ", "iterations", "depth").alias("run"), "auc", "recall"
    )
    return by_seed.unionByName(by_size)


