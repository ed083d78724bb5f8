"""Evaluation queries: rank metrics, calibration, encoding, stability, promotion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.operators import encode, evaluate as ev
from tidewatch.plans import operations, tables
from tidewatch.plans.registry import trainable
from tidewatch.queries.features import FEATURE_TABLE, hot_keys, stored_features
from tidewatch.queries.registry import query
from tidewatch.queries.views import EPOCH, sql

DAY = tables.DAY
PLAN = encode.Boundaries(EPOCH + 15 * DAY, EPOCH + 18 * DAY, EPOCH + 20 * DAY, EPOCH + 22 * DAY)


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    """Reals at a fixed number of places, so two engines' last bits do not matter."""
    return df.select(
        *[F.round(F.col(c).cast("double"), digits).alias(c) if c in names else F.col(c) for c in df.columns]
    )


def _hist(spark, sf) -> DataFrame:
    return ev.histogram(tables.payments(spark, sf))


_RANKED = """ranked AS (SELECT *, coalesce(sum(neg) OVER lower, 0) AS nb, coalesce(sum(pos) OVER lower, 0) AS pb,
  coalesce(sum(neg) OVER higher, 0) AS na, coalesce(sum(pos) OVER higher, 0) AS pa,
  sum(pos) OVER () AS P, sum(neg) OVER () AS N FROM histogram
  WINDOW lower AS (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
    higher AS (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""
_AUC = "CAST(sum(pos * (2 * nb + neg)) AS DOUBLE) / (2.0::DOUBLE * max(P) * max(N))"


@query("e00_score_histogram", sql("SELECT * FROM histogram", "histogram"))
def score_histogram(spark, sf):
    return _hist(spark, sf)


@query(
    "e01_auc",
    sql(
        f"SELECT CAST(max(P) AS BIGINT) AS pos, CAST(max(N) AS BIGINT) AS neg, round({_AUC}, 6) AS auc FROM ranked",
        "histogram",
        then=_RANKED,
    ),
)
def auc(spark, sf):
    return rounded(ev.auc(_hist(spark, sf)), "auc")


_SINGLE = trainable()


def _single_matrix(spark, sf):
    return stored_features(spark, sf, ["is_fraud", "t"])


_FEATURES = f"""{FEATURE_TABLE},
singles AS (SELECT is_fraud, t, {", ".join(f"CAST({n} AS DOUBLE) AS {n}" for n in _SINGLE)} FROM feats),
long AS (UNPIVOT (SELECT * EXCLUDE (t) FROM singles) ON {", ".join(_SINGLE)} INTO NAME name VALUE value),
fh AS (SELECT name, value AS score, count(*) FILTER (WHERE is_fraud) AS pos, count(*) FILTER (WHERE NOT is_fraud) AS neg
  FROM long WHERE value IS NOT NULL GROUP BY 1, 2),
fr AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY name ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nb,
  sum(pos) OVER (PARTITION BY name) AS P, sum(neg) OVER (PARTITION BY name) AS N FROM fh),
fa AS (SELECT name, CAST(max(P) AS BIGINT) AS pos, CAST(max(N) AS BIGINT) AS neg,
  CASE WHEN max(P) * max(N) > 0 THEN {_AUC} END AS auc FROM fr GROUP BY name)"""
_ERROR = """sqrt((auc * (1 - auc) + (pos - 1) * (auc / (2 - auc) - auc * auc)
  + (neg - 1) * (2 * auc * auc / (1 + auc) - auc * auc)) / (CAST(pos AS DOUBLE) * neg))"""


@query(
    "e02_feature_separation",
    sql(
        f"""SELECT name, pos, neg, round(auc, 6) AS auc, round(greatest(auc, 1 - auc), 6) AS separation,
  round({_ERROR}, 6) AS error FROM fa""",
        "payments",
        then=_FEATURES,
    ),
)
def feature_separation(spark, sf):
    return rounded(ev.feature_separation(_single_matrix(spark, sf), _SINGLE), "auc", "separation", "error")


_FOLD = """CAST(list_reduce(list_prepend(0, list_transform(string_split(CAST(account AS VARCHAR), ''), lambda c: ascii(c))),
  lambda a, b: CAST((CAST(a AS BIGINT) * 131 + b) % 2147483647 AS BIGINT)) % 5 AS INTEGER)"""


@query(
    "e03_out_of_fold_encoding",
    sql(
        """SELECT r.tx_id, r.fold, round((c.f - o.f + 50.0::DOUBLE * ((g.f - w.f) / CAST(g.n - w.n AS DOUBLE)))
  / (c.n - o.n + 50.0::DOUBLE), 6) AS encoded
FROM rows_ r
JOIN (SELECT channel, count(*) AS n, count(*) FILTER (WHERE is_fraud) AS f FROM rows_ GROUP BY 1) c USING (channel)
JOIN (SELECT channel, fold, count(*) AS n, count(*) FILTER (WHERE is_fraud) AS f FROM rows_ GROUP BY 1, 2) o
  ON o.channel = r.channel AND o.fold = r.fold
JOIN (SELECT fold, count(*) AS n, count(*) FILTER (WHERE is_fraud) AS f FROM rows_ GROUP BY 1) w ON w.fold = r.fold,
(SELECT count(*) AS n, count(*) FILTER (WHERE is_fraud) AS f FROM rows_) g""",
        "payments",
        then=f"rows_ AS (SELECT *, {_FOLD} AS fold FROM payments)",
    ),
)
def out_of_fold(spark, sf):
    rows = tables.payments(spark, sf).select("tx_id", "account", "channel", "is_fraud")
    return rounded(encode.out_of_fold(rows, "channel"), "encoded").select("tx_id", "fold", "encoded")


@query(
    "e04_expanding_encoding",
    sql(
        f"""SELECT tx_id, round((cf - ocf + 50.0::DOUBLE * CASE WHEN an - "on" > 0
    THEN (af - "of") / CAST(an - "on" AS DOUBLE) ELSE 0 END) / (cn - ocn + 50.0::DOUBLE), 6) AS encoded FROM (
  SELECT tx_id,
    coalesce(sum(y) OVER g, 0) AS af, count(*) OVER g AS an, coalesce(sum(y) OVER c, 0) AS cf, count(*) OVER c AS cn,
    coalesce(sum(y) OVER a, 0) AS "of", count(*) OVER a AS "on", coalesce(sum(y) OVER ac, 0) AS ocf, count(*) OVER ac AS ocn
  FROM (SELECT *, CAST(is_fraud AS INTEGER) AS y FROM payments WHERE t < {PLAN.validation})
  WINDOW g AS (ORDER BY t, tx_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
    c AS (PARTITION BY channel ORDER BY t, tx_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
    a AS (PARTITION BY account ORDER BY t, tx_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
    ac AS (PARTITION BY account, channel ORDER BY t, tx_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
UNION ALL
SELECT p.tx_id, round((f.f + 50.0::DOUBLE * b.base) / (f.n + 50.0::DOUBLE), 6) FROM payments p
JOIN (SELECT channel, count(*) AS n, count(*) FILTER (WHERE is_fraud) AS f FROM payments
      WHERE t < {PLAN.validation} GROUP BY 1) f USING (channel),
(SELECT count(*) FILTER (WHERE is_fraud) / CAST(count(*) AS DOUBLE) AS base FROM payments WHERE t < {PLAN.validation}) b
WHERE p.t >= {PLAN.validation}""",
        "payments",
    ),
)
def expanding(spark, sf):
    p = tables.payments(spark, sf)
    hot = hot_keys(spark, sf, p)
    rows = p.select("tx_id", "account", "t", "channel", "is_fraud")
    return rounded(
        encode.expanding(rows, "channel", F.col("t") < PLAN.validation, hot), "encoded"
    )


_SEGMENT = f"""CASE WHEN t < {PLAN.validation} THEN 'train' WHEN t < {PLAN.embargo} THEN 'validation'
  WHEN t < {PLAN.test} THEN 'embargo' ELSE 'test' END"""


@query(
    "e05_a08_segment_counts",
    sql(
        f"""SELECT segment, count(*) AS rows, round(avg(CAST(is_fraud AS INTEGER)), 6) AS fraud_rate,
  round((max(t) - min(t)) / 86400000000.0::DOUBLE, 6) AS span_days FROM (
  SELECT t, is_fraud, {_SEGMENT} AS segment FROM payments
  UNION ALL SELECT t, is_fraud, 'calibration' FROM payments WHERE t >= {PLAN.calibration} AND t < {PLAN.embargo})
GROUP BY segment""",
        "payments",
    ),
)
def segments(spark, sf):
    return rounded(encode.segment_counts(tables.payments(spark, sf), PLAN), "fraud_rate", "span_days")


@query(
    "e06_u04_split_overlap",
    sql(
        f"""SELECT count(*) AS shared FROM (SELECT tx_id FROM payments WHERE t < {PLAN.validation}
  INTERSECT SELECT tx_id FROM payments WHERE t >= {PLAN.test})""",
        "payments",
    ),
)
def split_overlap(spark, sf):
    p = tables.payments(spark, sf).withColumn("segment", PLAN.segment(F.col("t")))
    shared = encode.shared_rows(p.filter("segment = 'train'"), p.filter("segment = 'test'"))
    return shared.agg(F.count("*").alias("shared"))


@query(
    "e07_t05_recall_at_budget",
    sql(
        """SELECT score AS threshold, round(pa / CAST(P AS DOUBLE), 6) AS recall,
  round(pa / nullif(CAST(pa + na AS DOUBLE), 0), 6) AS precision, round(na / CAST(N AS DOUBLE), 6) AS realised_fpr,
  round(P / CAST(P + N AS DOUBLE), 6) AS base_rate
FROM ranked WHERE na <= greatest(0, floor(N * 0.01::DOUBLE) - 1) AND greatest(0, floor(N * 0.01::DOUBLE) - 1) < na + neg""",
        "histogram",
        then=_RANKED,
    ),
)
def budget(spark, sf):
    return rounded(ev.budget_point(_hist(spark, sf)), "recall", "precision", "realised_fpr", "base_rate")


@query(
    "e08_a06_operating_point",
    sql(
        """SELECT tp, fp, pos, neg, round(p, 6) AS precision, round(r, 6) AS recall,
  round(2 * p * r / (p + r), 6) AS f1, round(fp / CAST(neg AS DOUBLE), 6) AS fpr, round(1 - r, 6) AS fnr FROM (
  SELECT *, tp / CAST(tp + fp AS DOUBLE) AS p, tp / CAST(pos AS DOUBLE) AS r FROM (
  SELECT count(*) FILTER (WHERE is_fraud AND score >= 0.6::DOUBLE) AS tp,
    count(*) FILTER (WHERE NOT is_fraud AND score >= 0.6::DOUBLE) AS fp,
    count(*) FILTER (WHERE is_fraud) AS pos, count(*) FILTER (WHERE NOT is_fraud) AS neg FROM payments))""",
        "payments",
    ),
)
def operating_point(spark, sf):
    return rounded(
        ev.operating_point(_hist(spark, sf), ev.FLAG), "precision", "recall", "f1", "fpr", "fnr"
    )


_EQUAL_MASS = """placed AS (SELECT score, is_fraud, row_number() OVER (ORDER BY score, t, tx_id) - 1 AS i,
  count(*) OVER () AS n FROM payments),
mass AS (SELECT CASE WHEN i < (n % 15) * (n // 15 + 1) THEN i // (n // 15 + 1)
    ELSE n % 15 + (i - (n % 15) * (n // 15 + 1)) // (n // 15) END AS bin, count(*) AS rows,
  avg(score) AS predicted, avg(CAST(is_fraud AS INTEGER)) AS observed FROM placed GROUP BY 1),
width AS (SELECT least(14, CAST(floor(score * 15) AS BIGINT)) AS bin, count(*) AS rows,
  avg(score) AS predicted, avg(CAST(is_fraud AS INTEGER)) AS observed FROM payments GROUP BY 1)"""


def _equal_mass(spark, sf) -> DataFrame:
    p = tables.payments(spark, sf)
    return ev.equal_mass_bins(p, ["tx_id"], split=hot_keys(spark, sf, p).split("score"))


@query(
    "e09_equal_mass_bins",
    sql(
        "SELECT CAST(bin AS BIGINT) AS bin, rows, round(predicted, 6) AS predicted, round(observed, 6) AS observed FROM mass",
        "payments",
        then=_EQUAL_MASS,
    ),
)
def equal_mass(spark, sf):
    return rounded(_equal_mass(spark, sf), "predicted", "observed")


@query(
    "e09_calibration_error",
    sql(
        """SELECT (SELECT round(sum(rows * abs(predicted - observed)) / sum(rows), 6) FROM mass) AS ece_equal_mass,
  (SELECT round(sum(rows * abs(predicted - observed)) / sum(rows), 6) FROM width) AS ece_equal_width,
  (SELECT round(avg((score - CAST(is_fraud AS INTEGER)) * (score - CAST(is_fraud AS INTEGER))), 6) FROM payments) AS brier""",
        "payments",
        then=_EQUAL_MASS,
    ),
)
def calibration(spark, sf):
    p = tables.payments(spark, sf)
    k = F.lit(0).alias("k")
    mass = ev.calibration_error(_equal_mass(spark, sf)).select(F.col("ece").alias("ece_equal_mass"), k)
    width = ev.calibration_error(ev.equal_width_bins(p)).select(F.col("ece").alias("ece_equal_width"), k)
    out = mass.join(width, "k").join(ev.brier(p).select("brier", k), "k").drop("k")
    return rounded(out, "ece_equal_mass", "ece_equal_width", "brier")


def _reliability(where: str) -> str:
    return sql(
        f"""SELECT least(9, CAST(floor(score * 10) AS BIGINT)) AS bin, count(*) AS rows,
  round(avg(score), 6) AS predicted, round(avg(CAST(is_fraud AS INTEGER)), 6) AS observed
FROM payments WHERE {where} GROUP BY 1""",
        "payments",
    )


@query("e10_reliability", _reliability("TRUE"))
def reliability(spark, sf):
    return rounded(ev.equal_width_bins(tables.payments(spark, sf), 10), "predicted", "observed")


@query("e10_reliability_decision_region", _reliability("score >= 0.6::DOUBLE"))
def reliability_region(spark, sf):
    rows = tables.payments(spark, sf).filter(F.col("score") >= ev.FLAG)
    return rounded(ev.equal_width_bins(rows, 10), "predicted", "observed")


def gate_metrics(spark, sf) -> DataFrame:
    """(metric, value) for the gate table."""
    p = tables.payments(spark, sf)
    hist = _hist(spark, sf)
    flag = ev.operating_point(hist, ev.FLAG)
    block = ev.operating_point(hist, ev.BLOCK)
    per_channel = ev.auc(ev.histogram(p, group=["channel"]), ["channel"], few_groups=True)
    flagged = operations.contributions(p).filter(F.col("score") >= ev.FLAG)
    mass = ev.calibration_error(_equal_mass(spark, sf))

    def metric(df, name, column):
        return df.select(F.lit(name).alias("metric"), F.col(column).cast("double").alias("value"))

    out = metric(ev.auc(hist), "auc", "auc")
    for part in (
        metric(ev.budget_point(hist), "recall_at_1pct_fpr", "recall"),
        metric(flag, "recall_at_flag", "recall"),
        metric(flag, "f1_at_flag", "f1"),
        metric(block, "fpr_at_block", "fpr"),
        metric(flag, "fnr_at_flag", "fnr"),
        per_channel.select(F.concat(F.lit("auc_"), "channel").alias("metric"), F.col("auc").alias("value")),
        metric(flagged.agg(F.avg(F.col("explained").cast("double")).alias("x")), "explained_share", "x"),
        metric(mass, "ece_equal_mass", "ece"),
    ):
        out = out.unionByName(part)
    return out


_CHANNEL_AUC = """ch AS (SELECT channel, score, count(*) FILTER (WHERE is_fraud) AS pos,
  count(*) FILTER (WHERE NOT is_fraud) AS neg FROM payments GROUP BY 1, 2),
cr AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY channel ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nb,
  sum(pos) OVER (PARTITION BY channel) AS P, sum(neg) OVER (PARTITION BY channel) AS N FROM ch),
ca AS (SELECT channel, CASE WHEN max(P) * max(N) > 0 THEN CAST(sum(pos * (2 * nb + neg)) AS DOUBLE) / (2.0::DOUBLE * max(P) * max(N)) END AS auc,
  CAST(max(P) AS BIGINT) AS pos, CAST(max(N) AS BIGINT) AS neg FROM cr GROUP BY 1)"""


@query(
    "e11_gate_table",
    sql(
        f"""SELECT gate, metric, round(value, 6) AS value, threshold, at_least,
  CASE WHEN value IS NULL THEN FALSE WHEN at_least THEN value >= threshold ELSE value < threshold END AS passed
FROM (VALUES ('ML-GATE-01', 'auc', 0.94::DOUBLE, TRUE), ('ML-GATE-02', 'recall_at_1pct_fpr', 0.72, TRUE),
  ('ML-GATE-03', 'recall_at_flag', 0.88, TRUE), ('ML-GATE-04', 'f1_at_flag', 0.8, TRUE),
  ('ML-GATE-05', 'fpr_at_block', 0.015, FALSE), ('ML-GATE-06', 'fnr_at_flag', 0.12, FALSE),
  ('ML-GATE-07', 'auc_MOBILE_MONEY', 0.92, TRUE), ('ML-GATE-08', 'auc_USSD', 0.9, TRUE),
  ('ML-GATE-09', 'auc_AGENT_BANKING', 0.91, TRUE), ('ML-GATE-10', 'explained_share', 1.0, TRUE),
  ('ML-GATE-11', 'ece_equal_mass', 0.05, FALSE)) g(gate, metric, threshold, at_least)
LEFT JOIN (
  SELECT 'auc' AS metric, {_AUC} AS value FROM ranked
  UNION ALL SELECT 'recall_at_1pct_fpr', pa / CAST(P AS DOUBLE) FROM ranked
    WHERE na <= greatest(0, floor(N * 0.01::DOUBLE) - 1) AND greatest(0, floor(N * 0.01::DOUBLE) - 1) < na + neg
  UNION ALL SELECT 'recall_at_flag', tp / pos FROM op
  UNION ALL SELECT 'f1_at_flag', 2 * (tp / (tp + fp)) * (tp / pos) / (tp / (tp + fp) + tp / pos) FROM op
  UNION ALL SELECT 'fpr_at_block', fb / neg FROM op
  UNION ALL SELECT 'fnr_at_flag', 1 - tp / pos FROM op
  UNION ALL SELECT 'auc_' || channel, auc FROM ca
  UNION ALL SELECT 'explained_share', avg(CASE WHEN k % 10 <> 0 THEN 1.0::DOUBLE ELSE 0 END) FROM payments WHERE score >= 0.6::DOUBLE
  UNION ALL SELECT 'ece_equal_mass', sum(rows * abs(predicted - observed)) / sum(rows) FROM mass) m USING (metric)""",
        "payments",
        "histogram",
        then=_RANKED + ",\n" + _CHANNEL_AUC + ",\n" + _EQUAL_MASS + """,
op AS (SELECT CAST(count(*) FILTER (WHERE is_fraud AND score >= 0.6::DOUBLE) AS DOUBLE) AS tp,
  count(*) FILTER (WHERE NOT is_fraud AND score >= 0.6::DOUBLE) AS fp,
  count(*) FILTER (WHERE NOT is_fraud AND score >= 0.85::DOUBLE) AS fb,
  count(*) FILTER (WHERE is_fraud) AS pos, CAST(count(*) FILTER (WHERE NOT is_fraud) AS DOUBLE) AS neg FROM payments)""",
    ),
)
def gates(spark, sf):
    return rounded(ev.gate_table(gate_metrics(spark, sf)), "value")


@query("e12_bootstrap_intervals")
def bootstrap(spark, sf):
    return ev.bootstrap(_hist(spark, sf), resamples=1000, seed=7)


@query(
    "e13_delong",
    sql(
        """SELECT round(a1, 6) AS auc_first, round(a2, 6) AS auc_second, round((a1 - a2) / sqrt(v1 + v2), 4) AS z FROM (
  SELECT avg(va) FILTER (WHERE is_fraud) AS a1, avg(vb) FILTER (WHERE is_fraud) AS a2,
    var_samp(va - vb) FILTER (WHERE is_fraud) / count(*) FILTER (WHERE is_fraud) AS v1,
    var_samp(va - vb) FILTER (WHERE NOT is_fraud) / count(*) FILTER (WHERE NOT is_fraud) AS v2
  FROM (SELECT is_fraud, CASE WHEN is_fraud THEN (n1 + e1 / 2) / N ELSE 1 - (p1 + q1 / 2) / P END AS va,
      CASE WHEN is_fraud THEN (n2 + e2 / 2) / N ELSE 1 - (p2 + q2 / 2) / P END AS vb FROM (
    SELECT is_fraud, CAST(count(*) FILTER (WHERE is_fraud) OVER () AS DOUBLE) AS P,
      CAST(count(*) FILTER (WHERE NOT is_fraud) OVER () AS DOUBLE) AS N,
      count(*) FILTER (WHERE NOT is_fraud) OVER (ORDER BY score RANGE UNBOUNDED PRECEDING)
        - count(*) FILTER (WHERE NOT is_fraud) OVER (PARTITION BY score) AS n1,
      count(*) FILTER (WHERE NOT is_fraud) OVER (PARTITION BY score) AS e1,
      count(*) FILTER (WHERE is_fraud) OVER (ORDER BY score RANGE UNBOUNDED PRECEDING)
        - count(*) FILTER (WHERE is_fraud) OVER (PARTITION BY score) AS p1,
      count(*) FILTER (WHERE is_fraud) OVER (PARTITION BY score) AS q1,
      count(*) FILTER (WHERE NOT is_fraud) OVER (ORDER BY score2 RANGE UNBOUNDED PRECEDING)
        - count(*) FILTER (WHERE NOT is_fraud) OVER (PARTITION BY score2) AS n2,
      count(*) FILTER (WHERE NOT is_fraud) OVER (PARTITION BY score2) AS e2,
      count(*) FILTER (WHERE is_fraud) OVER (ORDER BY score2 RANGE UNBOUNDED PRECEDING)
        - count(*) FILTER (WHERE is_fraud) OVER (PARTITION BY score2) AS p2,
      count(*) FILTER (WHERE is_fraud) OVER (PARTITION BY score2) AS q2
    FROM second_scores)))""",
        "second_scores",
    ),
)
def delong(spark, sf):
    rows = tables.payments(spark, sf).withColumn("score2", operations.second_score())
    out = ev.delong(rows, "score", "score2").select("auc_first", "auc_second", "z")
    return rounded(rounded(out, "auc_first", "auc_second"), "z", digits=4)


_RULE = """rh AS (SELECT CAST(cents >= 20000 AS INTEGER) + CAST((t // 3600000000) % 24 < 5 AS INTEGER) AS score,
  count(*) FILTER (WHERE is_fraud) AS pos, count(*) FILTER (WHERE NOT is_fraud) AS neg FROM payments GROUP BY 1),
rr AS (SELECT *, coalesce(sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nb,
  sum(pos) OVER () AS P, sum(neg) OVER () AS N FROM rh)"""


def trivial_rule(p: DataFrame) -> DataFrame:
    """0, 1 or 2 of: a large amount, the small hours."""
    night = F.expr("(t div 3600000000) % 24 < 5").cast("int")
    return p.select("is_fraud", ((F.col("cents") >= 20_000).cast("int") + night).alias("score"))


@query(
    "q06_trivial_rule_auc",
    sql(f"SELECT round({_AUC}, 6) AS auc FROM rr", "payments", then=_RULE),
)
def trivial_rule_auc(spark, sf):
    out = ev.auc(ev.histogram(trivial_rule(tables.payments(spark, sf))))
    return rounded(out.select("auc"), "auc")


@query(
    "e14_best_single_feature",
    sql(
        f"""SELECT round(max(CASE WHEN pos + neg = total THEN greatest(auc, 1 - auc) END), 6) AS best_full,
  round(max(greatest(auc, 1 - auc)), 6) AS best_any, round(max(rule), 6) AS rule, round(max(model), 6) AS model,
  round(max(model) - greatest(max(CASE WHEN pos + neg = total THEN greatest(auc, 1 - auc) END), max(rule)), 6) AS margin
FROM fa, (SELECT count(*) AS total FROM payments), (SELECT {_AUC} AS rule FROM rr), (SELECT {_AUC} AS model FROM ranked)""",
        "payments",
        "histogram",
        then=_FEATURES + ",\n" + _RULE + ",\n" + _RANKED,
    ),
)
def best_single(spark, sf):
    p = tables.payments(spark, sf)
    k = F.lit(0).alias("k")
    single = ev.feature_separation(_single_matrix(spark, sf), _SINGLE).select("*", k)
    total = p.agg(F.count("*").alias("total")).select("*", k)
    best = (
        single.join(F.broadcast(total), "k")
        .groupBy("k")
        .agg(
            F.max(F.when(F.col("pos") + F.col("neg") == F.col("total"), F.col("separation"))).alias("best_full"),
            F.max("separation").alias("best_any"),
        )
    )
    rule = ev.auc(ev.histogram(trivial_rule(p))).select(F.col("auc").alias("rule"), k)
    model = ev.auc(_hist(spark, sf)).select(F.col("auc").alias("model"), k)
    out = best.join(rule, "k").join(model, "k").drop("k")
    out = out.withColumn("margin", F.col("model") - F.greatest("best_full", "rule"))
    return rounded(out, *out.columns)


_POINT = """SELECT score AS thr FROM ranked WHERE na <= greatest(0, floor(N * 0.01::DOUBLE) - 1)
  AND greatest(0, floor(N * 0.01::DOUBLE) - 1) < na + neg"""


def _wilson(k: str, n: str, sign: str) -> str:
    return f"""(({k} / CAST({n} AS DOUBLE) + 3.8416::DOUBLE / (2 * {n}))
  {sign} 1.96::DOUBLE * sqrt({k} / CAST({n} AS DOUBLE) * (1 - {k} / CAST({n} AS DOUBLE)) / {n} + 3.8416::DOUBLE / (4.0::DOUBLE * {n} * {n})))
  / (1 + 3.8416::DOUBLE / {n})"""


@query(
    "e15_by_variant",
    sql(
        f"""SELECT variant, fraud, detected, thr AS threshold, round(detected / CAST(fraud AS DOUBLE), 6) AS recall,
  round(greatest(0.0::DOUBLE, {_wilson("detected", "fraud", "-")}), 6) AS recall_low,
  round(least(1.0::DOUBLE, {_wilson("detected", "fraud", "+")}), 6) AS recall_high FROM (
  SELECT 'V' || CAST(k % 5 AS VARCHAR) AS variant, count(*) AS fraud, count(*) FILTER (WHERE score > thr) AS detected,
    max(thr) AS thr FROM payments, ({_POINT}) WHERE is_fraud GROUP BY 1)""",
        "payments",
        "histogram",
        then=_RANKED,
    ),
)
def by_variant(spark, sf):
    p = tables.payments(spark, sf)
    rows = p.withColumn("variant", F.concat(F.lit("V"), (F.col("k") % 5).cast("string")))
    return rounded(ev.by_variant(rows, "variant"), "recall", "recall_low", "recall_high")


_DIMS = """dims AS (SELECT 'channel' AS dimension, channel AS value, score, is_fraud FROM located
  UNION ALL SELECT 'country', country, score, is_fraud FROM located
  UNION ALL SELECT 'all', '*', score, is_fraud FROM located),
dh AS (SELECT dimension, value, score, count(*) FILTER (WHERE is_fraud) AS pos,
  count(*) FILTER (WHERE NOT is_fraud) AS neg FROM dims GROUP BY 1, 2, 3),
dr AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY dimension, value ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nb
  FROM dh)"""


@query(
    "e16_a19_breakdown",
    sql(
        """SELECT dimension, value, CAST(sum(pos) AS BIGINT) AS pos, CAST(sum(neg) AS BIGINT) AS neg,
  round(CAST(sum(pos * (2 * nb + neg)) AS DOUBLE) / nullif(2.0::DOUBLE * sum(pos) * sum(neg), 0), 6) AS auc
FROM dr GROUP BY 1, 2""",
        "located",
        then=_DIMS,
    ),
)
def breakdown(spark, sf):
    """One pass over the rows for every dimension."""
    p = tables.with_countries(tables.payments(spark, sf), spark, sf)
    dims = F.explode(
        F.array(
            F.struct(F.lit("channel").alias("dimension"), F.col("channel").alias("value")),
            F.struct(F.lit("country").alias("dimension"), F.col("country").alias("value")),
            F.struct(F.lit("all").alias("dimension"), F.lit("*").alias("value")),
        )
    ).alias("d")
    rows = p.select("score", "is_fraud", dims).select("score", "is_fraud", "d.*")
    keys = ["dimension", "value"]
    return rounded(ev.auc(ev.histogram(rows, group=keys), keys), "auc")


def _psi_sql(rows: str, keys: str) -> str:
    """rows: (keys, v, side) with side 'e' or 'a'."""
    on = " AND ".join(f"{{0}}.{k} = {{1}}.{k}" for k in keys.split(", "))
    return f"""src AS ({rows}),
ranks AS (SELECT {keys}, v, row_number() OVER (PARTITION BY {keys} ORDER BY v) - 1 AS i, count(*) OVER (PARTITION BY {keys}) AS n
  FROM src WHERE side = 'e'),
edges AS (SELECT {keys}, list(v) AS edge FROM ranks
  WHERE i IN (least(n - 1, n // 10), least(n - 1, 2 * n // 10), least(n - 1, 3 * n // 10), least(n - 1, 4 * n // 10),
    least(n - 1, 5 * n // 10), least(n - 1, 6 * n // 10), least(n - 1, 7 * n // 10), least(n - 1, 8 * n // 10),
    least(n - 1, 9 * n // 10)) GROUP BY {keys}),
placed_ AS (SELECT s.*, len(list_filter(edge, lambda e: s.v > e)) AS bin FROM src s JOIN edges g ON {on.format("s", "g")}),
cells AS (SELECT {keys}, bin, count(*) FILTER (WHERE side = 'e') AS ec, count(*) FILTER (WHERE side = 'a') AS ac FROM placed_ GROUP BY {keys}, bin),
sizes AS (SELECT {keys}, count(*) FILTER (WHERE side = 'e') AS en, count(*) FILTER (WHERE side = 'a') AS an FROM src GROUP BY {keys}),
shares AS (SELECT {", ".join("z." + k for k in keys.split(", "))}, greatest(coalesce(ec, 0) / CAST(en AS DOUBLE), 1e-4::DOUBLE) AS e,
  greatest(coalesce(ac, 0) / CAST(an AS DOUBLE), 1e-4::DOUBLE) AS a
  FROM sizes z CROSS JOIN range(10) b(bin_) LEFT JOIN cells c ON {on.format("c", "z")} AND c.bin = bin_)"""


@query(
    "e20_psi",
    sql(
        "SELECT round(sum((a - e) * ln(a / e)), 6) AS psi FROM shares",
        "second_scores",
        then=_psi_sql(
            "SELECT 0 AS g, score AS v, 'e' AS side FROM second_scores UNION ALL SELECT 0, score2, 'a' FROM second_scores",
            "g",
        ),
    ),
)
def psi(spark, sf):
    p = tables.payments(spark, sf).withColumn("score2", operations.second_score())
    out = ev.psi(p.select(F.col("score").alias("s")), p.select(F.col("score2").alias("s")), "s")
    return rounded(out, "psi")


@query(
    "n19_feature_drift",
    sql(
        "SELECT name, round(sum((a - e) * ln(a / e)), 6) AS psi, sum((a - e) * ln(a / e)) > 0.2 AS drifted FROM shares GROUP BY name",
        "payments",
        then=_FEATURES
        + f""",
drift AS (UNPIVOT (SELECT * EXCLUDE (is_fraud) FROM singles) ON {", ".join(_SINGLE)} INTO NAME name VALUE value),
"""
        + _psi_sql(
            f"SELECT name, value AS v, CASE WHEN t < {PLAN.validation} THEN 'e' ELSE 'a' END AS side FROM drift WHERE value IS NOT NULL",
            "name",
        ),
    ),
)
def feature_drift(spark, sf):
    """Each feature's stability, the later half of the month against the earlier."""
    long = ev.unpivot_features(_single_matrix(spark, sf), _SINGLE, ["t"])
    before, after = long.filter(F.col("t") < PLAN.validation), long.filter(F.col("t") >= PLAN.validation)
    out = ev.psi(before, after, "value", ["name"], few_groups=True)
    return rounded(out.withColumn("drifted", F.col("psi") > 0.2), "psi")


_SHADOW = f"""lab AS (SELECT tx_id, is_fraud FROM payments WHERE label_at <= {EPOCH + 20 * DAY}),
joined AS (SELECT s.tx_id, s.score AS production, s.score2 AS shadow, l.is_fraud FROM second_scores s LEFT JOIN lab l USING (tx_id)),
au AS (SELECT avg(CASE WHEN f.shadow > n.shadow THEN 1.0 WHEN f.shadow = n.shadow THEN 0.5 ELSE 0 END)
  - avg(CASE WHEN f.production > n.production THEN 1.0 WHEN f.production = n.production THEN 0.5 ELSE 0 END) AS delta
  FROM joined f, joined n WHERE f.is_fraud AND NOT n.is_fraud)"""


@query(
    "e21_e22_j15_shadow_gate",
    sql(
        """SELECT scored, round(coverage, 6) AS label_coverage, round(diff, 6) AS mean_abs_diff, round(delta, 6) AS auc_delta,
  round(psi, 6) AS psi, concat_ws(',', CASE WHEN scored < 50000 THEN 'scored' END, CASE WHEN coverage < 0.3 THEN 'coverage' END,
    CASE WHEN coverage >= 0.3 AND delta < -0.01 THEN 'auc_delta' END, CASE WHEN psi >= 0.2 THEN 'psi' END) AS reasons,
  scored >= 50000 AND coverage >= 0.3 AND delta >= -0.01 AND psi < 0.2 AS promote
FROM (SELECT count(*) AS scored, count(is_fraud) / CAST(count(*) AS DOUBLE) AS coverage, avg(abs(production - shadow)) AS diff FROM joined),
  au, (SELECT sum((a - e) * ln(a / e)) AS psi FROM shares)""",
        "second_scores",
        then=_SHADOW
        + ",\n"
        + _psi_sql(
            "SELECT 0 AS g, score AS v, 'e' AS side FROM second_scores UNION ALL SELECT 0, score2, 'a' FROM second_scores",
            "g",
        ),
    ),
)
def shadow(spark, sf):
    p = tables.payments(spark, sf)
    now = EPOCH + 20 * DAY
    scored = p.select("tx_id", F.col("score").alias("production"), operations.second_score().alias("shadow"))
    labels = p.filter(F.col("label_at") <= now)
    out = ev.shadow_gate(scored, labels, EPOCH, now).withColumn("reasons", F.concat_ws(",", "reasons"))
    return rounded(out, "label_coverage", "mean_abs_diff", "auc_delta", "psi")


@query(
    "e24_roc_points",
    sql(
        """SELECT score AS threshold, round((pa + pos) / CAST(P AS DOUBLE), 6) AS tpr,
  round((na + neg) / CAST(N AS DOUBLE), 6) AS fpr FROM ranked""",
        "histogram",
        then=_RANKED,
    ),
)
def roc(spark, sf):
    return rounded(ev.roc_points(_hist(spark, sf)), "tpr", "fpr")


@query(
    "e23_explanation_checks",
    sql(
        """SELECT round(max(abs(total - margin)), 6) AS additivity_error,
  round(avg(CASE WHEN score >= 0.6::DOUBLE THEN CASE WHEN explained THEN 1.0 ELSE 0 END END), 6) AS covered
FROM (SELECT tx_id, sum(shap) AS total, round(sum(shap), 2) AS margin, any_value(score) AS score,
  bool_or(explained) AS explained FROM contributions GROUP BY tx_id)""",
        "contributions",
    ),
)
def explanations(spark, sf):
    """Margins are kept at two places here, so the additivity error is the rounding."""
    c = operations.contributions(tables.payments(spark, sf))
    total = F.aggregate("contributions", F.lit(0.0), lambda a, x: a + x["shap"])
    rows = c.withColumn("total", total).withColumn("margin", F.round("total", 2))
    out = rows.agg(
        F.max(F.abs(F.col("total") - F.col("margin"))).alias("additivity_error"),
        F.avg(F.when(F.col("score") >= ev.FLAG, F.col("explained").cast("double"))).alias("covered"),
    )
    return rounded(out, "additivity_error", "covered")
