"""Dashboards, portfolio reports and alert rules over recorded decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.operators import evaluate as ev, monitor
from tidewatch.plans import operations, tables
from tidewatch.queries.evaluation import rounded
from tidewatch.queries.registry import query
from tidewatch.queries.views import EPOCH, sql

DAY, HOUR, MINUTE = tables.DAY, tables.HOUR, 60_000_000
NOW = EPOCH + 25 * DAY


def _p(spark, sf) -> DataFrame:
    return tables.payments(spark, sf)


@query(
    "n09_dashboard",
    sql(
        f"""SELECT (SELECT count(*) FROM alerts WHERE status <> 'DECIDED' AND tier = 'HIGH') AS open_high,
  (SELECT count(*) FROM alerts WHERE status <> 'DECIDED' AND tier = 'MEDIUM') AS open_medium,
  (SELECT count(*) FROM alerts WHERE status <> 'DECIDED' AND tier = 'ANOMALY') AS open_anomaly,
  (SELECT count(*) FROM states WHERE decision = 'DECLINE' AND "at" >= {NOW - DAY} AND "at" < {NOW}) AS blocked_today,
  (SELECT count(*) FROM alert_decisions WHERE created_at >= {NOW - DAY} AND created_at < {NOW}) AS reviewed_today,
  (SELECT CAST(coalesce(sum(cents), 0) AS BIGINT) FROM alert_decisions WHERE decision = 'CONFIRM_FRAUD' AND created_at >= {NOW - DAY} AND created_at < {NOW}) AS prevented_cents,
  (SELECT round(avg(duration_s), 6) FROM alert_decisions WHERE created_at >= {NOW - DAY} AND created_at < {NOW}) AS mean_review_s""",
        "states",
        "alert_decisions",
    ),
)
def dashboard(spark, sf):
    p = _p(spark, sf)
    k = F.lit(0).alias("k")
    waiting = F.col("status") != "DECIDED"
    open_ = operations.alerts(p).agg(
        *[F.sum((waiting & (F.col("tier") == t)).cast("long")).alias(f"open_{t.lower()}") for t in ("HIGH", "MEDIUM", "ANOMALY")]
    )
    today = lambda c: (F.col(c) >= NOW - DAY) & (F.col(c) < NOW)
    blocked = operations.decision_states(p).agg(
        F.sum(((F.col("decision") == "DECLINE") & today("at")).cast("long")).alias("blocked_today")
    )
    reviewed = operations.alert_decisions(p).filter(today("created_at")).agg(
        F.count("*").alias("reviewed_today"),
        F.coalesce(F.sum(F.when(F.col("decision") == "CONFIRM_FRAUD", F.col("cents"))), F.lit(0)).alias("prevented_cents"),
        F.avg("duration_s").alias("mean_review_s"),
    )
    out = open_.select("*", k).join(blocked.select("*", k), "k").join(reviewed.select("*", k), "k").drop("k")
    return rounded(out, "mean_review_s")


@query(
    "n10_analyst_performance",
    sql(
        """SELECT a.analyst_id, reviewed, mean_s, backlog, accuracy FROM
  (SELECT analyst_id, count(*) FILTER (WHERE status <> 'DECIDED') AS backlog FROM alerts GROUP BY 1) a
LEFT JOIN (SELECT analyst_id, count(*) AS reviewed, round(avg(duration_s), 6) AS mean_s,
    round(avg(CASE WHEN decision <> 'ESCALATE' THEN CASE WHEN (decision = 'CONFIRM_FRAUD') = (label = 'FRAUD') THEN 1.0 ELSE 0 END END), 6) AS accuracy
  FROM alert_decisions JOIN (SELECT tx_id, arg_max(label, (label_at, label_id)) AS label FROM label_events GROUP BY 1) USING (tx_id)
  JOIN commits USING (decision_id) GROUP BY 1) d USING (analyst_id)""",
        "commits",
        "label_events",
    ),
)
def performance(spark, sf):
    """Committed decisions only; accuracy against the payment's current label."""
    from tidewatch.operators.asof import latest

    p = _p(spark, sf)
    labels = latest(operations.label_events(p), ["tx_id"], ["label_at", "label_id"], ["label"])
    done = operations.alert_decisions(p).join(operations.decision_commits(p), "decision_id").join(labels, "tx_id")
    right = (F.col("decision") == "CONFIRM_FRAUD") == (F.col("label") == "FRAUD")
    worked = done.groupBy("analyst_id").agg(
        F.count("*").alias("reviewed"), F.avg("duration_s").alias("mean_s"),
        F.avg(F.when(F.col("decision") != "ESCALATE", right.cast("double"))).alias("accuracy"),
    )
    backlog = operations.alerts(p).groupBy("analyst_id").agg(
        F.sum((F.col("status") != "DECIDED").cast("long")).alias("backlog")
    )
    return rounded(backlog.join(worked, "analyst_id", "left"), "mean_s", "accuracy")


@query(
    "n11_portfolio_summary",
    sql(
        """SELECT week, channel, mcc, n, fraud, CAST(prevented AS BIGINT) AS prevented_cents, round(fraud / CAST(n AS DOUBLE), 6) AS rate FROM (
  SELECT t // 604800000000 AS week, channel, mcc, count(*) AS n, count(*) FILTER (WHERE is_fraud) AS fraud,
    coalesce(sum(cents) FILTER (WHERE score >= 0.85::DOUBLE), 0) AS prevented
  FROM payments GROUP BY GROUPING SETS ((t // 604800000000), (t // 604800000000, channel), (t // 604800000000, mcc)))""",
        "payments",
    ),
)
def portfolio(spark, sf):
    p = _p(spark, sf).withColumn("week", F.expr("t div 604800000000"))
    week, channel, mcc = F.col("week"), F.col("channel"), F.col("mcc")
    out = p.groupingSets([[week], [week, channel], [week, mcc]], week, channel, mcc).agg(
        F.count("*").alias("n"), F.sum(F.col("is_fraud").cast("long")).alias("fraud"),
        F.coalesce(F.sum(F.when(F.col("score") >= 0.85, F.col("cents"))), F.lit(0)).alias("prevented_cents"),
    )
    return rounded(out.withColumn("rate", F.col("fraud") / F.col("n")), "rate")


@query(
    "n11_t07_top_counterparties",
    sql(
        "SELECT counterparty, count(*) AS fraud, CAST(sum(cents) AS BIGINT) AS cents FROM payments WHERE is_fraud GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
        "payments",
    ),
)
def top_counterparties(spark, sf):
    return (
        _p(spark, sf).filter("is_fraud").groupBy("counterparty")
        .agg(F.count("*").alias("fraud"), F.sum("cents").alias("cents"))
        .orderBy(F.desc("fraud"), "counterparty").limit(10)
    )


@query(
    "n12_heat_map",
    sql(
        """SELECT cell, CAST(sum(n) AS BIGINT) AS events, CAST(sum(f) AS BIGINT) AS fraud FROM (
  SELECT CASE WHEN n >= 10 THEN cell ELSE 'other' END AS cell, n, f FROM
    (SELECT cell, count(*) AS n, count(*) FILTER (WHERE is_fraud) AS f FROM payments GROUP BY 1)) GROUP BY 1 HAVING sum(n) >= 10""",
        "payments",
    ),
)
def heat_map(spark, sf):
    return monitor.suppressed_cells(_p(spark, sf), "cell")


def hourly_auc(p: DataFrame, now: int) -> DataFrame:
    """Per hour: coverage by labels known an hour later plus a day, and the AUC over them."""
    known = F.col("label_at") <= (F.col("t") - F.col("t") % HOUR) + HOUR + DAY
    rows = p.withColumn("bucket", F.expr(f"t div {HOUR * 24} * {HOUR * 24}")).withColumn("known", known)
    cover = rows.groupBy("bucket").agg(F.avg(F.col("known").cast("double")).alias("coverage"))
    scored = ev.auc(ev.histogram(rows.filter("known"), group=["bucket"]), ["bucket"])
    return cover.join(scored.select("bucket", "auc"), "bucket", "left")


_LIVE = f"""live AS (SELECT *, t // {24 * HOUR} * {24 * HOUR} AS bucket, label_at <= (t - t % {HOUR}) + {HOUR + DAY} AS known FROM payments),
lh AS (SELECT bucket, score, count(*) FILTER (WHERE is_fraud) AS pos, count(*) FILTER (WHERE NOT is_fraud) AS neg FROM live WHERE known GROUP BY 1, 2),
lr AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY bucket ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nb FROM lh),
la AS (SELECT bucket, CASE WHEN sum(pos) * sum(neg) > 0 THEN CAST(sum(pos * (2 * nb + neg)) AS DOUBLE) / (2.0::DOUBLE * sum(pos) * sum(neg)) END AS auc FROM lr GROUP BY 1),
lc AS (SELECT bucket, avg(CAST(known AS INTEGER)) AS coverage FROM live GROUP BY 1),
lj AS (SELECT bucket, coverage, auc, CASE WHEN coverage >= 0.3::DOUBLE THEN auc END AS covered_auc FROM lc LEFT JOIN la USING (bucket))"""


@query(
    "n13_live_model_performance",
    sql("SELECT bucket, round(coverage, 6) AS coverage, round(auc, 6) AS auc FROM lj", "payments", then=_LIVE),
)
def live_performance(spark, sf):
    return rounded(hourly_auc(_p(spark, sf), NOW), "coverage", "auc")


@query(
    "n14_auc_drop",
    sql(
        f"""SELECT bucket, round(baseline, 6) AS baseline, covered_days, coalesce(covered_auc < baseline - 0.03::DOUBLE AND covered_days >= 3, FALSE) AS alarm FROM (
  SELECT *, avg(covered_auc) OVER w AS baseline, count(covered_auc) OVER w AS covered_days FROM lj
  WINDOW w AS (ORDER BY bucket RANGE BETWEEN {30 * DAY - 1} PRECEDING AND CURRENT ROW))""",
        "payments",
        then=_LIVE,
    ),
)
def auc_drop(spark, sf):
    """Daily buckets here, so the baseline asks for three covered ones."""
    out = monitor.auc_drops(hourly_auc(_p(spark, sf), NOW), min_hours=3)
    return rounded(
        out.select("bucket", "baseline", F.col("covered_hours").alias("covered_days"), "alarm"), "baseline"
    )


_HIGH = f"""hourly AS (SELECT channel, t // {HOUR * 6} * {HOUR * 6} AS bucket, count(*) FILTER (WHERE score >= 0.85::DOUBLE) / CAST(count(*) AS DOUBLE) AS ratio
  FROM payments GROUP BY 1, 2)"""


@query(
    "n15_high_share_anomaly",
    sql(
        f"""SELECT channel, bucket, round(ratio, 6) AS ratio, round(mean, 6) AS mean, round(sigma, 6) AS sigma,
  abs(ratio - mean) > 1.0::DOUBLE * sigma AND past IS NOT NULL AS alarm FROM (
  SELECT *, avg(ratio) OVER w AS mean, stddev_pop(ratio) OVER w AS sigma,
    max(ratio) OVER (PARTITION BY channel ORDER BY bucket RANGE BETWEEN {7 * DAY} PRECEDING AND {7 * DAY} PRECEDING) AS past FROM hourly
  WINDOW w AS (PARTITION BY channel ORDER BY bucket RANGE BETWEEN {30 * DAY - 1} PRECEDING AND CURRENT ROW))""",
        "payments",
        then=_HIGH,
    ),
)
def high_share(spark, sf):
    """Six-hour buckets and one deviation, so that this data has alarms."""
    b = monitor.buckets(_p(spark, sf), "t", 6 * HOUR, ["channel"], high=F.sum((F.col("score") >= 0.85).cast("long")))
    rows = b.select("channel", "bucket", (F.col("high") / F.col("n")).alias("ratio"))
    return rounded(monitor.share_anomalies(rows, ["channel"], sigmas=1.0), "ratio", "mean", "sigma")


@query(
    "n16_auto_block_rate",
    sql(
        f"""SELECT bucket, n, round(n / 900.0::DOUBLE, 6) AS rate, round(total / span / 900.0::DOUBLE, 6) AS mean_rate,
  n / 900.0::DOUBLE > 3 * (total / span / 900.0::DOUBLE) AND n / 900.0::DOUBLE > 0.0001::DOUBLE AS alarm FROM (
  SELECT bucket, n, sum(n) OVER (ORDER BY bucket RANGE BETWEEN {7 * DAY - 1} PRECEDING AND CURRENT ROW) AS total,
    least(672, 1 + (bucket - min(bucket) OVER ()) / {15 * MINUTE}) AS span
  FROM (SELECT "at" // {15 * MINUTE} * {15 * MINUTE} AS bucket, count(*) AS n FROM states WHERE decision = 'DECLINE' AND seq = 1 GROUP BY 1))""",
        "states",
    ),
)
def auto_blocks(spark, sf):
    blocked = operations.decision_states(_p(spark, sf)).filter("decision = 'DECLINE' and seq = 1")
    out = monitor.rate_anomalies(monitor.buckets(blocked, "at", 15 * MINUTE, []), floor_per_s=0.0001)
    return rounded(out, "rate", "mean_rate")


@query(
    "n17_timeout_release_share",
    sql(
        f"""SELECT channel, bucket, holds, released, round(released / CAST(holds AS DOUBLE), 6) AS share,
  released / CAST(holds AS DOUBLE) > 0.3::DOUBLE AND holds >= 5 AS alarm FROM (
  SELECT channel, "at" // {DAY} * {DAY} AS bucket, count(*) AS holds, count(*) FILTER (WHERE tx_id NOT IN (SELECT tx_id FROM states WHERE seq > 1)) AS released
  FROM states WHERE seq = 1 AND decision = 'HOLD' GROUP BY 1, 2)""",
        "states",
    ),
)
def timeout_share(spark, sf):
    """Daily buckets with a floor of five holds."""
    s = operations.decision_states(_p(spark, sf))
    answered = s.filter("seq > 1").select("tx_id", F.lit(True).alias("answered")).distinct()
    holds = s.filter("seq = 1 and decision = 'HOLD'").join(answered, "tx_id", "left")
    b = monitor.buckets(holds, "at", DAY, ["channel"], released=F.sum(F.col("answered").isNull().cast("long")))
    share = F.col("released") / F.col("n")
    out = b.select("channel", "bucket", F.col("n").alias("holds"), "released", share.alias("share"),
                   ((share > 0.3) & (F.col("n") >= 5)).alias("alarm"))
    return rounded(out, "share")


@query(
    "n18_traffic_drop",
    sql(
        f"""SELECT bucket, n, round(n / 300.0::DOUBLE, 6) AS rate, round(w / 300.0::DOUBLE, 6) AS week_ago,
  coalesce(n / 300.0::DOUBLE < 0.8::DOUBLE * (w / 300.0::DOUBLE) AND w / 300.0::DOUBLE > 0.004::DOUBLE, FALSE) AS alarm FROM (
  SELECT bucket, n, max(n) OVER (ORDER BY bucket RANGE BETWEEN {7 * DAY} PRECEDING AND {7 * DAY} PRECEDING) AS w
  FROM (SELECT t // {5 * MINUTE} * {5 * MINUTE} AS bucket, count(*) AS n FROM payments GROUP BY 1))""",
        "payments",
    ),
)
def traffic_drop(spark, sf):
    out = monitor.traffic_drops(monitor.buckets(_p(spark, sf), "t", 5 * MINUTE, []), floor=0.004)
    return rounded(out, "rate", "week_ago")


@query(
    "n19_false_positive_rate",
    sql(
        """SELECT week, round(fp / CAST(neg AS DOUBLE), 6) AS fpr, fp / CAST(neg AS DOUBLE) > 0.05::DOUBLE AS alarm FROM (
  SELECT t // 604800000000 AS week, count(*) FILTER (WHERE NOT is_fraud AND score >= 0.6::DOUBLE) AS fp, count(*) FILTER (WHERE NOT is_fraud) AS neg FROM payments GROUP BY 1)""",
        "payments",
    ),
)
def false_positives(spark, sf):
    p = _p(spark, sf).withColumn("week", F.expr("t div 604800000000"))
    point = ev.operating_point(ev.histogram(p, group=["week"]), ev.FLAG, ["week"])
    return rounded(point.select("week", "fpr", (F.col("fpr") > 0.05).alias("alarm")), "fpr")


@query(
    "n20_fallback_ratio",
    sql(
        f"""SELECT t // {5 * MINUTE} * {5 * MINUTE} AS bucket, count(*) AS n, round(count(*) FILTER (WHERE cents % 50 = 0) / CAST(count(*) AS DOUBLE), 6) AS ratio FROM payments GROUP BY 1""",
        "payments",
    ),
)
def fallback_ratio(spark, sf):
    b = monitor.buckets(_p(spark, sf), "t", 5 * MINUTE, [], f=F.sum((F.col("cents") % 50 == 0).cast("long")))
    return rounded(b.select("bucket", "n", (F.col("f") / F.col("n")).alias("ratio")), "ratio")


@query(
    "n20_latency_quantiles",
    sql(
        f"""SELECT bucket, quantile_cont(l, 0.5) AS p50, round(quantile_cont(l, 0.95), 6) AS p95, round(quantile_cont(l, 0.99), 6) AS p99
FROM (SELECT t // {DAY} * {DAY} AS bucket, cents % 400 + 5 AS l FROM payments) GROUP BY 1""",
        "payments",
    ),
)
def latency(spark, sf):
    """Exact quantiles of recorded latencies per day."""
    from tidewatch.operators.order import quantiles

    rows = _p(spark, sf).select(F.expr(f"t div {DAY} * {DAY}").alias("bucket"), (F.col("cents") % 400 + 5).alias("l"))
    return rounded(quantiles(rows, "l", {"p50": 0.5, "p95": 0.95, "p99": 0.99}, ["bucket"]), "p50", "p95", "p99")


