"""What is kept, merged and replayed: summaries, live performance, reports, prefixes, rule checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.operators import ledger, quality, rules
from tidewatch.operators import features as ft
from tidewatch.plans import tables
from tidewatch.plans.registry import FEATURES
from tidewatch.queries import keyed
from tidewatch.queries.decisions import RULES
from tidewatch.queries.evaluation import rounded
from tidewatch.queries.features import hot_keys, matrix, prior
from tidewatch.queries.registry import query
from tidewatch.queries.streams import SPLIT, payments, scratch
from tidewatch.queries.views import EPOCH, sql
from tidewatch.streaming import history

DAY, HOUR = tables.DAY, tables.HOUR
NOW = EPOCH + 25 * DAY


@query(
    "a05_merged_account_summary",
    sql(
        f"""SELECT p.account, min(t) AS first_seen, max(t) AS last_seen, arg_min(lat, (-t, tx_id)) AS last_lat,
  arg_min(lon, (-t, tx_id)) AS last_lon, count(*) AS n, any_value(f.opened_at) AS opened_at,
  array_to_string(list_sort(list(DISTINCT counterparty)), ',') AS counterparties,
  coalesce(array_to_string(list_sort(list(DISTINCT device) FILTER (WHERE device IS NOT NULL)), ','), '') AS devices,
  coalesce(array_to_string(list_sort(list(DISTINCT counterparty_country) FILTER (WHERE counterparty_country IS NOT NULL)), ','), '') AS countries
FROM located p LEFT JOIN profiles f ON f.account = p.account WHERE t < {NOW} GROUP BY p.account""",
        "located",
        "profiles",
    ),
)
def merged_summary(spark, sf):
    """Three summaries, of a first part, of a second one by odd ids and by even ones, merged."""
    p = tables.with_countries(payments(spark, sf), spark, sf).filter(F.col("t") < NOW)
    late, odd = F.col("t") >= SPLIT, F.col("tx_id") % 2 == 1
    parts = [ledger.summarise(p.filter(c)) for c in (~late, late & odd, late & ~odd)]
    out = ledger.read_summary(ledger.merge_summaries(*parts), tables.profiles(spark, sf))
    return out.withColumns({n: F.array_join(F.col(n).cast("array<string>"), ",") for n in ("counterparties", "devices", "countries")})


# ---- live performance -------------------------------------------------------------------------------------------

_PSI = " + ".join(
    f"(greatest(b{b} / CAST(total AS DOUBLE), 1e-4::DOUBLE) - greatest(e{b} / CAST(e_total AS DOUBLE), 1e-4::DOUBLE))"
    f" * ln(greatest(b{b} / CAST(total AS DOUBLE), 1e-4::DOUBLE) / greatest(e{b} / CAST(e_total AS DOUBLE), 1e-4::DOUBLE))" for b in range(10))
_BINS = ", ".join(f"count(*) FILTER (WHERE least(floor(score * 10), 9) = {b}) AS {{0}}{b}" for b in range(10))


@query(
    "n13_live_performance_from_histograms",
    sql(
        f"""SELECT day, payments, known, round(coverage, 6) AS coverage, round(auc, 6) AS auc, round(tp / nullif(tp + fp, 0), 6) AS "precision",
  round(tp / nullif(tp + fn, 0), 6) AS recall, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1, round(fp / nullif(fp + tn, 0), 6) AS fpr,
  round({_PSI}, 6) AS psi, {_PSI} > 0.2::DOUBLE AS drifts
FROM (SELECT day, count(*) AS payments, count(*) FILTER (WHERE known) AS known, count(*) FILTER (WHERE known) / CAST(count(*) AS DOUBLE) AS coverage,
    CAST(count(*) FILTER (WHERE known AND is_fraud AND score >= 0.6::DOUBLE) AS DOUBLE) AS tp, CAST(count(*) FILTER (WHERE known AND NOT is_fraud AND score >= 0.6::DOUBLE) AS DOUBLE) AS fp,
    CAST(count(*) FILTER (WHERE known AND is_fraud AND score < 0.6::DOUBLE) AS DOUBLE) AS fn, CAST(count(*) FILTER (WHERE known AND NOT is_fraud AND score < 0.6::DOUBLE) AS DOUBLE) AS tn,
    count(*) AS total, {_BINS.format("b")} FROM live GROUP BY day)
  JOIN (SELECT day, CASE WHEN sum(pos) * sum(neg) > 0 THEN CAST(sum(pos * (2 * nb + neg)) AS DOUBLE) / (2.0::DOUBLE * sum(pos) * sum(neg)) END AS auc
    FROM (SELECT *, coalesce(sum(neg) OVER (PARTITION BY day ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nb
      FROM (SELECT day, score, count(*) FILTER (WHERE known AND is_fraud) AS pos, count(*) FILTER (WHERE known AND NOT is_fraud) AS neg FROM live GROUP BY 1, 2)) GROUP BY day) USING (day),
  (SELECT count(*) AS e_total, {_BINS.format("e")} FROM live WHERE day < {EPOCH + 7 * DAY})""",
        "payments",
        then=f"live AS (SELECT *, t // {DAY} * {DAY} AS day, label_at <= {NOW} AS known FROM payments WHERE t < {NOW})",
    ),
)
def live_performance(spark, sf):
    """Histograms are stored twice, before and after the labels of a week came in, and merged when they are read."""
    path, p = f"{scratch(spark)}/histograms", payments(spark, sf).filter(F.col("t") < NOW)
    day, early = F.expr(f"t div {DAY} * {DAY}"), F.col("label_at") <= NOW - 7 * DAY
    first = ledger.daily_histogram(p, day, early)
    # Labels that came later add their counts; their payments are counted already.
    late = ledger.daily_histogram(p.filter(~early & (F.col("label_at") <= NOW)), day, F.lit(True)).withColumn("all", F.lit(0).cast("long"))
    for part in (first, late):
        part.write.mode("append").parquet(path)
    hist = ledger.merge_histograms(spark.read.parquet(path))
    out = ledger.performance(hist, F.col("day") < EPOCH + 7 * DAY, 0.6)
    return rounded(out, "coverage", "auc", "precision", "recall", "f1", "fpr", "psi")


# ---- reports that have gone stale ---------------------------------------------------------------------------------


@query(
    "q17_stale_reports",
    sql(
        """SELECT request, CASE WHEN request = 'as stored' THEN 'read' ELSE 'refused' END AS outcome,
  CASE WHEN request = 'as stored' THEN channel END AS channel, CASE WHEN request = 'as stored' THEN n END AS n
FROM (SELECT channel, count(*) AS n FROM payments GROUP BY 1 HAVING count(*) >= 5) JOIN (VALUES ('as stored')) r(request) ON TRUE
UNION ALL SELECT request, 'refused', NULL, NULL FROM (VALUES ('another parameter'), ('another check'), ('other data')) r(request)""",
        "payments",
    ),
)
def stale_reports(spark, sf):
    """One stored report, asked for as it was made, and with another parameter, check set or data."""
    p, path = payments(spark, sf), f"{scratch(spark)}/report"
    results = p.groupBy("channel").agg(F.count(F.lit(1)).alias("n")).filter("n >= 5")
    data = quality.fingerprint(p, ["tx_id", "cents"], ["tx_id"]).first()["digest"]
    made = (["channel size"], {"minimum": 5}, data)
    ledger.store_report(results, path, *made)
    asked = {
        "as stored": made, "another parameter": (made[0], {"minimum": 6}, data), "another check": (["channel size", "mix"], made[1], data),
        "other data": (made[0], made[1], quality.fingerprint(p.filter("cents > 0"), ["tx_id", "cents"], ["cents", "tx_id"]).first()["digest"]),
    }
    none = F.lit(None)
    out: DataFrame | None = None
    for request, key in asked.items():
        try:
            rows = ledger.read_report(spark, path, results.schema, *key).select(F.lit(request).alias("request"), F.lit("read").alias("outcome"), "channel", "n")
        except ledger.StaleReport:
            rows = spark.range(1).select(
                F.lit(request).alias("request"), F.lit("refused").alias("outcome"), none.cast("string").alias("channel"), none.cast("long").alias("n"))
        out = rows if out is None else out.unionByName(rows)
    return out


# ---- declared and observed, rules and their problems -----------------------------------------------------------------

_DECLARED = {"account": "varying", "device": "varying", "agent": "varying", "mcc": "varying", "one": "constant", "nothing": "absent", "cents": "constant"}


@query(
    "q14_computability",
    sql(
        " UNION ALL ".join(
            f"""SELECT '{n}' AS name, '{d}' AS declared, CASE count(DISTINCT {n}) WHEN 0 THEN 'absent' WHEN 1 THEN 'constant' ELSE 'varying' END AS observed,
  round(1 - count({n}) / CAST(count(*) AS DOUBLE), 6) AS missing_rate,
  CASE count(DISTINCT {n}) WHEN 0 THEN 'absent' WHEN 1 THEN 'constant' ELSE 'varying' END = '{d}' AS agrees FROM planted""" for n, d in _DECLARED.items()),
        "payments",
        then="planted AS (SELECT *, 1 AS one, CAST(NULL AS BIGINT) AS nothing FROM payments)",
    ),
)
def computability(spark, sf):
    """A constant and an absent column are declared as such, and one that varies is declared constant."""
    rows = payments(spark, sf).withColumn("one", F.lit(1)).withColumn("nothing", F.lit(None).cast("long")).select(*_DECLARED)
    return rounded(quality.computability(rows.withColumn("mcc", F.col("mcc").cast("long")), _DECLARED), "missing_rate")


_BROKEN = [
    rules.Rule("unknown_column", {"field": "nowhere", "op": "eq", "value": 1}),
    rules.Rule("text_for_number", {"all": [{"field": "cents", "op": "gte", "value": "many"}, {"field": "channel", "op": "gt", "value": 3}]}),
    rules.Rule("low_above_high", {"not": {"field": "cents", "op": "between", "value": [9, 2]}}),
    rules.Rule("empty_list", {"field": "channel", "op": "in", "value": []}),
]


@query(
    "d02_rule_checks",
    sql(
        """SELECT name, NULL AS place, count(*) FILTER (WHERE hit) AS matches FROM (
  SELECT 'large_remote' AS name, amount >= 150 AND channel IN ('CARD', 'ONLINE') AS hit FROM payments
  UNION ALL SELECT 'agent_out_of_range', coalesce(NOT (agent BETWEEN 2 AND 7), FALSE) FROM payments) GROUP BY 1
UNION ALL SELECT * FROM (VALUES ('unknown_column', 'expression.field', CAST(NULL AS BIGINT)), ('text_for_number', 'expression.all[0].value', NULL),
  ('text_for_number', 'expression.all[1].value', NULL), ('low_above_high', 'expression.not.value', NULL), ('empty_list', 'expression.value', NULL))""",
        "payments",
    ),
)
def rule_checks(spark, sf):
    """Every problem of every rule, and what the sound ones match; a rule with a problem is never run."""
    p = payments(spark, sf)
    out: DataFrame | None = None
    for rule in [*(r for r in RULES if r.name in ("large_remote", "agent_out_of_range")), *_BROKEN]:
        found = rules.problems(rule, p.schema)
        if found:
            rows = spark.createDataFrame([(rule.name, path, None) for path, _ in found], "name string, place string, matches long")
        else:
            hit = F.coalesce(rules.compile_rule(rule, p.schema), F.lit(False))
            rows = p.agg(F.sum(hit.cast("long")).alias("matches")).select(F.lit(rule.name).alias("name"), F.lit(None).cast("string").alias("place"), "matches")
        out = rows if out is None else out.unionByName(rows)
    return out


# ---- parity -----------------------------------------------------------------------------------------------------------

_ENDS = [EPOCH + 4 * DAY, EPOCH + 9 * DAY, SPLIT, EPOCH + 400 * DAY]
_IN_PREFIX = " + ".join(f"CAST(t < {e} AS BIGINT)" for e in _ENDS)
_NAMES = ", ".join(f"('{n}')" for n in FEATURES)


@query(
    "q18_prefix_parity",
    sql(f"SELECT feature, compared, CAST(0 AS BIGINT) AS different FROM (VALUES {_NAMES}) f(feature), (SELECT CAST(sum({_IN_PREFIX}) AS BIGINT) AS compared FROM payments)", "payments"),
)
def prefix_parity(spark, sf):
    """All 44 features of every row at every prefix of the history, against those of the whole history.

    Each prefix knows its own rows alone. One pass answers all prefixes; a feature that looked ahead would differ.
    """
    p = tables.with_countries(payments(spark, sf), spark, sf)
    many = ledger.Prefixes(_ENDS)
    base = prior(payments(spark, sf))
    replayed = ft.feature_matrix(
        many.rows(p, "t", ["tx_id", "account", "counterparty", "device", "agent"], ["cell"]), prior=base, countries=tables.countries(spark, sf),
        limits=tables.limits(spark, sf), tiers=many.facts(tables.tiers(spark, sf), ["account"]), swaps=many.facts(tables.sim_swaps(spark, sf), ["account"]),
        profiles=many.facts(tables.profiles(spark, sf), ["account"]), standings=many.facts(tables.standings(spark, sf), ["agent"]),
    )
    # Each side is read once, so it goes into the comparison without being written.
    again = replayed.withColumn("tx_id", F.expr(f"tx_id div {len(_ENDS)}"))
    return ledger.compared_by_feature(again, matrix(spark, sf), "tx_id", list(FEATURES), lambda n: FEATURES[n].dtype == "double")


_STREAMED = {
    "account": (history.ACCOUNT, ["tx_count_60s", "tx_count_1h", "tx_count_24h", "tx_count_7d", "unique_counterparties_24h", "device_changes_24h"]),
    "counterparty": (history.COUNTERPARTY, ["counterparty_unique_senders_24h", "counterparty_confirmed_fraud_90d"]),
    "device": (history.DEVICE, ["accounts_per_device_7d"]),
    "agent": (history.AGENT, ["agent_cashout_count_1h", "agent_unique_customers_1h"]),
}


@query(
    "q18_incremental_parity",
    " UNION ALL ".join(
        f"SELECT '{n}' AS feature, count(*) AS compared, CAST(0 AS BIGINT) AS different FROM p{' WHERE ' + k + ' IS NOT NULL' if k in ('device', 'agent') else ''}"
        for k, (_, names) in _STREAMED.items() for n in names).join([sql("", "payments").replace("payments AS", "p AS", 1), ""]),
)
def incremental_parity(spark, sf):
    """Features that keyed state answered as the rows came in, over a restart, against the batch stages."""
    path, out = scratch(spark), None
    matrix(spark, sf).write.parquet(f"{path}/whole")
    for spec, names in _STREAMED.values():
        rows = ledger.compared_by_feature(keyed.answers(spark, sf, spec), spark.read.parquet(f"{path}/whole"), "tx_id", names, lambda n: False)
        out = rows if out is None else out.unionByName(rows)
    return out
