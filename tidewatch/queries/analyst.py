"""Alert queues, account history, behaviour profiles and the joins behind them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import reasons
from tidewatch.operators import analyst, asof, audit, graph
from tidewatch.operators import aggregates as ag
from tidewatch.operators.order import spread, time_index
from tidewatch.plans import operations, tables
from tidewatch.queries.evaluation import rounded
from tidewatch.queries.features import hot_keys
from tidewatch.queries.registry import query
from tidewatch.queries.views import EPOCH, sql

DAY = tables.DAY
NOW = EPOCH + 25 * DAY


def _p(spark, sf) -> DataFrame:
    return tables.payments(spark, sf)


# ---- filters and pages ------------------------------------------------------------------------------

FILTER = analyst.AlertFilter(
    amount_min=20, amount_max=300, channels=["CARD", "ONLINE", "USSD"], since=EPOCH + 5 * DAY,
    until=EPOCH + 20 * DAY, tiers=["HIGH", "MEDIUM"],
)
_WHERE = f"""amount >= 20 AND amount <= 300 AND channel IN ('CARD', 'ONLINE', 'USSD') AND t >= {EPOCH + 5 * DAY}
  AND t < {EPOCH + 20 * DAY} AND tier IN ('HIGH', 'MEDIUM') AND status IN ('PENDING', 'IN_REVIEW')"""


@query("p07_alert_filter", sql(f"SELECT alert_id, tier, status FROM alerts WHERE {_WHERE}", "alerts"))
def alert_filter(spark, sf):
    return analyst.alert_filter(operations.alerts(_p(spark, sf)), FILTER).select("alert_id", "tier", "status")


@query(
    "p09_role_visibility",
    sql(
        """SELECT alert_id, target_role FROM alerts a WHERE escalated_from IS NULL OR target_role = 'SENIOR_ANALYST'
  OR EXISTS (SELECT 1 FROM alert_decisions d WHERE d.alert_id = a.escalated_from AND d.decision = 'ESCALATE' AND d.analyst_id = 3)""",
        "alerts",
        "alert_decisions",
    ),
)
def visible(spark, sf):
    p = _p(spark, sf)
    out = analyst.visible_to(operations.alerts(p), operations.alert_decisions(p), "SENIOR_ANALYST", 3)
    return out.select("alert_id", "target_role")


@query("p10_tenant_filter", sql("SELECT alert_id, tier FROM alerts WHERE institution = 'I2'", "alerts"))
def tenant(spark, sf):
    return analyst.for_institution(operations.alerts(_p(spark, sf)), "I2").select("alert_id", "tier")


_RANK = "CASE tier WHEN 'HIGH' THEN 0 WHEN 'MEDIUM' THEN 1 ELSE 2 END"


@query(
    "n01_t01_j05_alert_queue_page",
    sql(
        f"""SELECT a.alert_id, a.tier, fraud_probability, s.revision, p.mcc,
  row_number() OVER (ORDER BY {_RANK}, -fraud_probability, a.alert_id) AS position, TRUE AS has_more
FROM alerts a JOIN payments p ON p.tx_id = a.tx_id
JOIN scores s ON s.tx_id = a.tx_id AND s.scored_at = a.created_at
WHERE a.tier IN ('HIGH', 'MEDIUM') AND escalated_from IS NULL AND status IN ('PENDING', 'IN_REVIEW')
  AND (CAST({_RANK} AS DOUBLE), -fraud_probability, a.alert_id) > (0.0::DOUBLE, -0.93::DOUBLE, 0)
ORDER BY {_RANK}, -fraud_probability, a.alert_id LIMIT 20""",
        "alerts",
        "scores",
    ),
)
def queue_page(spark, sf):
    p = _p(spark, sf)
    full = analyst.alert_queue(operations.alerts(p), p, operations.scores(p))
    standard = full.filter("tier in ('HIGH', 'MEDIUM') and escalated_from is null")
    waiting = analyst.alert_filter(standard, analyst.AlertFilter())
    out = analyst.page(waiting, analyst.priority_keys(), "alert_id", 20, after=(0.0, -0.93, 0))
    return out.select("alert_id", "tier", "fraud_probability", "revision", "mcc", "position", "has_more")


@query(
    "t02_anomaly_order",
    sql(
        """SELECT alert_id, row_number() OVER (ORDER BY -coalesce(anomaly, -1), alert_id) AS position FROM alerts
WHERE tier = 'ANOMALY' AND escalated_from IS NULL ORDER BY -coalesce(anomaly, -1), alert_id LIMIT 25""",
        "alerts",
    ),
)
def anomaly_order(spark, sf):
    rows = operations.alerts(_p(spark, sf)).filter("tier = 'ANOMALY' and escalated_from is null")
    return analyst.page(rows, analyst.priority_keys("ANOMALY"), "alert_id", 25).select("alert_id", "position")


@query(
    "t02_expected_loss_order",
    sql(
        """SELECT alert_id, row_number() OVER (ORDER BY -fraud_probability * cents, alert_id) AS position
FROM alerts ORDER BY -fraud_probability * cents, alert_id LIMIT 25""",
        "alerts",
    ),
)
def loss_order(spark, sf):
    rows = operations.alerts(_p(spark, sf)).withColumn("expected_loss", F.col("fraud_probability") * F.col("cents"))
    return analyst.page(rows, analyst.expected_loss_keys(), "alert_id", 25).select("alert_id", "position")


@query(
    "n03_t03_account_history",
    sql(
        """SELECT tx_id, revision, score, decision, CASE WHEN decision IN ('APPROVE', 'TIMEOUT_RELEASE') THEN 'APPROVED'
  WHEN decision = 'DECLINE' THEN 'BLOCKED' ELSE 'PENDING' END AS outcome, row_number() OVER (ORDER BY t DESC, tx_id DESC) AS position
FROM (SELECT tx_id, t FROM payments WHERE account = 7) JOIN
  (SELECT tx_id, arg_max(revision, scored_at) AS revision, arg_max(score, scored_at) AS score FROM scores GROUP BY 1) USING (tx_id)
LEFT JOIN (SELECT tx_id, arg_max(decision, seq) AS decision FROM states GROUP BY 1) USING (tx_id)
ORDER BY t DESC, tx_id DESC LIMIT 30""",
        "scores",
        "states",
    ),
)
def account_history(spark, sf):
    p = _p(spark, sf)
    history = analyst.scored_history(p, operations.scores(p), operations.decision_states(p))
    mine = history.filter(F.col("account") == 7).withColumn("neg_id", -F.col("tx_id"))
    out = analyst.page(mine, [-F.col("t")], "neg_id", 30)
    return out.select("tx_id", "revision", "score", "decision", "outcome", "position")


@query(
    "j04_x22_latest_score_and_state",
    sql(
        """SELECT tx_id, revision, decision, CASE WHEN decision IN ('APPROVE', 'TIMEOUT_RELEASE') THEN 'APPROVED'
  WHEN decision = 'DECLINE' THEN 'BLOCKED' ELSE 'PENDING' END AS outcome FROM
  (SELECT tx_id, arg_max(revision, scored_at) AS revision FROM scores GROUP BY 1)
LEFT JOIN (SELECT tx_id, arg_max(decision, seq) AS decision FROM states GROUP BY 1) USING (tx_id)""",
        "scores",
        "states",
    ),
)
def latest_views(spark, sf):
    p = _p(spark, sf)
    out = analyst.scored_history(p, operations.scores(p), operations.decision_states(p))
    return out.select("tx_id", "revision", "decision", "outcome")


@query(
    "j04_latest_label",
    sql("SELECT tx_id, arg_max(label, (label_at, label_id)) AS label FROM label_events GROUP BY 1", "label_events"),
)
def latest_label(spark, sf):
    return asof.latest(operations.label_events(_p(spark, sf)), ["tx_id"], ["label_at", "label_id"], ["label"])


@query("n08_scoring_result", sql("SELECT tx_id, revision, score, anomaly, fallback FROM scores WHERE tx_id = 105", "scores"))
def scoring_result(spark, sf):
    return operations.scores(_p(spark, sf)).filter(F.col("tx_id") == 105).select(
        "tx_id", "revision", "score", "anomaly", "fallback"
    )


@query(
    "n02_t04_x23_explanation",
    sql(
        """SELECT tx_id, feature, round(shap, 6) AS shap, row_number() OVER (PARTITION BY tx_id ORDER BY abs(shap) DESC, feature) AS rank
FROM contributions QUALIFY rank <= 5""",
        "contributions",
    ),
)
def explanation(spark, sf):
    """The five strongest contributions, read back from the stored JSON."""
    c = operations.contributions(_p(spark, sf))
    stored = c.select("tx_id", F.to_json("contributions").alias("stored"))
    parsed = F.from_json("stored", "array<struct<feature:string,shap:double>>")
    out = stored.select("tx_id", F.posexplode(reasons.top(parsed, 5)).alias("i", "c"))
    return rounded(out.select("tx_id", F.col("c.feature").alias("feature"), F.col("c.shap").alias("shap"),
                              (F.col("i") + 1).cast("long").alias("rank")), "shap")


@query(
    "x21_summary_key",
    sql(
        """SELECT tx_id, CASE WHEN any_value(fallback) THEN 'summary.rule_fallback'
  ELSE 'summary.' || arg_min(feature, (-abs(shap), feature)) END AS summary FROM contributions GROUP BY tx_id""",
        "contributions",
    ),
)
def summary(spark, sf):
    c = operations.contributions(_p(spark, sf))
    tier = operations.tier_of(F.col("score"))
    return c.select("tx_id", reasons.summary_key(tier, F.col("fallback"), F.col("contributions")).alias("summary"))


@query(
    "a18_mean_contributions",
    sql("SELECT feature, round(avg(abs(shap)), 6) AS mean_abs FROM contributions GROUP BY 1", "contributions"),
)
def mean_contributions(spark, sf):
    return rounded(ag.mean_contributions(operations.contributions(_p(spark, sf))), "mean_abs")


# ---- joined status views ------------------------------------------------------------------------------


@query(
    "j06_decision_states",
    sql(
        """SELECT d.decision_id, CASE WHEN c.decision_id IS NOT NULL THEN 'COMMITTED' WHEN u.decision_id IS NOT NULL THEN 'UNDONE'
  ELSE 'PENDING_COMMIT' END AS state, committed_at, undone_at
FROM alert_decisions d LEFT JOIN commits c USING (decision_id) LEFT JOIN undos u USING (decision_id)""",
        "commits",
        "undos",
    ),
)
def decision_views(spark, sf):
    p = _p(spark, sf)
    out = analyst.decision_views(
        operations.alert_decisions(p), operations.decision_commits(p), operations.decision_undos(p)
    )
    return out.select("decision_id", "state", "committed_at", "undone_at")


def _blocks(p):
    states = operations.decision_states(p)
    blocks = states.filter("seq = 1 and decision = 'DECLINE'").select("tx_id", "account", F.col("at").alias("blocked_at"))
    answers = operations.label_events(p).filter("label_id % 2 = 1").select("tx_id", F.col("label").alias("answer"))
    unblocks = p.filter((F.col("score") >= 0.85) & (F.col("k") % 4 <= 1)).select("tx_id", (F.col("t") + DAY).alias("unblocked_at"))
    notices = p.filter((F.col("score") >= 0.85) & (F.col("cents") % 3 != 0)).select("tx_id")
    return states, blocks, answers, unblocks, notices


_BLOCKS = """blocks AS (SELECT tx_id, account, "at" AS blocked_at FROM states WHERE seq = 1 AND decision = 'DECLINE'),
unblocks AS (SELECT tx_id, t + 86400000000 AS unblocked_at FROM payments WHERE score >= 0.85::DOUBLE AND k % 4 <= 1)"""


@query(
    "j07_block_status",
    sql(
        """SELECT b.tx_id, answer, unblocked_at, n.tx_id IS NOT NULL AS notified, frozen_at,
  CASE WHEN unblocked_at IS NOT NULL THEN 'UNBLOCKED' WHEN answer IS NOT NULL THEN 'ANSWERED' ELSE 'AWAITING_CUSTOMER' END AS status
FROM blocks b
LEFT JOIN (SELECT tx_id, label AS answer FROM label_events WHERE label_id % 2 = 1) USING (tx_id)
LEFT JOIN unblocks USING (tx_id)
LEFT JOIN (SELECT tx_id FROM payments WHERE score >= 0.85::DOUBLE AND cents % 3 <> 0) n ON n.tx_id = b.tx_id
LEFT JOIN (SELECT account, max(t) AS frozen_at FROM payments WHERE score >= 0.9::DOUBLE GROUP BY 1) f ON f.account = b.account""",
        "states",
        "label_events",
        then=_BLOCKS,
    ),
)
def block_status(spark, sf):
    p = _p(spark, sf)
    _, blocks, answers, unblocks, notices = _blocks(p)
    frozen = p.filter(F.col("score") >= 0.9).select("account", F.col("t").alias("frozen_at"))
    out = analyst.block_status(blocks, answers, unblocks, notices, frozen)
    return out.select("tx_id", "answer", "unblocked_at", "notified", "frozen_at", "status")


@query(
    "j09_unapplied_unblocks",
    sql(
        """SELECT DISTINCT tx_id, unblocked_at FROM unblocks u WHERE NOT EXISTS (SELECT 1 FROM states s
  WHERE s.tx_id = u.tx_id AND s.seq > 1 AND s.decision = 'APPROVE')""",
        "states",
        then=_BLOCKS,
    ),
)
def unapplied(spark, sf):
    states, _, _, unblocks, _ = _blocks(_p(spark, sf))
    return analyst.unapplied_unblocks(unblocks, states)


@query(
    "j10_s04_labels_of_corpus",
    sql(
        f"""SELECT label_id, label FROM label_events WHERE tx_id IN (SELECT tx_id FROM payments WHERE t >= {NOW})""",
        "label_events",
    ),
)
def corpus_labels(spark, sf):
    p = _p(spark, sf)
    corpus = p.filter(F.col("t") >= NOW).select("tx_id")
    return operations.label_events(p).join(corpus, "tx_id", "left_semi").select("label_id", "label")


@query(
    "j12_next_payment_after_swap",
    sql(
        """SELECT s.account, s.swapped_at, p.t AS next_t FROM swaps s
ASOF LEFT JOIN (SELECT DISTINCT account, t FROM payments) p ON p.account = s.account AND s.swapped_at <= p.t""",
        "payments",
        "swaps",
    ),
)
def next_after_swap(spark, sf):
    p = _p(spark, sf)
    swaps = tables.sim_swaps(spark, sf).distinct()
    hot = hot_keys(spark, sf, p)
    return asof.next_event(swaps, p, "account", "swapped_at", "t", "next_t", hot.split("account"))


# ---- behaviour profile -----------------------------------------------------------------------------------

_PROFILE = f"""loc AS (SELECT l.*, CAST(hour(make_timestamp(t + utc_offset_hours * 3600000000)) AS INTEGER) AS hour FROM located l),
cmp AS (SELECT * FROM loc QUALIFY row_number() OVER (PARTITION BY account ORDER BY t DESC, tx_id DESC) = 1),
win AS (SELECT w.*, c.t AS ct, c.hour AS c_hour, c.cents AS c_cents, c.channel AS c_channel, c.counterparty AS c_cp,
    c.device AS c_device, c.counterparty_country AS c_country FROM loc w JOIN cmp c ON c.account = w.account
  AND w.t >= c.t - {90 * DAY} AND w.t < c.t),
agg AS (SELECT account, count(*) AS n, quantile_disc(cents, 0.05) AS q5, quantile_disc(cents, 0.95) AS q95,
    count(*) FILTER (WHERE channel = c_channel) AS same_channel, count(*) FILTER (WHERE counterparty = c_cp) AS prior_counterparty,
    count(*) FILTER (WHERE device = c_device) AS prior_device,
    count(*) FILTER (WHERE counterparty_country = c_country) AS prior_country FROM win GROUP BY account),
usual AS (SELECT account, channel FROM (SELECT account, channel, count(*) AS c FROM win GROUP BY 1, 2)
  QUALIFY row_number() OVER (PARTITION BY account ORDER BY c DESC, channel) = 1),
cand AS (SELECT account, s, len, (SELECT count(*) FROM win w WHERE w.account = a.account AND (w.hour - s + 24) % 24 < len) AS held, n
  FROM agg a, range(24) r(s), range(1, 25) q(len)),
rng AS (SELECT account, s AS hour_start, (s + len - 1) % 24 AS hour_end FROM cand WHERE held * 10 >= n * 9
  QUALIFY row_number() OVER (PARTITION BY account ORDER BY len, s) = 1)"""


@query(
    "n04_n05_n06_n07_behaviour_profile",
    sql(
        """SELECT c.account, coalesce(n, 0) AS n,
  CASE WHEN n >= 10 THEN CAST(hour_start AS INTEGER) END AS hour_start, CASE WHEN n >= 10 THEN CAST(hour_end AS INTEGER) END AS hour_end,
  coalesce(n >= 10 AND NOT CASE WHEN hour_start <= hour_end THEN c.hour >= hour_start AND c.hour <= hour_end
    ELSE c.hour >= hour_start OR c.hour <= hour_end END, FALSE) AS unusual_hour,
  CASE WHEN n >= 10 THEN q5 END AS p5, CASE WHEN n >= 10 THEN q95 END AS p95,
  coalesce(n >= 10 AND (c.cents < q5 OR c.cents > q95), FALSE) AS unusual_amount,
  CASE WHEN n >= 10 THEN u.channel END AS usual_channel, coalesce(n >= 10 AND same_channel * 20 < n, FALSE) AS unusual_channel,
  coalesce(prior_counterparty, 0) AS prior_counterparty, coalesce(n >= 10 AND prior_counterparty = 0, FALSE) AS new_counterparty,
  coalesce(n >= 10 AND c.device IS NOT NULL AND prior_device = 0, FALSE) AS new_device,
  coalesce(n >= 10 AND c.counterparty_country IS NOT NULL AND prior_country = 0, FALSE) AS new_country
FROM cmp c LEFT JOIN agg a USING (account) LEFT JOIN rng r USING (account) LEFT JOIN usual u USING (account)""",
        "located",
        then=_PROFILE,
    ),
)
def behaviour(spark, sf):
    """Each account's last payment against the 90 days before it."""
    p = analyst.with_local_hour(tables.with_countries(_p(spark, sf), spark, sf))
    compared = asof.latest(
        p, ["account"], ["t", "tx_id"],
        ["t", "tx_id", "hour", "cents", "channel", "counterparty", "device", "counterparty_country"],
    )
    return analyst.profiles(p, compared).drop("hours", "histogram")


@query(
    "n04_x13_hours_and_histogram",
    sql(
        """SELECT a.account, string_agg(CAST(coalesce(x.k, 0) AS VARCHAR), ',' ORDER BY h) AS hours FROM
  (SELECT DISTINCT account FROM win) a CROSS JOIN range(24) r(h)
  LEFT JOIN (SELECT account, hour, count(*) AS k FROM win GROUP BY 1, 2) x ON x.account = a.account AND x.hour = h
GROUP BY a.account""",
        "located",
        then=_PROFILE,
    ),
)
def hours(spark, sf):
    p = analyst.with_local_hour(tables.with_countries(_p(spark, sf), spark, sf))
    compared = asof.latest(
        p, ["account"], ["t", "tx_id"],
        ["t", "tx_id", "hour", "cents", "channel", "counterparty", "device", "counterparty_country"],
    )
    out = analyst.profiles(p, compared).filter("n > 0")
    return out.select("account", F.concat_ws(",", F.transform("hours", lambda n: n.cast("string"))).alias("hours"))


# ---- networks ------------------------------------------------------------------------------------------------


def _links(p: DataFrame) -> DataFrame:
    return p.filter(F.col("t") >= NOW - 20 * DAY).select(
        F.col("account").alias("source"), F.col("counterparty").alias("target")
    )


_NET = f"""links AS (SELECT account AS source, counterparty AS target FROM payments WHERE t >= {NOW - 20 * DAY}),
adj AS (SELECT node, other, count(*) AS n FROM (SELECT source AS node, target AS other FROM links
    UNION ALL SELECT target, source FROM links) WHERE node <> other GROUP BY 1, 2),
d1 AS (SELECT other AS node, n FROM adj WHERE node = 5 QUALIFY row_number() OVER (ORDER BY n DESC, other) <= 49),
d2 AS (SELECT other AS node, max(n) AS n FROM adj WHERE node IN (SELECT node FROM d1) AND other <> 5
    AND other NOT IN (SELECT node FROM d1) GROUP BY 1
  QUALIFY row_number() OVER (ORDER BY max(n) DESC, other) <= 49 - (SELECT count(*) FROM d1)),
nodes AS (SELECT 5 AS node, 0 AS degree UNION ALL SELECT node, 1 FROM d1 UNION ALL SELECT node, 2 FROM d2)"""


@query(
    "g02_network",
    sql(
        """SELECT CAST(n.node AS BIGINT) AS node, CAST(degree AS INTEGER) AS degree, coalesce(f.fraud, FALSE) AS confirmed_fraud FROM nodes n
LEFT JOIN (SELECT DISTINCT account, TRUE AS fraud FROM (SELECT account, arg_max(label, (label_at, label_id)) AS label
  FROM label_events GROUP BY tx_id, account) WHERE label = 'FRAUD') f ON f.account = n.node""",
        "label_events",
        then=_NET,
    ),
)
def network(spark, sf):
    p = _p(spark, sf)
    roots = p.filter(F.col("account") == 5).select(F.col("account").alias("root")).distinct()
    nodes = graph.networks(_links(p), roots)
    fraud = graph.confirmed_accounts(operations.label_events(p)).select(
        F.col("account").alias("node"), F.lit(True).alias("f")
    )
    return nodes.join(fraud, "node", "left").select(
        "node", "degree", F.coalesce("f", F.lit(False)).alias("confirmed_fraud")
    )


@query(
    "g03_network_edges",
    sql(
        """SELECT source, target, count(*) AS n FROM links WHERE source IN (SELECT node FROM nodes)
  AND target IN (SELECT node FROM nodes) GROUP BY 1, 2""",
        "payments",
        then=_NET,
    ),
)
def network_edges(spark, sf):
    p = _p(spark, sf)
    roots = p.filter(F.col("account") == 5).select(F.col("account").alias("root")).distinct()
    nodes = graph.networks(_links(p), roots)
    return graph.network_edges(_links(p), nodes).select("source", "target", "n")


@query(
    "j13_payments_touching",
    sql(
        """SELECT tx_id FROM payments WHERE account IN (SELECT DISTINCT device FROM payments WHERE is_fraud AND device IS NOT NULL)
  OR counterparty IN (SELECT DISTINCT device FROM payments WHERE is_fraud AND device IS NOT NULL)""",
        "payments",
    ),
)
def touching(spark, sf):
    """Payments with either end in a set of tokens; the set here is the devices seen in fraud."""
    p = _p(spark, sf)
    nodes = p.filter("is_fraud and device is not null").select(F.col("device").alias("node")).distinct()
    links = p.select("tx_id", F.col("account").alias("source"), F.col("counterparty").alias("target"))
    return graph.touching(links, nodes, both=False).select("tx_id")


_CC = """used AS (SELECT DISTINCT key, account, entity FROM (
    SELECT 'device' AS key, account, CAST(device AS VARCHAR) AS entity FROM payments
    UNION ALL SELECT 'agent', account, CAST(agent AS VARCHAR) FROM payments
    UNION ALL SELECT 'cell', account, cell FROM payments
    UNION ALL SELECT 'counterparty', account, CAST(counterparty AS VARCHAR) FROM payments) WHERE entity IS NOT NULL),
pairs AS (SELECT DISTINCT u.key, u.account, m.a AS other FROM used u JOIN (SELECT key, entity, min(account) AS a FROM used GROUP BY 1, 2) m
    ON m.key = u.key AND m.entity = u.entity),
near AS (SELECT key, account, other FROM pairs UNION SELECT key, other, account FROM pairs),
reach AS (SELECT key, account AS root, account AS node FROM near
  UNION SELECT r.key, r.root, n.other FROM reach r JOIN near n ON n.key = r.key AND n.account = r.node),
member AS (SELECT key, root AS account, min(node) AS component FROM reach GROUP BY 1, 2)"""


def _membership(spark, sf) -> DataFrame:
    p = _p(spark, sf)
    keys = ["device", "agent", "cell", "counterparty"]
    edges = graph.entity_edges(p, keys)
    # Accounts without a shared entity are components of their own.
    everyone = p.select("account").distinct().select("account", F.explode(F.array(*[F.lit(k) for k in keys])).alias("key"))
    return graph.components(edges, everyone)


@query(
    "g01_component_sizes",
    sql(
        """SELECT key, count(*) AS components, CAST(sum(size) AS BIGINT) AS accounts, max(size) AS largest,
  list(size ORDER BY size DESC)[count(*) // 2 + 1] AS median_size,
  list(size ORDER BY size DESC)[CAST(floor(count(*) * 0.01::DOUBLE) AS BIGINT) + 1] AS p99_size,
  round(max(size) / CAST(sum(size) AS DOUBLE), 6) AS largest_share, max(size) / CAST(sum(size) AS DOUBLE) <= 0.1 AS foldable
FROM (SELECT key, component, count(*) AS size FROM (
    SELECT k.key, a.account, coalesce(m.component, a.account) AS component FROM (SELECT DISTINCT account FROM payments) a
    CROSS JOIN (VALUES ('device'), ('agent'), ('cell'), ('counterparty')) k(key)
    LEFT JOIN member m ON m.key = k.key AND m.account = a.account) GROUP BY 1, 2) GROUP BY key""",
        "payments",
        then=_CC,
    ).replace("WITH payments", "WITH RECURSIVE payments"),
)
def component_sizes(spark, sf):
    return rounded(graph.component_sizes(_membership(spark, sf)), "largest_share")


@query(
    "g04_campaigns",
    sql(
        f"""SELECT kind, entity, period, n, CAST(total AS DOUBLE) AS total FROM (
  SELECT kind, entity, t // {7 * DAY} AS period, count(*) AS n, sum(amount) AS total FROM (
    SELECT 'device' AS kind, CAST(device AS VARCHAR) AS entity, t, amount FROM payments WHERE is_fraud
    UNION ALL SELECT 'counterparty', CAST(counterparty AS VARCHAR), t, amount FROM payments WHERE is_fraud
    UNION ALL SELECT 'cell', cell, t, amount FROM payments WHERE is_fraud
    UNION ALL SELECT 'mcc', mcc, t, amount FROM payments WHERE is_fraud) WHERE entity IS NOT NULL GROUP BY 1, 2, 3)
WHERE n >= 5""",
        "payments",
    ),
)
def campaigns(spark, sf):
    out = graph.campaigns(_p(spark, sf), ["device", "counterparty", "cell", "mcc"])
    return out.withColumn("total", F.col("total").cast("double"))


# ---- audit -------------------------------------------------------------------------------------------------------


def _audited(p: DataFrame) -> DataFrame:
    """Audit rows linked by content hash, with a few tampered and a few missing."""
    rows = operations.audit_rows(p)
    link = F.sha2("content", 256)
    # The previous row of a writer is the payment eight ids earlier: found by an equi-join.
    earlier = rows.select("writer", (F.col("seq") + 1).alias("seq"), link.alias("prev_hash"))
    linked = rows.join(earlier, ["writer", "seq"], "left")
    return linked.select(
        "writer", "seq", F.coalesce("prev_hash", F.lit(audit.GENESIS)).alias("prev_hash"),
        F.when(F.col("entity_id") % 1009 == 1008, F.sha2(F.lit("tampered"), 256)).otherwise(link).alias("row_hash"),
        "content", "entity_id",
    ).filter("entity_id % 2003 <> 2001")


_AUDIT = """audited AS (SELECT writer, seq, coalesce(lag(sha256(content)) OVER (PARTITION BY writer ORDER BY seq), repeat('0', 64)) AS prev_hash,
    CASE WHEN entity_id % 1009 = 1008 THEN sha256('tampered') ELSE sha256(content) END AS row_hash, content, entity_id FROM audit_rows),
stored AS (SELECT * FROM audited WHERE entity_id % 2003 <> 2001),
looked AS (SELECT *, coalesce(lag(seq) OVER w, 0) AS ls, coalesce(lag(row_hash) OVER w, repeat('0', 64)) AS lh FROM stored
  WINDOW w AS (PARTITION BY writer ORDER BY seq)),
judged AS (SELECT *, CASE WHEN seq <> ls + 1 THEN 'missing row: sequence gap' WHEN prev_hash <> lh THEN 'prev_hash does not match the previous row'
    WHEN row_hash <> sha256(content) THEN 'row content does not match row_hash' END AS problem,
    CASE WHEN seq <> ls + 1 THEN ls + 1 ELSE seq END AS at_seq FROM looked),
firsts AS (SELECT writer, min(seq) FILTER (WHERE problem IS NOT NULL) AS bad_seq, count(*) AS rows FROM judged GROUP BY 1)"""


@query(
    "h01_audit_chain",
    sql(
        """SELECT f.writer, CASE WHEN bad_seq IS NULL THEN rows ELSE (SELECT count(*) FROM judged j WHERE j.writer = f.writer AND j.seq < bad_seq) END AS checked,
  j.at_seq AS first_bad_seq, j.problem FROM firsts f LEFT JOIN judged j ON j.writer = f.writer AND j.seq = bad_seq""",
        "audit_rows",
        then=_AUDIT,
    ),
)
def audit_chain(spark, sf):
    return audit.verify_chains(_audited(_p(spark, sf)), recomputed=F.sha2("content", 256))


_TREE = f"""levels AS (
  SELECT t // {DAY} AS day, list(sha256(unhex('00' || sha256(tx_id || '|' || account || '|' || cents))) ORDER BY t, tx_id) AS h
  FROM payments GROUP BY 1
  UNION ALL
  SELECT day, list_transform(range(0, (len(h) + 1) // 2), lambda i: CASE WHEN 2 * i + 2 <= len(h)
    THEN sha256(unhex('01' || h[2 * i + 1] || h[2 * i + 2])) ELSE h[2 * i + 1] END)
  FROM levels WHERE len(h) > 1)"""


@query(
    "h02_merkle_roots",
    sql("SELECT day, h[1] AS root FROM levels WHERE len(h) = 1", "payments", then=_TREE).replace("WITH ", "WITH RECURSIVE ", 1),
)
def merkle(spark, sf):
    """Root of each day's audit rows, in payment order."""
    p = _p(spark, sf)
    rows = p.select(
        F.expr(f"t div {DAY}").alias("day"), "t", "tx_id",
        F.sha2(F.concat_ws("|", "tx_id", "account", "cents"), 256).alias("row_hash"),
    )
    indexed = time_index(rows, "t", ["tx_id"])
    starts = indexed.groupBy("day").agg(F.min("row_index").alias("first"), F.count("*").alias("n"))
    biggest = starts.agg(F.max("n")).first()[0]
    leaves = indexed.join(F.broadcast(starts), "day").select(
        "day", (F.col("row_index") - F.col("first")).alias("i"), "row_hash"
    )
    return audit.merkle_roots(leaves, biggest)


@query(
    "h03_p08_audit_search",
    sql(
        f"""SELECT entity_id, event_type, row_number() OVER (ORDER BY -event_at, entity_id) AS position FROM audit_rows
WHERE user_id = 3 AND event_type = 'CARD' AND event_at >= {EPOCH + 3 * DAY} AND event_at < {EPOCH + 20 * DAY}
ORDER BY -event_at, entity_id LIMIT 50""",
        "audit_rows",
    ),
)
def audit_search(spark, sf):
    rows = operations.audit_rows(_p(spark, sf))
    hit = analyst.audit_filter(rows, user=3, event_type="CARD", since=EPOCH + 3 * DAY, until=EPOCH + 20 * DAY)
    return analyst.page(hit, [-F.col("event_at")], "entity_id", 50).select("entity_id", "event_type", "position")


# ---- samples and slices ----------------------------------------------------------------------------------------------


@query(
    "p12_even_stride_sample",
    sql(
        """SELECT tx_id FROM (SELECT tx_id, row_number() OVER (ORDER BY t, tx_id) - 1 AS i FROM payments)
JOIN (SELECT DISTINCT j * n // 500 AS i FROM range(500) r(j), (SELECT count(*) AS n FROM payments)) USING (i)""",
        "payments",
    ),
)
def even_stride(spark, sf):
    return spread(_p(spark, sf).select("tx_id", "t"), "t", ["tx_id"], 500).select("tx_id")


@query(
    "p13_history_slice",
    sql(
        f"SELECT tx_id, account, t, country FROM located WHERE t >= {EPOCH + 10 * DAY} AND t < {EPOCH + 12 * DAY}",
        "located",
    ),
)
def history_slice(spark, sf):
    p = tables.with_countries(_p(spark, sf), spark, sf)
    return ag.history_slice(p, EPOCH + 10 * DAY, EPOCH + 12 * DAY).select("tx_id", "account", "t", "country")
