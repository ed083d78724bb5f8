"""The canonical views of ``plans.tables`` in SQL, for the checks."""

from __future__ import annotations

EPOCH = 1_704_067_200_000_000

_VIEWS = {
    "payments": (
        (),
        """SELECT tx_id, account, k, t, ts, cents, amount, channel, k AS counterparty,
  CASE WHEN channel <> 'USSD' THEN k % 40 END AS device,
  CASE WHEN channel = 'AGENT_BANKING' THEN k % 10 END AS agent,
  CASE WHEN k % 2 = 0 THEN '6011' ELSE '4829' END AS mcc,
  lat, lon,
  CAST(CAST(floor(lat / 0.05::DOUBLE) AS BIGINT) AS VARCHAR) || ':' ||
    CAST(CAST(floor(lon / 0.05::DOUBLE) AS BIGINT) AS VARCHAR) AS cell,
  channel = 'CARD' AND cents > 5000 AS is_fraud,
  t + cents * 36000000 AS label_at,
  CAST(((k * 37 + cents) % 1000) * 6 + CASE WHEN channel = 'CARD' THEN 4000 ELSE 0 END AS DOUBLE)
    / 10000.0::DOUBLE AS score
FROM (SELECT *, -2.0::DOUBLE + CAST(k - 50 AS DOUBLE) / 100.0::DOUBLE AS lat,
        30.0::DOUBLE + CAST(account % 50 AS DOUBLE) / 50.0::DOUBLE AS lon
      FROM (SELECT event_id AS tx_id, user_id AS account,
              CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS BIGINT) AS k,
              epoch_us(ts) AS t, ts, CAST(round(value * 100) AS BIGINT) AS cents,
              CAST(value AS DECIMAL(18,4)) AS amount,
              CASE event_type WHEN 'view' THEN 'MOBILE_MONEY' WHEN 'signup' THEN 'USSD'
                WHEN 'purchase' THEN 'AGENT_BANKING' WHEN 'error' THEN 'CARD'
                WHEN 'click' THEN 'ONLINE' END AS channel
            FROM events))""",
    ),
    "countries": (
        (),
        """SELECT n_name AS country, CAST(n_nationkey AS BIGINT) AS country_key,
  CAST(n_regionkey AS VARCHAR) AS continent, 'B' || CAST(n_nationkey % 3 AS VARCHAR) AS bloc,
  n_nationkey % 5 - 2 AS utc_offset_hours, 'C' || CAST(n_nationkey AS VARCHAR) AS currency,
  (n_nationkey % 4 + 1) * 50 AS d1, (n_nationkey % 3 + 1) * 500 AS d2
FROM nation""",
    ),
    "located": (
        ("payments", "countries"),
        """SELECT p.*, h.country, h.currency, h.utc_offset_hours, a.country AS counterparty_country
FROM payments p
LEFT JOIN customer c ON c.c_custkey = p.account
LEFT JOIN countries h ON h.country_key = c.c_nationkey
LEFT JOIN supplier s ON s.s_suppkey = p.k % (SELECT count(*) FROM supplier)
LEFT JOIN countries a ON a.country_key = s.s_nationkey""",
    ),
    "tiers": (
        (),
        f"""SELECT account, effective_at, arg_min(tier, version) AS tier FROM (
  SELECT o_custkey AS account, {EPOCH} + (o_orderkey * 7919) % 2592000 * 1000000 AS effective_at,
    o_orderkey AS version, CAST(o_orderkey % 3 + 1 AS INTEGER) AS tier FROM orders)
GROUP BY account, effective_at""",
    ),
    "swaps": (
        (),
        f"""SELECT DISTINCT o_custkey AS account,
  {EPOCH} + (o_orderkey * 104729) % 2592000 * 1000000 AS swapped_at
FROM orders WHERE o_orderstatus = 'F'""",
    ),
    "profiles": (
        (),
        f"""SELECT c_custkey AS account,
  CASE WHEN c_custkey % 7 <> 0 THEN {EPOCH} - (c_custkey % 60) * 86400000000 END AS opened_at
FROM customer""",
    ),
    "standings": (
        (),
        f"""SELECT agent, effective_at, arg_min(balance_cents, version) AS balance_cents,
  arg_min(home_lat, version) AS home_lat, arg_min(home_lon, version) AS home_lon,
  1000000 AS limit_cents
FROM (SELECT s_suppkey % 10 AS agent, {EPOCH} + (s_suppkey * 8191) % 720 * 3600000000 AS effective_at,
  s_suppkey AS version, CAST(round(s_acctbal * 100) AS BIGINT) AS balance_cents,
  -2.0::DOUBLE + CAST(s_suppkey % 10 AS DOUBLE) / 20.0::DOUBLE AS home_lat,
  30.0::DOUBLE + CAST(s_suppkey % 7 AS DOUBLE) / 10.0::DOUBLE AS home_lon FROM supplier)
GROUP BY agent, effective_at""",
    ),
    "limits": (
        ("payments",),
        f"""SELECT channel, {EPOCH} + (week + 1) * 604800000000 AS effective_at,
  lead({EPOCH} + (week + 1) * 604800000000) OVER (PARTITION BY channel ORDER BY week) AS until,
  CAST(s * 3 AS BIGINT) // n AS limit_cents
FROM (SELECT channel, (t - {EPOCH}) // 604800000000 AS week, sum(cents) AS s, count(*) AS n
      FROM payments GROUP BY 1, 2)""",
    ),
    "fx_rates": (
        (),
        f"""SELECT 'C' || CAST(o_orderkey % 25 AS VARCHAR) AS currency,
  {EPOCH} + (o_orderkey * 13) % 30 * 86400000000 AS rate_date, o_orderkey AS recorded_at,
  1000 + o_orderkey % 977 AS rate_thousandths FROM orders""",
    ),
    "payments_days": (
        (),
        """SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS tx_id,
  o_custkey AS account, l_suppkey AS counterparty, epoch_us(o_orderdate) AS t,
  CAST(round(l_extendedprice * 100) AS BIGINT) AS cents
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    ),
    "histogram": (
        ("payments",),
        """SELECT score, count(*) FILTER (WHERE is_fraud) AS pos,
  count(*) FILTER (WHERE NOT is_fraud) AS neg FROM payments GROUP BY score""",
    ),
    "scores": (
        ("payments",),
        """SELECT tx_id, account, channel, institution, anomaly, fallback, revision, scored_at, score FROM (
  SELECT tx_id, account, channel, 'I' || CAST(account % 4 AS VARCHAR) AS institution,
    CAST((k * 11 + cents * 3) % 1000 AS DOUBLE) / 1000.0::DOUBLE AS anomaly, cents % 50 = 0 AS fallback,
    1 AS revision, t AS scored_at, score FROM payments
  UNION ALL
  SELECT tx_id, account, channel, 'I' || CAST(account % 4 AS VARCHAR),
    CAST((k * 11 + cents * 3) % 1000 AS DOUBLE) / 1000.0::DOUBLE, cents % 50 = 0,
    2, t + 1000000, CAST(((k * 53 + cents * 7) % 1000) * 5
      + CASE WHEN channel = 'CARD' THEN 5000 ELSE 0 END AS DOUBLE) / 10000.0::DOUBLE
  FROM payments WHERE k % 5 = 0)""",
    ),
    "second_scores": (
        ("payments",),
        """SELECT *, CAST(((k * 53 + cents * 7) % 1000) * 5
  + CASE WHEN channel = 'CARD' THEN 5000 ELSE 0 END AS DOUBLE) / 10000.0::DOUBLE AS score2 FROM payments""",
    ),
    "states": (
        ("payments",),
        """SELECT tx_id, account, channel, 1 AS seq, CASE WHEN score >= 0.85::DOUBLE THEN 'DECLINE'
    WHEN score >= 0.60::DOUBLE THEN 'HOLD' ELSE 'APPROVE' END AS decision, t + 1000000 AS at, 'SYSTEM' AS decided_by
  FROM payments
  UNION ALL
  SELECT tx_id, account, channel, 2, CASE WHEN k % 3 = 0 THEN 'APPROVE' ELSE 'DECLINE' END,
    t + 1000000 + cents * 100000, 'ANALYST' FROM payments
  WHERE score >= 0.60::DOUBLE AND score < 0.85::DOUBLE AND k % 3 <> 2
  UNION ALL
  SELECT tx_id, account, channel, 2, 'APPROVE', t + 86400000000, 'CUSTOMER_VERIFICATION' FROM payments
  WHERE score >= 0.85::DOUBLE AND k % 4 = 0""",
    ),
    "label_events": (
        ("payments",),
        """SELECT tx_id, account, t, tx_id * 2 AS label_id,
    CASE WHEN is_fraud THEN 'FRAUD' ELSE 'LEGITIMATE' END AS label, label_at FROM payments
  UNION ALL
  SELECT tx_id, account, t, tx_id * 2 + 1, CASE WHEN is_fraud THEN 'LEGITIMATE' ELSE 'FRAUD' END, label_at
  FROM payments WHERE k % 6 = 0""",
    ),
    "alerts": (
        ("payments",),
        """SELECT * FROM (SELECT tx_id AS alert_id, tx_id, account, channel, amount, cents, k, t,
    score AS fraud_probability, CAST((k * 11 + cents * 3) % 1000 AS DOUBLE) / 1000.0::DOUBLE AS anomaly,
    'I' || CAST(account % 4 AS VARCHAR) AS institution,
    CASE WHEN score >= 0.85::DOUBLE THEN 'HIGH' WHEN score >= 0.60::DOUBLE THEN 'MEDIUM'
      WHEN CAST((k * 11 + cents * 3) % 1000 AS DOUBLE) / 1000.0::DOUBLE >= 0.95::DOUBLE THEN 'ANOMALY' END AS tier,
    CASE k % 4 WHEN 0 THEN 'PENDING' WHEN 1 THEN 'IN_REVIEW' ELSE 'DECIDED' END AS status,
    k % 7 AS analyst_id,
    CASE WHEN k % 9 = 0 THEN CASE WHEN cents % 2 = 0 THEN 'SENIOR_ANALYST' ELSE 'RISK_OFFICER' END END AS target_role,
    CASE WHEN k % 9 = 0 THEN tx_id END AS escalated_from, t AS created_at FROM payments)
  WHERE tier IS NOT NULL""",
    ),
    "alert_decisions": (
        ("alerts",),
        """SELECT alert_id AS decision_id, alert_id, tx_id, analyst_id, tier, cents,
    CASE WHEN escalated_from IS NOT NULL THEN 'ESCALATE' WHEN k % 3 = 0 THEN 'CONFIRM_FRAUD'
      ELSE 'MARK_LEGITIMATE' END AS decision, cents % 1800 AS duration_s,
    t + (cents % 1800) * 1000000 AS created_at, k FROM alerts WHERE status = 'DECIDED'""",
    ),
    "commits": (
        ("alert_decisions",),
        "SELECT decision_id, created_at + 60000000 AS committed_at FROM alert_decisions WHERE k % 5 <> 2",
    ),
    "undos": (
        ("alert_decisions",),
        "SELECT decision_id, created_at + 30000000 AS undone_at FROM alert_decisions WHERE k % 10 = 2",
    ),
    "hold_policies": (
        (),
        f"""SELECT CAST(r_regionkey AS BIGINT) AS version, {EPOCH} + (r_regionkey + 1) * 432000000000 AS effective_at,
    CASE WHEN r_regionkey % 2 = 0 THEN 'DECLINE_AND_VERIFY' ELSE 'RELEASE_WITH_TIMEOUT_LABEL' END AS policy
  FROM region""",
    ),
    "contributions": (
        ("payments",),
        """SELECT tx_id, channel, score, k % 10 <> 0 AS explained, cents % 50 = 0 AS fallback, i,
    ['amount_zscore_90d', 'counterparty_confirmed_fraud_90d', 'device_is_new_for_account', 'is_local_night',
     'tx_count_1h', 'velocity_ratio_1h_vs_30d'][i + 1] AS feature,
    CAST((k * (7 + i) + cents * (3 + 2 * i)) % 2001 - 1000 AS DOUBLE) / 1000.0::DOUBLE AS shap
  FROM payments, range(6) r(i)""",
    ),
    "audit_rows": (
        ("payments",),
        """SELECT tx_id % 8 AS writer, tx_id // 8 + 1 AS seq, t AS event_at, account % 12 AS user_id,
    channel AS event_type, tx_id AS entity_id,
    tx_id || '|' || account || '|' || cents || '|' || channel AS content, cents FROM payments""",
    ),
}


def sql(body: str, *views: str, then: str = "") -> str:
    """``body`` with the named views, and what they need, defined in front of it."""
    order: list[str] = []

    def need(name: str) -> None:
        for other in _VIEWS[name][0]:
            need(other)
        if name not in order:
            order.append(name)

    for name in views:
        need(name)
    ctes = [f"{name} AS MATERIALIZED (\n{_VIEWS[name][1]})" for name in order]
    if then:
        ctes.append(then)
    head = "WITH " + ",\n".join(ctes) + "\n" if ctes else ""
    return head + body


def haversine(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    root = (
        f"sqrt(pow(sin(radians({lat2} - {lat1}) / 2), 2)"
        f" + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2))"
    )
    return f"12742.0176::DOUBLE * asin(CASE WHEN {root} > 1.0 THEN 1.0::DOUBLE ELSE {root} END)"
