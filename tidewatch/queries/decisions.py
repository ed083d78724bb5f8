"""Rules, tiers, breakers, freezes, holds and decisions over the whole payment history."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import money, reasons
from tidewatch.operators import asof, decide, rules
from tidewatch.plans import operations, tables
from tidewatch.queries.evaluation import rounded
from tidewatch.queries.features import hot_keys
from tidewatch.queries.registry import query
from tidewatch.queries.views import EPOCH, sql

DAY = tables.DAY
NOW = EPOCH + 25 * DAY
REVIEW = 30 * decide.MINUTE

RULES = [
    rules.Rule(
        "large_remote",
        {"all": [{"field": "amount", "op": "gte", "value": 150},
                 {"field": "channel", "op": "in", "value": ["CARD", "ONLINE"]}]},
        "HIGH",
    ),
    rules.Rule(
        "no_device_or_agent_three",
        {"any": [{"field": "device", "op": "is_null"}, {"field": "agent", "op": "eq", "value": 3}]},
    ),
    rules.Rule(
        "agent_out_of_range", {"not": {"field": "agent", "op": "between", "value": [2, 7]}}, "MEDIUM"
    ),
    rules.Rule(
        "other_category",
        {"all": [{"field": "mcc", "op": "not_in", "value": ["6011"]},
                 {"any": [{"field": "cents", "op": "lt", "value": 300},
                          {"not": {"field": "device", "op": "is_not_null"}}]}]},
    ),
]
_R1 = "amount >= 150 AND channel IN ('CARD', 'ONLINE')"
_R2 = "coalesce(device IS NULL OR agent = 3, FALSE)"
_R3 = "coalesce(NOT (agent BETWEEN 2 AND 7), FALSE)"
_R4 = "mcc NOT IN ('6011') AND (cents < 300 OR device IS NULL)"
_OVERRIDE = f"CASE WHEN {_R1} THEN 'HIGH' WHEN {_R3} THEN 'MEDIUM' END"


@query(
    "d01_d03_rule_set",
    sql(
        f"""SELECT tx_id, concat_ws(',', CASE WHEN {_R1} THEN 'large_remote' END,
  CASE WHEN {_R2} THEN 'no_device_or_agent_three' END, CASE WHEN {_R3} THEN 'agent_out_of_range' END,
  CASE WHEN {_R4} THEN 'other_category' END) AS matched_rules, {_OVERRIDE} AS rule_override FROM payments""",
        "payments",
    ),
)
def rule_set(spark, sf):
    out = rules.evaluate(tables.payments(spark, sf), RULES)
    return out.select("tx_id", F.concat_ws(",", "matched_rules").alias("matched_rules"), "rule_override")


@query(
    "d04_rule_preview",
    sql(
        f"""SELECT count(*) AS rows, count(*) FILTER (WHERE {_R1}) AS matches FROM payments
WHERE t >= {NOW - 7 * DAY} AND t < {NOW}""",
        "payments",
    ),
)
def rule_preview(spark, sf):
    return rules.preview(tables.payments(spark, sf), RULES[0], NOW - 7 * DAY, NOW)


@query(
    "d05_threshold_preview",
    sql(
        f"""SELECT round(count(*) FILTER (WHERE score >= 0.8::DOUBLE) / 24.0::DOUBLE, 6) AS high_per_hour,
  round(count(*) FILTER (WHERE score >= 0.5::DOUBLE AND score < 0.8::DOUBLE) / 24.0::DOUBLE, 6) AS medium_per_hour
FROM payments WHERE t >= {NOW - DAY} AND t < {NOW}""",
        "payments",
    ),
)
def threshold_preview(spark, sf):
    out = rules.threshold_preview(tables.payments(spark, sf), 0.5, 0.8, NOW)
    return rounded(out, "high_per_hour", "medium_per_hour")


@query(
    "d06_channel_tiers",
    sql(
        """SELECT tx_id, CASE WHEN score >= high THEN 'HIGH' WHEN score >= medium THEN 'MEDIUM' ELSE 'LOW' END AS tier
FROM payments JOIN (SELECT channel, max(score) * 0.6::DOUBLE AS medium, max(score) * 0.85::DOUBLE AS high
  FROM payments GROUP BY 1) USING (channel)""",
        "payments",
    ),
)
def channel_tiers(spark, sf):
    p = tables.payments(spark, sf)
    thresholds = p.groupBy("channel").agg(
        (F.max("score") * 0.6).alias("medium"), (F.max("score") * 0.85).alias("high")
    )
    return decide.tiered(p, thresholds).select("tx_id", "tier")


@query(
    "d07_fallback_tier",
    sql("SELECT tx_id, CASE WHEN amount >= 250 THEN 'MEDIUM' ELSE 'LOW' END AS tier FROM payments", "payments"),
)
def fallback(spark, sf):
    p = tables.payments(spark, sf)
    return p.select("tx_id", decide.fallback_tier(F.col("amount"), 250).alias("tier"))


_POLICY = """policed AS (SELECT s.tx_id, s.seq, s.at, coalesce((SELECT arg_max(policy, version) FROM hold_policies v
    WHERE v.effective_at <= s.at), 'RELEASE_WITH_TIMEOUT_LABEL') AS policy
  FROM states s WHERE seq = 1 AND decision = 'HOLD')"""


@query(
    "d09_j03_policy_at_decision",
    sql("SELECT tx_id, policy FROM policed", "states", "hold_policies", then=_POLICY),
)
def policy_at_decision(spark, sf):
    holds = operations.decision_states(tables.payments(spark, sf)).filter("seq = 1 and decision = 'HOLD'")
    out = decide.resolve_holds(holds, operations.hold_policies(spark, sf), NOW)
    return out.select("tx_id", "policy")


@query(
    "d10_a16_status_quo_rules",
    sql(
        f"""SELECT tx_id, CAST(ln(1 + CAST(amount AS DOUBLE)) > q AS INTEGER)
  + CAST(mcc IN ('4829', '6051', '7995') AS INTEGER) AS rules_fired
FROM payments, (SELECT quantile_cont(ln(1 + CAST(amount AS DOUBLE)), 0.99) AS q FROM payments
  WHERE t < {EPOCH + 15 * DAY} AND NOT is_fraud)""",
        "payments",
    ),
)
def status_quo(spark, sf):
    p = tables.payments(spark, sf)
    out = decide.status_quo_rules(p, F.col("t") < EPOCH + 15 * DAY, ["4829", "6051", "7995"])
    return out.select("tx_id", "rules_fired")


# ---- breakers, freezes, holds ------------------------------------------------------------------------

BREAKER = decide.Breaker(threshold="0.10", minutes=60, minimum=5, reset_minutes=120)
_BREAKER = """minutes AS (SELECT 'I' || CAST(account % 4 AS VARCHAR) AS institution, mcc, t // 60000000 AS minute,
  count(*) AS n, count(*) FILTER (WHERE is_fraud) AS fraud FROM payments GROUP BY 1, 2, 3),
counted AS (SELECT institution, mcc, minute, CAST(sum(n) OVER w AS BIGINT) AS n,
  CAST(least(sum(fraud) OVER w, sum(n) OVER w) AS BIGINT) AS fraud FROM minutes
  WINDOW w AS (PARTITION BY institution, mcc ORDER BY minute RANGE BETWEEN 59 PRECEDING AND CURRENT ROW)),
breached AS (SELECT *, n >= 5 AND fraud > 0.10 * n AS breach FROM counted),
lasted AS (SELECT *, max(CASE WHEN breach THEN minute END) OVER (PARTITION BY institution, mcc ORDER BY minute) AS last_breach FROM breached),
stated AS (SELECT *, coalesce(minute < last_breach + 120, FALSE) AS open FROM lasted),
changed AS (SELECT *, CASE WHEN open AND NOT coalesce(lag(open) OVER w, FALSE) THEN 'OPENED'
    WHEN NOT open AND coalesce(lag(open) OVER w, FALSE) THEN 'CLOSED' END AS change FROM stated
  WINDOW w AS (PARTITION BY institution, mcc ORDER BY minute))"""


def breaker_states(spark, sf) -> DataFrame:
    p = tables.payments(spark, sf).withColumn("institution", operations.institution())
    keys = ["institution", "mcc"]
    return decide.breakers(decide.breaker_minutes(p, keys), keys, BREAKER)


@query("k07_sliding_fraud_count", sql("SELECT institution, mcc, minute, n, fraud FROM counted", "payments", then=_BREAKER))
def sliding_counts(spark, sf):
    return breaker_states(spark, sf).select("institution", "mcc", "minute", "n", "fraud")


@query(
    "k08_circuit_breaker",
    sql("SELECT institution, mcc, minute, breach, last_breach, open, change FROM changed", "payments", then=_BREAKER),
)
def circuit_breaker(spark, sf):
    return breaker_states(spark, sf).select(
        "institution", "mcc", "minute", "breach", "last_breach", "open", "change"
    )


def _freezes(spark, sf, hot) -> DataFrame:
    """Every flagged payment counts here and the window is a day, so that the data has freezes."""
    p = tables.payments(spark, sf)
    rows = p.select("tx_id", "account", "t", F.when(F.col("score") >= 0.6, "HIGH").alias("tier"))
    return decide.freezes(rows, hot, DAY)


@query(
    "k09_account_freeze",
    sql(
        """SELECT h.tx_id, high_in_window, high_in_window >= 3 AS freezes,
  coalesce(h.tx_id = f.first_tx, FALSE) AS fires FROM hw1 h
LEFT JOIN (SELECT account, arg_min(tx_id, (t, tx_id)) AS first_tx FROM hw1 WHERE high_in_window >= 3 GROUP BY 1) f
  ON f.account = h.account""",
        "payments",
        then="""hw1 AS (SELECT tx_id, account, t, count(*) OVER (PARTITION BY account ORDER BY t
  RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW) AS high_in_window FROM payments WHERE score >= 0.6::DOUBLE)""",
    ),
)
def freeze(spark, sf):
    p = tables.payments(spark, sf)
    return _freezes(spark, sf, hot_keys(spark, sf, p)).select("tx_id", "high_in_window", "freezes", "fires")


@query(
    "j08_k10_k11_overdue_holds",
    sql(
        f"""SELECT p.tx_id, CAST(p.seq + 1 AS INTEGER) AS seq, p.policy,
  CASE policy WHEN 'RELEASE_WITH_TIMEOUT_LABEL' THEN 'TIMEOUT_RELEASE' ELSE 'DECLINE' END AS decision,
  'TIMEOUT_POLICY' AS decided_by,
  CASE policy WHEN 'RELEASE_WITH_TIMEOUT_LABEL' THEN 'REVIEW_TIMEOUT' ELSE 'REVIEW_TIMEOUT_DECLINED' END AS reason
FROM policed p WHERE p.at + {REVIEW + 60_000_000} <= {NOW}
  AND NOT EXISTS (SELECT 1 FROM states s WHERE s.tx_id = p.tx_id AND s.seq > 1)""",
        "states",
        "hold_policies",
        then=_POLICY,
    ),
)
def overdue(spark, sf):
    states = operations.decision_states(tables.payments(spark, sf))
    late = decide.overdue_holds(states, NOW, REVIEW, grace_us=60_000_000)
    return decide.resolve_holds(late, operations.hold_policies(spark, sf), NOW).drop("at")


_BAD = """bad AS (SELECT tx_id, seq, CASE WHEN seq <> coalesce(lag(seq) OVER w, 0) + 1 THEN 'sequence'
  WHEN lag(decision) OVER w IS NOT NULL AND NOT (
    (lag(decision) OVER w = 'HOLD' AND decision IN ('APPROVE', 'DECLINE') AND decided_by = 'ANALYST')
    OR (lag(decision) OVER w = 'DECLINE' AND decision = 'APPROVE' AND decided_by = 'CUSTOMER_VERIFICATION'))
  THEN 'transition' END AS problem FROM planted WINDOW w AS (PARTITION BY tx_id ORDER BY seq))"""
_PLANTED = """planted AS (SELECT tx_id, CASE WHEN seq = 2 AND tx_id % 5 = 0 THEN 3 ELSE seq END AS seq,
  CASE WHEN seq = 2 AND tx_id % 7 = 0 THEN 'HOLD' ELSE decision END AS decision, "at", decided_by FROM states)"""


@query(
    "k18_transition_errors",
    sql("SELECT tx_id, seq, problem FROM bad WHERE problem IS NOT NULL", "states", then=_PLANTED + ",\n" + _BAD),
)
def transitions(spark, sf):
    """Over a history where some second states skip a number or make a forbidden move."""
    s = operations.decision_states(tables.payments(spark, sf))
    planted = s.withColumn(
        "decision", F.when((F.col("seq") == 2) & (F.col("tx_id") % 7 == 0), "HOLD").otherwise(F.col("decision"))
    ).withColumn("seq", F.when((F.col("seq") == 2) & (F.col("tx_id") % 5 == 0), 3).otherwise(F.col("seq")))
    return decide.transition_errors(planted).select("tx_id", "seq", "problem")


@query(
    "k18_labels_from_answers",
    sql(
        """SELECT tx_id, seq, CASE WHEN decision = 'DECLINE' THEN 'FRAUD' ELSE 'LEGITIMATE' END AS label,
  decided_by AS source, "at" AS label_at FROM states WHERE seq > 1""",
        "states",
    ),
)
def answered_labels(spark, sf):
    return decide.labels_from_answers(operations.decision_states(tables.payments(spark, sf)))


# ---- the decision, and the money it concerns ------------------------------------------------------------

_CODES = """codes AS (SELECT tx_id, CASE feature WHEN 'amount_zscore_90d' THEN 'AMOUNT_ABOVE_NORMAL'
    WHEN 'counterparty_confirmed_fraud_90d' THEN 'COUNTERPARTY_FRAUD_HISTORY'
    WHEN 'device_is_new_for_account' THEN 'NEW_DEVICE' WHEN 'is_local_night' THEN 'UNUSUAL_HOUR'
    ELSE 'VELOCITY_SPIKE' END AS code, shap, row_number() OVER (PARTITION BY tx_id ORDER BY abs(shap) DESC, feature) AS r
  FROM contributions),
model AS (SELECT tx_id, list(code ORDER BY r) AS codes FROM
  (SELECT tx_id, code, min(r) AS r FROM codes WHERE shap > 0 GROUP BY 1, 2) GROUP BY 1)"""


@query(
    "x19_x20_model_reasons",
    sql(
        "SELECT p.tx_id, coalesce(array_to_string(codes[1:3], ','), '') AS reasons FROM payments p LEFT JOIN model USING (tx_id)",
        "contributions",
        then=_CODES,
    ),
)
def model_reasons(spark, sf):
    c = operations.contributions(tables.payments(spark, sf))
    merged = reasons.merge(reasons.model_reasons(F.col("contributions")))
    return c.select("tx_id", F.concat_ws(",", merged).alias("reasons"))


_DECIDED = f"""based AS (SELECT p.*, cents % 50 = 0 AS fallback,
    CAST((k * 11 + cents * 3) % 1000 AS DOUBLE) / 1000.0::DOUBLE AS anomaly,
    CASE WHEN cents % 50 = 0 THEN CASE WHEN amount >= 2000000 THEN 1 ELSE 0 END
      WHEN score >= 0.85::DOUBLE THEN 2 WHEN score >= 0.6::DOUBLE THEN 1 ELSE 0 END AS rank,
    CASE WHEN {_R1} THEN 2 WHEN {_R3} THEN 1 ELSE -1 END AS ruled,
    c.open AS breaker_open, f.ft IS NOT NULL AND f.ft < p.t AS frozen
  FROM payments p
  JOIN changed c ON c.institution = 'I' || CAST(p.account % 4 AS VARCHAR) AND c.mcc = p.mcc AND c.minute = p.t // 60000000
  LEFT JOIN (SELECT account, min(t) AS ft FROM (SELECT account, t, count(*) OVER (PARTITION BY account ORDER BY t
    RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW) AS c FROM payments WHERE score >= 0.6::DOUBLE)
    WHERE c >= 3 GROUP BY account) f ON f.account = p.account),
lifted AS (SELECT *, CASE WHEN breaker_open AND greatest(rank, ruled) = 0 THEN 1 ELSE greatest(rank, ruled) END AS final,
  breaker_open AND greatest(rank, ruled) = 0 AS by_breaker FROM based),
reasoned AS (SELECT l.*, list_concat(list_concat(CASE WHEN fallback THEN ['ML_UNAVAILABLE'] ELSE []::VARCHAR[] END,
    list_concat(CASE WHEN ruled > rank THEN ['CUSTOM_RULE'] ELSE []::VARCHAR[] END,
      CASE WHEN by_breaker THEN ['MCC_CIRCUIT_BREAKER'] ELSE []::VARCHAR[] END)),
    CASE WHEN fallback THEN CASE WHEN rank = 1 THEN ['AMOUNT_ABOVE_NORMAL'] ELSE []::VARCHAR[] END
      ELSE coalesce(m.codes, ['MODEL_RISK_SCORE']) END) AS all_reasons
  FROM lifted l LEFT JOIN model m USING (tx_id))"""


@query(
    "d08_decision",
    sql(
        f"""SELECT tx_id, CASE WHEN frozen OR final = 2 THEN 'DECLINE' WHEN final = 1 THEN 'HOLD' ELSE 'APPROVE' END AS decision,
  ['LOW', 'MEDIUM', 'HIGH'][final + 1] AS decision_tier,
  CASE WHEN frozen THEN NULL WHEN final > 0 THEN ['LOW', 'MEDIUM', 'HIGH'][final + 1]
    WHEN NOT fallback AND anomaly >= 0.95::DOUBLE THEN 'ANOMALY' END AS alert,
  CASE WHEN NOT frozen AND final = 1 THEN t + {REVIEW} END AS review_deadline,
  NOT frozen AND final = 2 AS auto_block,
  CASE WHEN frozen THEN 'ACCOUNT_FROZEN' WHEN final > 0 THEN array_to_string(all_reasons[1:3], ',')
    WHEN fallback THEN 'ML_UNAVAILABLE' ELSE '' END AS reasons
FROM reasoned""",
        "payments",
        "contributions",
        then=_BREAKER + ",\n" + _CODES + ",\n" + _DECIDED,
    ),
)
def decision(spark, sf):
    p = tables.payments(spark, sf)
    hot = hot_keys(spark, sf, p)
    rows = rules.evaluate(p.withColumn("anomaly", operations.anomaly_score()), RULES)
    rows = rows.withColumn("institution", operations.institution()).withColumn(
        "minute", F.expr(f"t div {decide.MINUTE}")
    )
    open_at = breaker_states(spark, sf).select(
        "institution", "mcc", "minute", F.col("open").alias("breaker_open")
    )
    rows = rows.join(open_at, ["institution", "mcc", "minute"])
    rows = decide.frozen_since(rows, _freezes(spark, sf, hot), hot.split("account"))
    explained = operations.contributions(p).select("tx_id", "contributions", "fallback")
    out = decide.decide(rows.join(explained, "tx_id"), REVIEW)
    return out.select(
        "tx_id", "decision", "decision_tier", "alert", "review_deadline", "auto_block",
        F.concat_ws(",", "reasons").alias("reasons"),
    )


@query(
    "p03_x07_expected_loss",
    sql(
        """SELECT tx_id, CAST(round_even(CAST(score AS DECIMAL(9,8)) * amount, 4) AS DOUBLE) AS expected_loss FROM payments""",
        "payments",
    ),
)
def expected_loss(spark, sf):
    p = tables.payments(spark, sf)
    return p.select("tx_id", money.expected_loss(F.col("score"), F.col("amount")).cast("double").alias("expected_loss"))


@query(
    "p04_j02_fx_to_base",
    sql(
        """SELECT p.tx_id, CAST(p.cents * v.rate AS BIGINT) AS base_hundred_thousandths, v.rate_date
FROM located p ASOF LEFT JOIN (SELECT currency, rate_date, arg_max(rate_thousandths, recorded_at) AS rate
  FROM fx_rates GROUP BY 1, 2) v ON p.currency = v.currency AND p.t >= v.rate_date""",
        "located",
        "fx_rates",
    ),
)
def fx(spark, sf):
    """Base value in exact hundred-thousandths, at the last rate dated on or before the payment."""
    p = tables.with_countries(tables.payments(spark, sf), spark, sf).select("tx_id", "t", "currency", "cents")
    rates = asof.rates_on(tables.fx_rates(spark, sf))
    # Currencies are few, large keys: cut them in time.
    hot = decide.Split("currency", tuple(f"C{i}" for i in range(25)), tables.DAY)
    out = asof.asof(p, rates.withColumn("d", F.col("rate_date")), "currency", "t", "d",
                    ["rate_thousandths", "rate_date"], split=hot)
    return out.select(
        "tx_id", (F.col("cents") * F.col("rate_thousandths")).alias("base_hundred_thousandths"), "rate_date"
    )
