"""Keyed feature state over streams: one query for each kind of key, restore, expiry, freezes with release."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.operators import decide
from tidewatch.plans import operations, tables
from tidewatch.plans.registry import CASH_OUT_CODES, FEATURES, micros
from tidewatch.queries.features import hot_keys, prior
from tidewatch.queries.registry import query
from tidewatch.queries.streams import LETTERS, SPLIT, letters, payments, restarted, scratch, stateful
from tidewatch.queries.views import EPOCH, sql
from tidewatch.sources import topics
from tidewatch.streaming import flows, history, keybuckets, machines, recovery, state

DAY, HOUR, SECOND = tables.DAY, tables.HOUR, tables.SECOND


def _w(span: str, key: str) -> str:
    return f"(PARTITION BY {key} ORDER BY t RANGE BETWEEN {micros(span) - 1} PRECEDING AND 1 PRECEDING)"


def _events(spark, sf, spec: history.Keyed) -> DataFrame:
    p = payments(spark, sf)
    p = p.withColumn("units", (F.col("amount") * 10_000).cast("long")).withColumn("cash", F.col("mcc").isin(list(CASH_OUT_CODES)).cast("long"))
    return history.events(p, p if spec.labels else None, spec)


def answers(spark, sf, spec: history.Keyed) -> DataFrame:
    """The processor's answers over two runs, the second of which takes up the state of the first."""
    make = lambda stream: keybuckets.stage(stream, keybuckets.BucketHistory(spec))
    return stateful(spark, _events(spark, sf, spec), "at", SPLIT, make, spec.schema)


def _seconds(name: str):
    return F.round((F.col("_t") - F.col("previous")) / 1e6, 6).alias(name)


def account_features(answers: DataFrame, p: DataFrame) -> DataFrame:
    """Features from an account's answers: sums in money, ratio and recency."""
    rows = answers.join(p.select("tx_id", F.col("t").alias("_t")), "tx_id")
    observed = F.least(F.lit(micros("30d")), F.col("_t") - F.col("first_seen")) / F.lit(3.6e9) - F.lit(1.0)
    mean = F.when(observed > 0, (F.col("tx_count_30d") - F.col("tx_count_1h")) / observed).otherwise(0.0)
    alpha = F.lit(FEATURES["velocity_ratio_1h_vs_30d"].alpha)
    return rows.select(
        "tx_id", "tx_count_60s", "tx_count_1h", "tx_count_24h", "tx_count_7d",
        F.round(F.col("units_24h") / 10_000, 6).alias("amount_sum_24h"), F.round(F.col("units_7d") / 10_000, 6).alias("amount_sum_7d"),
        "unique_counterparties_24h", "device_changes_24h", _seconds("seconds_since_last_tx"),
        F.round((F.col("tx_count_1h") + alpha) / (mean + alpha), 6).alias("velocity_ratio_1h_vs_30d"),
    )


def _account_twin(where: str = "TRUE") -> str:
    counts = ", ".join(f"count(*) OVER {_w(s, 'account')} AS tx_count_{s}" for s in ("60s", "1h", "24h", "7d", "30d"))
    sums = ", ".join(f"round(CAST(coalesce(sum(amount) OVER {_w(s, 'account')}, 0) AS DOUBLE), 6) AS amount_sum_{s}" for s in ("24h", "7d"))
    return sql(
        f"""SELECT tx_id, tx_count_60s, tx_count_1h, tx_count_24h, tx_count_7d, amount_sum_24h, amount_sum_7d, unique_counterparties_24h,
  device_changes_24h, seconds_since_last_tx,
  round((tx_count_1h + 1.0) / (CASE WHEN hours > 0 THEN (tx_count_30d - tx_count_1h) / hours ELSE 0 END + 1.0), 6) AS velocity_ratio_1h_vs_30d
FROM (SELECT tx_id, t, {counts}, {sums}, count(DISTINCT counterparty) OVER {_w("24h", "account")} AS unique_counterparties_24h,
    CASE WHEN device IS NOT NULL THEN count(DISTINCT device) OVER {_w("24h", "account")}
      - CAST(count(*) OVER {_w("24h", "account, device")} > 0 AS BIGINT) END AS device_changes_24h,
    round((t - max(t) OVER (PARTITION BY account ORDER BY t RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) / 1e6::DOUBLE, 6) AS seconds_since_last_tx,
    least({micros("30d")}, t - min(t) OVER (PARTITION BY account)) / 3.6e9::DOUBLE - 1.0::DOUBLE AS hours FROM payments)
WHERE {where}""",
        "payments",
    )


@query("k01_stream_account_features", _account_twin())
def stream_account(spark, sf):
    return account_features(answers(spark, sf, history.ACCOUNT), payments(spark, sf))


@query(
    "k01_stream_counterparty_features",
    sql(
        f"""SELECT p.tx_id, any_value(senders) AS counterparty_unique_senders_24h, count(h.tx_id) AS counterparty_confirmed_fraud_90d
FROM (SELECT *, count(DISTINCT account) OVER {_w("24h", "counterparty")} AS senders FROM payments) p
LEFT JOIN payments h ON h.counterparty = p.counterparty AND h.is_fraud AND h.t < p.t AND h.t > p.t - {micros("90d")} AND h.label_at < p.t
GROUP BY p.tx_id""",
        "payments",
    ),
)
def stream_counterparty(spark, sf):
    """Payments and labels as one stream, each at the time it becomes known."""
    return answers(spark, sf, history.COUNTERPARTY).select("tx_id", "counterparty_unique_senders_24h", "counterparty_confirmed_fraud_90d")


def _with_own(key: str, span: str) -> str:
    return f"""count(DISTINCT account) OVER {_w(span, key)} + 1 - CAST(count(*) OVER {_w(span, f"{key}, account")} > 0 AS BIGINT)"""


@query(
    "k01_stream_device_features",
    sql(
        f"""SELECT tx_id, {_with_own("device", "7d")} AS accounts_per_device_7d,
  round((t - min(t) OVER (PARTITION BY device)) / 86400000000.0::DOUBLE, 6) AS device_age_days FROM payments WHERE device IS NOT NULL""",
        "payments",
    ),
)
def stream_device(spark, sf):
    """The device's first sighting is a durable fact of its key."""
    rows = answers(spark, sf, history.DEVICE).join(payments(spark, sf).select("tx_id", "t"), "tx_id")
    return rows.select("tx_id", "accounts_per_device_7d", F.round((F.col("t") - F.col("first_seen")) / float(DAY), 6).alias("device_age_days"))


@query(
    "k01_stream_agent_features",
    sql(
        f"""SELECT tx_id, count(*) FILTER (WHERE mcc = '6011') OVER {_w("1h", "agent")} AS agent_cashout_count_1h,
  {_with_own("agent", "1h")} AS agent_unique_customers_1h FROM payments WHERE agent IS NOT NULL""",
        "payments",
    ),
)
def stream_agent(spark, sf):
    return answers(spark, sf, history.AGENT).select("tx_id", "agent_cashout_count_1h", "agent_unique_customers_1h")


@query(
    "k01_stream_cell_features",
    sql(
        f"""SELECT tx_id, round((fraud + 50.0::DOUBLE * prior) / (labelled + 50.0::DOUBLE), 6) AS geo_cell_fraud_rate_30d FROM
  (SELECT p.tx_id, count(h.tx_id) AS labelled, count(h.tx_id) FILTER (WHERE h.is_fraud) AS fraud
   FROM payments p LEFT JOIN payments h ON h.cell = p.cell AND h.t < p.t
     AND h.t > p.t - {micros("30d")} AND h.label_at < p.t GROUP BY p.tx_id),
  (SELECT CAST(count(*) FILTER (WHERE is_fraud) AS DOUBLE) / count(*) AS prior FROM payments WHERE t < {EPOCH + 20 * DAY})""",
        "payments",
    ),
)
def stream_cell(spark, sf):
    alpha, base = FEATURES["geo_cell_fraud_rate_30d"].alpha, prior(payments(spark, sf))
    rate = (F.col("fraud_30d") + F.lit(alpha * base)) / (F.col("labelled_30d") + F.lit(alpha))
    return answers(spark, sf, history.CELL).select("tx_id", F.round(rate, 6).alias("geo_cell_fraud_rate_30d"))


# ---- durable restore -----------------------------------------------------------------------------------------


def restored_answers(spark, sf, spec: history.Keyed, with_snapshot: bool = True) -> DataFrame:
    """Only the later events, in a stream without the earlier one's checkpoint; its state comes from the history."""
    rows = _events(spark, sf, spec)
    before = history.snapshot_of(rows, spec, SPLIT) if with_snapshot else None
    base = scratch(spark)
    rows.filter(F.col("at") >= SPLIT).write.parquet(f"{base}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{base}/in")
    out = keybuckets.stage(stream, keybuckets.BucketHistory(spec), initial=before)
    flows.run_available(out, flows.append_to(f"{base}/out"), f"{base}/ckpt").awaitTermination()
    return flows.stored(spark, f"{base}/out", spec.schema)


@query("k02_restored_account_state", _account_twin(f"t >= {SPLIT}"))
def restored_account(spark, sf):
    """After the loss of the checkpoint the answers are those of a run that never stopped."""
    return account_features(restored_answers(spark, sf, history.ACCOUNT), payments(spark, sf))


@query(
    "k02_restored_counterparty_state",
    sql(
        f"""SELECT p.tx_id, any_value(senders) AS counterparty_unique_senders_24h, count(h.tx_id) AS counterparty_confirmed_fraud_90d,
  any_value(first_seen) AS first_seen
FROM (SELECT *, count(DISTINCT account) OVER {_w("24h", "counterparty")} AS senders, min(t) OVER (PARTITION BY counterparty) AS first_seen FROM payments) p
LEFT JOIN payments h ON h.counterparty = p.counterparty AND h.is_fraud AND h.t < p.t AND h.t > p.t - {micros("90d")} AND h.label_at < p.t
WHERE p.t >= {SPLIT} GROUP BY p.tx_id""",
        "payments",
    ),
)
def restored_counterparty(spark, sf):
    """Labels that became available before the loss count after it."""
    out = restored_answers(spark, sf, history.COUNTERPARTY)
    return out.select("tx_id", "counterparty_unique_senders_24h", "counterparty_confirmed_fraud_90d", "first_seen")


# ---- idle expiry -----------------------------------------------------------------------------------------------

#: Far shorter than the defaults, so that this data has quiet keys.
_IDLE, _KEPT, _DELAY = 6 * HOUR, 12 * HOUR, 600 * SECOND


@query(
    "k04_idle_expiry",
    sql(
        f"""SELECT counterparty, min(t) AS first_seen, max(t) FILTER (WHERE NOT told) AS last_seen,
  max("at") + {_IDLE} >= w AND max(t) FILTER (WHERE NOT told) // {HOUR} >= (max("at") - {DAY}) // {HOUR} AS has_windows,
  count(*) FILTER (WHERE told) > 0 AND max("at") + {_KEPT} >= w AS has_labels
FROM (SELECT counterparty, t, t AS "at", FALSE AS told FROM payments UNION ALL SELECT counterparty, t, label_at, TRUE FROM payments),
  (SELECT max(label_at) - {_DELAY} AS w FROM payments) GROUP BY counterparty, w""",
        "payments",
    ),
)
def idle_expiry(spark, sf):
    """What the state holds when all is over, read back from the checkpoint: quiet keys keep their facts alone."""
    spec, base = history.COUNTERPARTY, scratch(spark)
    rows = _events(spark, sf, spec)
    for part in (rows.filter(F.col("at") < SPLIT), rows.filter(F.col("at") >= SPLIT)):
        part.write.mode("append").parquet(f"{base}/in")
        stream = spark.readStream.schema(rows.schema).parquet(f"{base}/in")
        timed = stream.withColumn("ts", F.timestamp_micros("at")).withWatermark("ts", f"{_DELAY // SECOND} seconds")
        out = keybuckets.stage(timed, keybuckets.BucketHistory(spec, timers=True, idle=_IDLE, kept=_KEPT), time="EventTime")
        flows.run_available(out, flows.append_to(f"{base}/out"), f"{base}/ckpt").awaitTermination()
    found = keybuckets.kept_facts(spark, f"{base}/ckpt", spec)
    for name, part in (("has_windows", "account"), ("has_labels", history.LABELS)):
        held = keybuckets.kept_keys(spark, f"{base}/ckpt", spec, part).withColumn(name, F.lit(True))
        found = found.join(held, "counterparty", "left")
    return found.select(
        "counterparty", "first_seen", "last_seen", F.coalesce("has_windows", F.lit(False)).alias("has_windows"),
        F.coalesce("has_labels", F.lit(False)).alias("has_labels"),
    )


# ---- freezes with release --------------------------------------------------------------------------------------

_RELEASED = "channel = 'ONLINE' AND k % 3 = 0"
_MACHINE = f"""highs AS (SELECT tx_id, account, t, count(*) OVER (PARTITION BY account ORDER BY t
  RANGE BETWEEN {DAY - 1} PRECEDING AND CURRENT ROW) AS c FROM payments WHERE score >= 0.6::DOUBLE),
ordered AS (SELECT *, row_number() OVER (PARTITION BY account ORDER BY t, kind, tx_id) AS r FROM (
  SELECT account, t, 0 AS kind, tx_id, c >= 3 AS enough FROM highs
  UNION ALL SELECT account, t, 1, tx_id, FALSE FROM payments WHERE {_RELEASED})),
machine AS (
  SELECT account, t, kind, tx_id, r, enough AS fires, FALSE AS releases, enough AS frozen FROM ordered WHERE r = 1
  UNION ALL
  SELECT o.account, o.t, o.kind, o.tx_id, o.r, o.enough AND NOT m.frozen, o.kind = 1 AND m.frozen,
    CASE WHEN o.kind = 1 THEN FALSE ELSE m.frozen OR o.enough END
  FROM machine m JOIN ordered o ON o.account = m.account AND o.r = m.r + 1)"""


def _recursive(body: str) -> str:
    return sql(body, "payments", then=_MACHINE).replace("WITH ", "WITH RECURSIVE ", 1)


@query(
    "k09_stream_freeze_release",
    _recursive("""SELECT account, tx_id, CASE WHEN fires THEN 'FROZEN' ELSE 'RELEASED' END AS event, t AS "at" FROM machine WHERE fires OR releases"""),
)
def stream_freeze_release(spark, sf):
    """HIGH decisions and releases in one stream; a window of a day, so that accounts freeze again and again."""
    p = payments(spark, sf)
    high = p.filter("score >= 0.6").select("account", F.lit(machines.HIGH).alias("kind"), F.col("t").alias("at"), "tx_id")
    release = p.filter(_RELEASED).select("account", F.lit(machines.RELEASE).alias("kind"), F.col("t").alias("at"), "tx_id")
    make = lambda stream: state.keyed(stream, "account", machines.FreezeMachine(span=DAY), machines.FREEZES)
    return stateful(spark, high.unionByName(release), "at", SPLIT, make, machines.FREEZES)


@query("k09_freeze_episodes", _recursive("SELECT account, tx_id, t FROM machine WHERE fires"))
def freeze_episodes(spark, sf):
    """The same freezes over the whole history, without a loop: by the last release and the last candidate before."""
    p = payments(spark, sf)
    rows = p.select("tx_id", "account", "t", F.when(F.col("score") >= 0.6, "HIGH").alias("tier"))
    releases = p.filter(_RELEASED).select("account", F.col("t").alias("released_at"))
    return decide.freeze_episodes(rows, releases, hot_keys(spark, sf, p), DAY)


# ---- waiting for a parent ------------------------------------------------------------------------------------------

_BUDGET = 300 * SECOND


@query(
    "k16_stream_parent_wait",
    sql(
        f"""SELECT tx_id, CASE WHEN k % 5 IN (0, 3) THEN 'parent_missing' ELSE 'matched' END AS outcome,
  t + CASE k % 5 WHEN 2 THEN {180 * SECOND} WHEN 1 THEN 0 WHEN 4 THEN 0 ELSE {_BUDGET} END AS "at" FROM payments
WHERE k % 5 <> 0 OR (t + {_BUDGET}) // 1000 < (SELECT max(t + CASE k % 5 WHEN 3 THEN {1200 * SECOND} WHEN 2 THEN {180 * SECOND} ELSE 0 END) - {600 * SECOND} FROM payments) // 1000""",
        "payments",
    ),
)
def stream_parent_wait(spark, sf):
    """Parents an hour early, at once, three minutes late, twenty minutes late, and never."""
    p = payments(spark, sf)
    late = F.expr(f"CASE k % 5 WHEN 1 THEN -{3600 * SECOND} WHEN 2 THEN {180 * SECOND} WHEN 3 THEN {1200 * SECOND} ELSE 0 END")
    children = p.select(F.col("tx_id").alias("parent"), F.lit(machines.CHILD).alias("kind"), F.col("t").alias("at"), F.col("tx_id").alias("child"))
    parents = p.filter("k % 5 <> 0").select(
        F.col("tx_id").alias("parent"), F.lit(machines.PARENT).alias("kind"), (F.col("t") + late).alias("at"), F.lit(None).cast("long").alias("child"))

    def make(stream):
        timed = stream.withColumn("ts", F.timestamp_micros("at")).withWatermark("ts", "10 minutes")
        return state.keyed(state.bucketed(timed, "parent"), "bucket", machines.ParentWaits(_BUDGET), machines.WAITED, time="EventTime")

    out = stateful(spark, children.unionByName(parents), "at", SPLIT, make, machines.WAITED)
    return out.select(F.col("child").alias("tx_id"), "outcome", "at")


# ---- handler failures, facts by bucket -------------------------------------------------------------------------------

_POISON = "tx_id % 2500 IN (7, 8)"


@query(
    "k14_handler_failures",
    sql(
        f"""SELECT CASE WHEN {_POISON} THEN 'handler_failure' ELSE 'stored' END AS outcome, tx_id,
  CASE WHEN {_POISON} THEN NULL ELSE CAST(amount AS DOUBLE) END AS amount FROM payments""",
        "payments",
    ),
)
def handler_failures(spark, sf):
    """Some payments break the handler. They are found and put aside in two runs, the rest is stored once."""
    base, p = scratch(spark), payments(spark, sf)
    rows = p.select("tx_id", "account", "k", F.col("amount").cast("double").alias("amount"), "t")

    broken = F.raise_error(F.concat(F.lit("cannot handle payment "), F.col("tx_id").cast("string"))).cast("double")
    handled = F.when(F.expr(_POISON), broken).otherwise(F.col("amount"))

    def handle(batch: DataFrame) -> DataFrame:
        return batch.withColumn("amount", handled)

    parts = [rows.filter(F.col("t") < SPLIT), rows.filter(F.col("t") >= SPLIT)]

    def read(part: DataFrame, path: str) -> DataFrame:
        # Some 400,000 payments a batch: the failing records of a batch stay far below an outage however many files arrive.
        return spark.readStream.schema(part.schema).option("maxBytesPerTrigger", 8 << 20).parquet(path)

    restarted(spark, parts, read, recovery.isolating(handle, base))
    good, dead = recovery.isolated(spark, base, rows.schema)
    kept = good.select(F.lit("stored").alias("outcome"), "tx_id", "amount")
    return kept.unionByName(dead.select(F.col("reason").alias("outcome"), "tx_id", F.lit(None).cast("double").alias("amount")))


def facts_by_key(spark, sf) -> tuple[DataFrame, recovery.KeyedFacts]:
    """Decision states with redeliveries that say otherwise, and a store for them by the day of their transaction."""
    p = payments(spark, sf).select("tx_id", "t", operations.institution().alias("institution"))
    states = operations.decision_states(payments(spark, sf)).select("tx_id", F.col("seq").cast("int").alias("seq"), "decision", "at")
    rows = states.join(p, "tx_id").withColumn("copy", F.explode(F.sequence(F.lit(0), (F.col("tx_id") % 3).cast("int"))))
    rows = rows.select(
        "institution", "tx_id", "seq", F.col("t").alias("transaction_at"),
        F.when(F.col("copy") == 0, F.col("decision")).otherwise(F.lit("LATER COPY")).alias("decision"), (F.col("at") + F.col("copy") * DAY).alias("seen_at"))
    day = F.expr(f"transaction_at div {DAY}")
    store = recovery.KeyedFacts(scratch(spark), ["institution", "tx_id", "seq"], ["seen_at"], rows.schema, day)
    return rows, store


@query(
    "k13_s14_facts_by_key",
    sql(
        """SELECT 'I' || CAST(s.account % 4 AS VARCHAR) AS institution, s.tx_id, s.seq, p.t AS transaction_at, s.decision, s."at" AS seen_at
FROM states s JOIN payments p USING (tx_id)""",
        "states",
    ),
)
def facts_once(spark, sf):
    """Three runs, the last of which repeats all earlier facts: the first write of each key stays."""
    rows, store = facts_by_key(spark, sf)
    parts = [rows.filter(F.col("seen_at") < SPLIT), rows.filter(F.col("seen_at") >= SPLIT), rows.withColumn("seen_at", F.col("seen_at") + 90 * DAY)]
    restarted(spark, parts, lambda part, path: spark.readStream.schema(part.schema).parquet(path), store.write)
    return store.stored(spark)


@query(
    "k15_replay_counts",
    sql(
        """SELECT count(*) FILTER (WHERE chosen) AS replayed, CAST(coalesce(sum(copies - 1) FILTER (WHERE chosen), 0) AS BIGINT) AS older_copies,
  CAST(coalesce(sum(copies) FILTER (WHERE NOT chosen), 0) AS BIGINT) AS skipped
FROM (SELECT event_id IS NOT NULL AND arg_max(reason, dead_at) IN ('handler', 'parent_missing') AS chosen, count(*) AS copies
      FROM letters GROUP BY event_id)""",
        "payments",
        then=LETTERS,
    ),
)
def replay_counts(spark, sf):
    """What a replay would send again, what it would leave behind as older copies, and what it would skip."""
    return topics.replay_counts(letters(payments(spark, sf)), ["handler", "parent_missing"])
