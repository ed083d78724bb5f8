"""Sources, sinks and streams. Streams run over the payments as files until all are processed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.functions import keys
from tidewatch.operators import aggregates as ag
from tidewatch.operators import features as ft
from tidewatch.operators import quality
from tidewatch.plans import operations, tables
from tidewatch.queries.evaluation import rounded
from tidewatch.queries.features import hot_keys
from tidewatch.queries.registry import query
from tidewatch.queries.views import EPOCH, sql
from tidewatch.session import scratch_dir, stored
from tidewatch.sources import history, release, requests, topics
from tidewatch.streaming import flows, state

DAY, HOUR, SECOND = tables.DAY, tables.HOUR, tables.SECOND


def payments(spark, sf) -> DataFrame:
    return tables.payments(spark, sf)


def scratch(spark) -> str:
    """A folder of its own in the shared place, for one run."""
    return scratch_dir(spark, "tidewatch")


SPLIT = EPOCH + 15 * DAY


def _payments(p: DataFrame) -> DataFrame:
    return p.select(*[f.name for f in flows.PAYMENT.fields])


def _in_two_runs(spark, rows: DataFrame, at: str, cut_at: int, start) -> None:
    """Files of the earlier rows, a run to the end, then the later ones and a restarted run.

    Each run is one micro-batch, so time moves forward from batch to batch whatever order the files
    of a folder are listed in, and the second run takes up the state the first one left.
    """
    for part in (rows.filter(F.col(at) < cut_at), rows.filter(F.col(at) >= cut_at)):
        start(part)


def stateful(spark, rows: DataFrame, at: str, cut_at: int, make, schema: T.StructType) -> DataFrame:
    base = scratch(spark)

    def run(part: DataFrame) -> None:
        part.write.mode("append").parquet(f"{base}/in")
        stream = spark.readStream.schema(rows.schema).parquet(f"{base}/in")
        flows.run_available(make(stream), flows.append_to(f"{base}/out"), f"{base}/ckpt").awaitTermination()

    _in_two_runs(spark, rows, at, cut_at, run)
    return flows.stored(spark, f"{base}/out", schema)


# ---- scans ------------------------------------------------------------------------------------------------


@query("s01_column_scan", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def column_scan(spark, sf):
    return tables.read(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")


@query(
    "s02_utc_month",
    sql(
        f"SELECT tx_id, t FROM payments_days WHERE t >= epoch_us(TIMESTAMP '1996-03-01') AND t < epoch_us(TIMESTAMP '1996-04-01')",
        "payments_days",
    ),
)
def utc_month(spark, sf):
    """Rows of one UTC month out of partitions named by a local month two hours ahead."""
    local = F.timestamp_micros(F.col("t") + 2 * HOUR)
    p = tables.payments_days(spark, sf).withColumn("month", F.date_format(local, "yyyy-MM"))
    return history.scan_utc_month(p, "1996-03", "t").select("tx_id", "t")


@query("s05_events_of_type", "SELECT event_id, user_id FROM events WHERE event_type = 'purchase'")
def events_of_type(spark, sf):
    return history.events_of(tables.read(spark, sf, "events"), "purchase").select("event_id", "user_id")


@query(
    "s06_j14_pack_conflicts",
    sql("SELECT currency, min(country) AS country FROM countries GROUP BY 1 HAVING count(*) = 1", "countries"),
)
def packs(spark, sf):
    return ag.country_of_currency(tables.countries(spark, sf))


@query(
    "s08_s09_release_manifest",
    sql(
        """SELECT 'labels' AS "table", count(*) AS source_rows, count(*) AS parquet_rows, count(*) AS csv_rows, TRUE AS reconciled FROM label_events
UNION ALL SELECT 'payments', count(*), count(*), count(*), TRUE FROM payments""",
        "label_events",
    ),
)
def release_manifest(spark, sf):
    p = payments(spark, sf)
    out = f"{scratch(spark)}/release"
    return release.export_release(
        {"payments": p.select("tx_id", "account", "t", "cents", "channel"), "labels": operations.label_events(p)}, out
    )


@query("s10_checksums")
def release_checksums(spark, sf):
    """Nothing has changed since the list was made; the files themselves are counted."""
    out = f"{scratch(spark)}/release"
    p = payments(spark, sf)
    release.export_release({"payments": p.select("tx_id", "account", "t", "cents", "channel")}, out)
    release.checksums(spark, f"{out}/parquet").write.parquet(f"{out}-list")
    listed = spark.read.parquet(f"{out}-list")
    changed = release.verify(spark, f"{out}/parquet", listed)
    k = F.lit(0).alias("k")
    return (
        changed.agg(F.count("*").alias("changed")).select("*", k)
        .join(listed.agg(F.sum(F.col("file").endswith(".parquet").cast("long")).alias("files")).select("*", k), "k")
        .select("changed", (F.col("files") > 0).alias("has_files"))
    )


@query(
    "s07_s08_month_partitions",
    sql(
        """SELECT strftime(ts, '%Y-%m') AS month, count(*) AS rows, count(DISTINCT account) AS accounts,
  round(avg(CAST(amount AS DOUBLE)), 4) AS mean_amount FROM payments GROUP BY 1""",
        "payments",
    ),
)
def month_partitions(spark, sf):
    """Written by month in two appends, and profiled by partition."""
    base = f"{scratch(spark)}/months"
    p = payments(spark, sf).select(F.col("ts").alias("transaction_timestamp"), F.col("account").alias("account_id"), F.col("amount").alias("amount_rwf"), "t")
    for part in (p.filter(F.col("t") < SPLIT), p.filter(F.col("t") >= SPLIT)):
        history.write_month(part, base)
    schema = T.StructType([*p.schema.fields, T.StructField("month", T.StringType())])
    return rounded(history.profile(spark.read.schema(schema).parquet(base)).withColumn("mean_amount", F.col("mean_amount").cast("double")), "mean_amount", digits=4)


@query(
    "s11_feature_cache",
    sql(
        "SELECT tx_id, count(*) OVER (PARTITION BY account ORDER BY t RANGE BETWEEN 3599999999 PRECEDING AND 1 PRECEDING) AS tx_count_1h FROM payments",
        "payments",
    ),
)
def feature_cache(spark, sf):
    p = payments(spark, sf)
    base = f"{scratch(spark)}/features"
    key = {"data": sf, "features": ["tx_count_1h"]}
    compute = lambda: ft.account_history(p, hot_keys(spark, sf, p)).select("tx_id", "tx_count_1h")
    release.feature_cache(spark, base, key, compute)
    return release.feature_cache(spark, base, key, compute)


# ---- topics ---------------------------------------------------------------------------------------------------

PAYLOAD = T.StructType([T.StructField("tx_id", T.LongType()), T.StructField("cents", T.LongType())])


def _records(p: DataFrame) -> DataFrame:
    """Envelopes of all payments, some of them broken on the way."""
    made = topics.to_envelope(
        p.withColumn("institution", operations.institution()), "payment.decided", F.col("account"),
        keys.derived_id(F.lit("event"), F.col("tx_id")), F.col("t"), F.col("institution"),
        ["tx_id", "cents"],
    )
    tx = F.get_json_object(F.get_json_object("value", "$.payload"), "$.tx_id").cast("long")
    return made.select(
        "key",
        F.when(tx % 101 == 0, F.substring("value", 1, 40))
        .when(tx % 103 == 0, F.regexp_replace("value", "payment.decided", "payment.held"))
        .when(tx % 107 == 0, F.regexp_replace("value", '"schema_version":1', '"schema_version":9'))
        .when(tx % 109 == 0, F.regexp_replace("value", '"event_type":"payment.decided",', ""))
        .when(tx % 113 == 0, F.regexp_replace("value", '"schema_version":1,', ""))
        .when(tx % 127 == 0, F.regexp_replace("value", '"payload":".*"', '"payload":"{no json"'))
        .otherwise(F.col("value")).alias("value"),
    )


_REASON = """CASE WHEN tx_id % 101 = 0 THEN 'malformed' WHEN tx_id % 103 = 0 THEN 'wrong_type'
  WHEN tx_id % 107 = 0 THEN 'wrong_version' WHEN tx_id % 109 = 0 THEN 'wrong_type' WHEN tx_id % 113 = 0 THEN 'wrong_version'
  WHEN tx_id % 127 = 0 THEN 'malformed' END"""


@query(
    "s12_k14_envelope_routing",
    sql(
        f"""SELECT reason, count(*) AS n, CAST(coalesce(sum(CASE WHEN reason IS NULL THEN cents END), 0) AS BIGINT) AS cents
FROM (SELECT {_REASON} AS reason, cents FROM payments) GROUP BY 1""",
        "payments",
    ),
)
def envelope_routing(spark, sf):
    parsed = topics.envelopes(_records(payments(spark, sf)), "payment.decided", 1, PAYLOAD)
    return parsed.groupBy("reason").agg(
        F.count("*").alias("n"),
        F.coalesce(F.sum(F.when(F.col("reason").isNull(), F.col("payload.cents"))), F.lit(0)).alias("cents"),
    )


@query(
    "s13_topic_records",
    sql(
        """SELECT CAST(account AS VARCHAR) AS key, '{"tx_id":' || tx_id || ',"cents":' || cents || '}' AS payload FROM payments""",
        "payments",
    ),
)
def topic_records(spark, sf):
    p = payments(spark, sf).withColumn("institution", operations.institution())
    made = topics.to_envelope(
        p, "payment.decided", F.col("account"), keys.derived_id(F.lit("event"), F.col("tx_id")), F.col("t"),
        F.col("institution"), ["tx_id", "cents"],
    )
    return made.select("key", F.get_json_object("value", "$.payload").alias("payload"))


@query(
    "s12_k14_stream_routing",
    sql(
        f"""SELECT count(*) FILTER (WHERE reason IS NULL) AS events, count(*) FILTER (WHERE reason IS NOT NULL) AS dead
FROM (SELECT {_REASON} AS reason FROM payments)""",
        "payments",
    ),
)
def stream_routing(spark, sf):
    """The same records through a stream, split into two folders."""
    base = scratch(spark)
    _records(payments(spark, sf)).select("value").write.text(f"{base}/in")
    stream = topics.read_files(spark, f"{base}/in", 2)
    flows.run_available(
        stream, flows.route("payment.decided", 1, PAYLOAD, f"{base}/split"), f"{base}/ckpt"
    ).awaitTermination()
    k = F.lit(0).alias("k")
    events = spark.read.parquet(f"{base}/split/events").agg(F.count("*").alias("events")).select("*", k)
    dead = spark.read.parquet(f"{base}/split/dead").agg(F.count("*").alias("dead")).select("*", k)
    return events.join(dead, "k").drop("k")


def letters(p: DataFrame) -> DataFrame:
    """Dead letters: payments of some ids died once or twice, for reasons that changed."""
    reason = F.when(F.col("k") % 3 == 0, "handler").when(F.col("k") % 3 == 1, "malformed").otherwise("parent_missing")
    first = F.struct(F.col("t").alias("dead_at"), reason.alias("reason"))
    again = F.struct((F.col("t") + SECOND).alias("dead_at"), F.lit("handler").alias("reason"))
    copies = F.array_compact(F.array(first, F.when(F.col("k") % 4 == 0, again)))
    return p.filter("k % 5 = 1").select(
        F.when(F.col("k") % 7 != 0, F.col("tx_id")).alias("event_id"), F.explode(copies).alias("c")
    ).select("event_id", F.col("event_id").cast("string").alias("value"), "c.*")


LETTERS = """letters AS (SELECT CASE WHEN k % 7 <> 0 THEN tx_id END AS event_id, t AS dead_at,
    CASE k % 3 WHEN 0 THEN 'handler' WHEN 1 THEN 'malformed' ELSE 'parent_missing' END AS reason FROM payments WHERE k % 5 = 1
  UNION ALL SELECT CASE WHEN k % 7 <> 0 THEN tx_id END, t + 1000000, 'handler' FROM payments WHERE k % 5 = 1 AND k % 4 = 0)"""


@query(
    "k15_dead_letter_replay",
    sql(
        """SELECT event_id, reason, older_copies FROM (SELECT event_id, arg_max(reason, dead_at) AS reason, count(*) - 1 AS older_copies
  FROM letters WHERE event_id IS NOT NULL GROUP BY 1) WHERE reason IN ('handler', 'parent_missing')""",
        "payments",
        then=LETTERS,
    ),
)
def dead_letter_replay(spark, sf):
    out = topics.replay(letters(payments(spark, sf)), ["handler", "parent_missing"])
    return out.select("event_id", "reason", "older_copies")


# ---- requests --------------------------------------------------------------------------------------------------


def _bodies(p: DataFrame) -> DataFrame:
    """One request body per payment; a payment's id decides what is wrong with it."""
    tx = F.col("tx_id")

    def token(kind: str, value):
        return F.concat(F.lit("tok_"), F.substring(F.sha2(F.concat_ws(":", F.lit(kind), value), 256), 1, 32))

    body = F.to_json(
        F.struct(
            keys.derived_id(F.lit("tx"), tx).alias("transaction_id"), token("account", F.col("account")).alias("account_id"),
            F.when(tx % 11 == 0, F.lit("0788123456")).otherwise(token("account", F.col("counterparty"))).alias("counterparty_id"),
            F.when(tx % 13 == 0, F.lit("007")).when(tx % 17 == 0, F.lit("-5.00")).when(tx % 19 == 0, F.lit("1.23456"))
            .otherwise(F.col("amount").cast("string")).alias("amount"),
            F.when(tx % 23 == 0, F.lit("XXX")).otherwise(F.lit("RWF")).alias("currency"), F.col("channel"),
            F.col("mcc").alias("merchant_category_code"),
            F.when(tx % 29 == 0, F.lit(95.0)).otherwise(F.col("lat")).alias("latitude"), F.col("lon").alias("longitude"),
            F.when(F.col("channel") == "AGENT_BANKING", F.when(tx % 31 != 0, token("agent", F.col("agent")))).alias("agent_id"),
            F.when(tx % 37 == 0, F.lit("yesterday")).otherwise(
                F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
            ).alias("transaction_timestamp"),
            F.when(tx % 41 == 0, F.lit("x")).alias("note"),
        )
    )
    return p.select("tx_id", "t", F.when(tx % 43 == 0, F.substring(body, 1, 20)).otherwise(body).alias("body"))


_ERRORS = f"""bad AS (SELECT tx_id, CASE WHEN tx_id % 43 = 0 THEN ':malformed_json' ELSE concat_ws(',',
    CASE WHEN tx_id % 41 = 0 THEN 'note:unknown_field' END,
    CASE WHEN tx_id % 11 = 0 THEN 'counterparty_id:not_a_token' END,
    CASE WHEN tx_id % 13 = 0 THEN 'amount:invalid_format' WHEN tx_id % 17 = 0 THEN 'amount:out_of_range'
      WHEN tx_id % 19 = 0 THEN 'amount:invalid_format' END,
    CASE WHEN tx_id % 23 = 0 THEN 'currency:unsupported_value' END,
    CASE WHEN tx_id % 29 = 0 THEN 'latitude:out_of_range' END,
    CASE WHEN tx_id % 37 = 0 THEN 'transaction_timestamp:invalid_format'
      WHEN t > {EPOCH + 25 * DAY} + 300000000 THEN 'transaction_timestamp:timestamp_in_future' END,
    CASE WHEN channel = 'AGENT_BANKING' AND tx_id % 31 = 0 THEN 'agent_id:required' END) END AS errors FROM payments)"""


@query(
    "p01_request_validation",
    sql("SELECT tx_id, errors FROM bad", "payments", then=_ERRORS),
)
def request_validation(spark, sf):
    checked = requests.validate(_bodies(payments(spark, sf)), F.lit(EPOCH + 25 * DAY))
    told = F.transform("errors", lambda e: F.concat_ws(":", e["field"], e["code"]))
    return checked.select("tx_id", F.concat_ws(",", told).alias("errors"))


def _submitted(p: DataFrame) -> DataFrame:
    """Valid requests, some sent again in another format and some with another amount."""
    again = F.array_compact(
        F.array(
            F.struct(F.lit(0).alias("n"), F.col("cents").alias("c"), F.lit("0.00").alias("pad")),
            F.when(F.col("k") % 3 == 0, F.struct(F.lit(1).alias("n"), F.col("cents").alias("c"), F.lit("00").alias("pad"))),
            F.when(F.col("k") % 7 == 0, F.struct(F.lit(2).alias("n"), (F.col("cents") + 1).alias("c"), F.lit("").alias("pad"))),
        )
    )
    rows = p.select("tx_id", "account", "counterparty", "channel", "mcc", "lat", "lon", "agent", "ts", F.explode(again).alias("a"))

    def token(kind: str, value):
        return F.concat(F.lit("tok_"), F.substring(F.sha2(F.concat_ws(":", F.lit(kind), value), 256), 1, 32))

    amount = F.concat((F.col("a.c") / 100).cast("decimal(18,2)").cast("string"), F.when(F.col("a.pad") == "00", "00").otherwise(""))
    body = F.to_json(
        F.struct(
            keys.derived_id(F.lit("tx"), F.col("tx_id")).alias("transaction_id"), token("account", F.col("account")).alias("account_id"),
            token("account", F.col("counterparty")).alias("counterparty_id"), amount.alias("amount"), F.lit("RWF").alias("currency"),
            "channel", F.col("mcc").alias("merchant_category_code"), F.col("lat").alias("latitude"), F.col("lon").alias("longitude"),
            F.when(F.col("agent").isNotNull(), token("agent", F.col("agent"))).alias("agent_id"),
            F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("transaction_timestamp"),
        )
    )
    return rows.select("tx_id", F.col("a.n").alias("arrival"), body.alias("body"))


@query(
    "p02_k12_idempotent_requests",
    sql(
        """SELECT tx_id, CAST(n AS INTEGER) AS arrival, CASE n WHEN 0 THEN 'accepted' WHEN 1 THEN 'replay' ELSE 'conflict' END AS outcome
FROM payments, range(3) r(n) WHERE n = 0 OR (n = 1 AND k % 3 = 0) OR (n = 2 AND k % 7 = 0)""",
        "payments",
    ),
)
def idempotent(spark, sf):
    sent = requests.parse(_submitted(payments(spark, sf)))
    # Bodies and fingerprints cost most of the time; they are made once and read twice.
    marked = stored(sent.select("tx_id", "arrival", requests.fingerprint().alias("fingerprint")), "requests")
    return requests.admissions(marked).select("tx_id", "arrival", "outcome")


@query(
    "s16_bulk_submission",
    sql(
        """SELECT tx_id // 500 AS batch_id, tx_id AS item, CASE WHEN errors = '' THEN 'accepted' ELSE 'rejected' END AS outcome FROM bad""",
        "payments",
        then=_ERRORS.replace(str(EPOCH + 25 * DAY), str(EPOCH + 60 * DAY)),
    ),
)
def bulk(spark, sf):
    items = _bodies(payments(spark, sf)).select(F.expr("tx_id div 500").alias("batch_id"), F.col("tx_id").alias("item"), "body")
    return requests.submit_batch(items, F.lit(EPOCH + 60 * DAY)).select("batch_id", "item", "outcome")


# ---- sinks --------------------------------------------------------------------------------------------------------


@query(
    "s14_k13_first_write_wins",
    sql(
        f"""SELECT tx_id, label FROM (SELECT *, row_number() OVER (PARTITION BY tx_id ORDER BY label_id) AS r FROM label_events)
WHERE r = 1 AND tx_id NOT IN (SELECT tx_id FROM payments WHERE t < {EPOCH + 10 * DAY})""",
        "label_events",
    ),
)
def first_write(spark, sf):
    """New label facts, where the first ten days are stored already."""
    p = payments(spark, sf)
    existing = p.filter(F.col("t") < EPOCH + 10 * DAY).select("tx_id")
    facts = operations.label_events(p).select("tx_id", "label_id", "label")
    return release.new_facts(facts, existing, ["tx_id"], ["label_id"]).select("tx_id", "label")


@query(
    "s15_profile_upsert",
    sql(
        """SELECT account, min(first_seen) AS first_seen, max(opened_at) AS opened_at FROM (
  SELECT account, min(t) AS first_seen, NULL AS opened_at FROM payments GROUP BY 1
  UNION ALL SELECT account, NULL, opened_at FROM profiles) GROUP BY 1""",
        "payments",
        "profiles",
    ),
)
def profile_upsert(spark, sf):
    p = payments(spark, sf)
    null = F.lit(None).cast("long")
    seen = p.groupBy("account").agg(F.min("t").alias("first_seen")).withColumn("opened_at", null)
    opened = tables.profiles(spark, sf).select("account", null.alias("first_seen"), "opened_at")
    return release.upsert_profiles(opened, seen)


@query(
    "s17_metrics_report",
    sql(
        "SELECT channel AS metric, count(*) AS value FROM payments GROUP BY 1",
        "payments",
    ),
)
def report(spark, sf):
    out = f"{scratch(spark)}/report"
    release.write_report(payments(spark, sf).groupBy(F.col("channel").alias("metric")).agg(F.count("*").alias("value")), out)
    return spark.read.schema("metric string, value long").json(out)


# ---- sinks of streams, stopped and started again with a new checkpoint over the stored data ---------------------


def restarted(spark, parts: list[DataFrame], read, batch) -> None:
    """Each part arrives in a folder of its own, and a new stream with a new checkpoint takes it up."""
    for part in parts:
        base = scratch(spark)
        part.write.parquet(f"{base}/in")
        flows.run_available(read(part, f"{base}/in"), batch, f"{base}/ckpt").awaitTermination()


def _files(spark):
    return lambda part, path: spark.readStream.schema(part.schema).parquet(path)


@query(
    "k12_stream_ingest",
    sql(
        """SELECT outcome, count(*) AS n FROM (
  SELECT CASE n WHEN 0 THEN 'accepted' WHEN 1 THEN 'replay' WHEN 2 THEN 'conflict' ELSE 'dead' END AS outcome FROM payments, range(4) r(n)
  WHERE n = 0 OR (n = 1 AND k % 3 = 0) OR (n = 2 AND k % 7 = 0) OR (n = 3 AND k % 5 = 0)) GROUP BY 1""",
        "payments",
    ),
)
def stream_ingest(spark, sf):
    """Requests and copies in a first run; other amounts and broken bodies in a second one."""
    p, base = payments(spark, sf), scratch(spark)
    sent = _submitted(p)
    last = F.lit(2).alias("arrival")
    broken = p.filter("k % 5 = 0").select(F.concat(F.lit('{"transaction_id":'), F.col("tx_id")).alias("value"), last)
    parts = [
        sent.filter("arrival < 2").select(F.col("body").alias("value"), "arrival"),
        sent.filter("arrival = 2").select(F.col("body").alias("value"), last).unionByName(broken),
    ]
    restarted(spark, parts, _files(spark), flows.ingest_batches(EPOCH + 60 * DAY, base, "arrival"))
    taken = spark.read.parquet(f"{base}/accepted").select(F.lit("accepted").alias("outcome"))
    refused = spark.read.parquet(f"{base}/refused").select("outcome")
    dead = spark.read.parquet(f"{base}/dead").select(F.lit("dead").alias("outcome"))
    return taken.unionByName(refused).unionByName(dead).groupBy("outcome").agg(F.count("*").alias("n"))


@query(
    "s14_stream_facts",
    sql(
        """SELECT tx_id, label_id, label FROM (SELECT *, row_number() OVER (PARTITION BY tx_id
  ORDER BY label_id % 2 = 0, label_id) AS r FROM label_events) WHERE r = 1""",
        "label_events",
    ),
)
def stream_facts(spark, sf):
    """Corrections arrive in a first run and the labels they correct in a second: what is stored first stays."""
    base = scratch(spark)
    rows = operations.label_events(payments(spark, sf)).select("tx_id", "label_id", "label")
    first = F.col("label_id") % 2 == 1
    restarted(spark, [rows.filter(first), rows.filter(~first)], _files(spark), flows.fact_sink(base, ["tx_id"], ["label_id"], rows.schema))
    return flows.stored(spark, base, rows.schema)


@query(
    "s15_stream_profiles",
    sql(
        """SELECT account, min(first_seen) AS first_seen, max(opened_at) AS opened_at FROM (
  SELECT account, min(t) AS first_seen, NULL AS opened_at FROM payments GROUP BY 1
  UNION ALL SELECT account, NULL, opened_at FROM profiles) GROUP BY 1""",
        "payments",
        "profiles",
    ),
)
def stream_profiles(spark, sf):
    base, p, null = scratch(spark), payments(spark, sf), F.lit(None).cast("long")
    seen = p.select("account", F.col("t").alias("first_seen"), null.alias("opened_at"))
    opened = tables.profiles(spark, sf).select("account", null.alias("first_seen"), "opened_at")
    later = seen.filter(F.col("first_seen") >= SPLIT)
    restarted(spark, [later, seen.filter(F.col("first_seen") < SPLIT).unionByName(opened)], _files(spark), flows.profile_sink(base))
    return flows.profiles(spark, base)


@query("k13_stream_first_copies", sql("SELECT tx_id, t FROM payments", "payments"))
def stream_first_copies(spark, sf):
    """Events delivered once to three times, and kept once."""
    base = scratch(spark)
    rows = _payments(payments(spark, sf)).withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("tx_id") % 3))).drop("copy")
    rows.write.parquet(f"{base}/in")
    kept = flows.first_copies(flows.payment_stream(spark, f"{base}/in", 1_000), "tx_id").select("tx_id", "t")
    flows.run_available(kept, flows.append_to(f"{base}/out"), f"{base}/ckpt").awaitTermination()
    return flows.stored(spark, f"{base}/out", T.StructType.fromDDL("tx_id long, t long"))


# ---- streams ----------------------------------------------------------------------------------------------------------


@query(
    "k06_stream_tumbling",
    sql(
        f"""SELECT mcc, t // {15 * 60 * SECOND} * {15 * 60 * SECOND} AS bucket, count(*) AS n, CAST(sum(amount) AS DOUBLE) AS total FROM payments
GROUP BY 1, 2 HAVING bucket + {15 * 60 * SECOND} <= (SELECT max(t) FROM payments) - {600 * SECOND}""",
        "payments",
    ),
)
def stream_tumbling(spark, sf):
    """Windows the watermark has passed, each emitted once."""
    base = scratch(spark)
    _payments(payments(spark, sf)).write.parquet(f"{base}/in")
    stream = flows.payment_stream(spark, f"{base}/in", 1_000)
    schema = T.StructType.fromDDL("mcc string, bucket long, n long, total decimal(28,4)")
    totals = flows.tumbling(stream, ["mcc"], "15 minutes")
    flows.run_available(totals, flows.append_to(f"{base}/out"), f"{base}/ckpt").awaitTermination()
    out = flows.stored(spark, f"{base}/out", schema)
    # Windows the stream may or may not have closed at its end are judged by the same rule as the twin.
    last = payments(spark, sf).agg((F.max("t") - 600 * SECOND).alias("w")).withColumn("k", F.lit(0))
    kept = out.withColumn("k", F.lit(0)).join(F.broadcast(last), "k").filter(F.col("bucket") + 15 * 60 * SECOND <= F.col("w"))
    return kept.select("mcc", "bucket", "n", F.col("total").cast("double").alias("total"))


@query(
    "k01_k02_stream_velocity",
    sql(
        """SELECT tx_id, count(*) OVER (PARTITION BY account ORDER BY t RANGE BETWEEN 59999999 PRECEDING AND 1 PRECEDING) AS tx_count_60s,
  count(*) OVER (PARTITION BY account ORDER BY t RANGE BETWEEN 3599999999 PRECEDING AND 1 PRECEDING) AS tx_count_1h,
  count(*) OVER (PARTITION BY account ORDER BY t RANGE BETWEEN 86399999999 PRECEDING AND 1 PRECEDING) AS tx_count_24h,
  count(*) OVER (PARTITION BY account ORDER BY t RANGE BETWEEN 604799999999 PRECEDING AND 1 PRECEDING) AS tx_count_7d,
  round((t - max(t) OVER (PARTITION BY account ORDER BY t RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) / 1e6::DOUBLE, 6) AS seconds_since_last_tx,
  min(t) OVER (PARTITION BY account) AS first_seen FROM payments""",
        "payments",
    ),
)
def stream_velocity(spark, sf):
    """Keyed state over two runs in time order; every row is answered before it is stored."""
    make = lambda stream: state.keyed(stream, "account", state.AccountVelocity(), state.VELOCITY)
    rows = payments(spark, sf).select("tx_id", "account", "t")
    out = stateful(spark, rows, "t", SPLIT, make, state.VELOCITY)
    return rounded(out.drop("account"), "seconds_since_last_tx")


@query(
    "k09_stream_freeze",
    sql(
        """SELECT account, arg_min(tx_id, (t, tx_id)) AS tx_id, min(t) AS frozen_at FROM (SELECT tx_id, account, t, count(*) OVER (PARTITION BY account ORDER BY t
  RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW) AS c FROM payments WHERE score >= 0.6::DOUBLE) WHERE c >= 3 GROUP BY 1""",
        "payments",
    ),
)
def stream_freeze(spark, sf):
    """A window of a day, so that this data has freezes."""
    make = lambda stream: state.keyed(stream, "account", state.AccountFreeze(span=DAY), state.FREEZE)
    rows = payments(spark, sf).filter("score >= 0.6").select("tx_id", "account", "t")
    return stateful(spark, rows, "t", SPLIT, make, state.FREEZE)


@query(
    "k08_stream_breaker",
    sql(
        """SELECT mcc, minute, open, change FROM (SELECT *, CASE WHEN open AND NOT coalesce(lag(open) OVER w, FALSE) THEN 'OPENED'
    WHEN NOT open AND coalesce(lag(open) OVER w, FALSE) THEN 'CLOSED' END AS change FROM (
  SELECT mcc, minute, coalesce(minute < max(CASE WHEN n >= 5 AND fraud > 0.10 * n THEN minute END) OVER (PARTITION BY mcc ORDER BY minute) + 120, FALSE) AS open FROM (
    SELECT mcc, minute, sum(n) OVER r AS n, sum(f) OVER r AS fraud FROM (
      SELECT mcc, t // 60000000 AS minute, count(*) AS n, count(*) FILTER (WHERE is_fraud) AS f FROM payments GROUP BY 1, 2)
    WINDOW r AS (PARTITION BY mcc ORDER BY minute RANGE BETWEEN 59 PRECEDING AND CURRENT ROW)))
  WINDOW w AS (PARTITION BY mcc ORDER BY minute))""",
        "payments",
    ),
)
def stream_breaker(spark, sf):
    """Minute totals per category arrive in two runs; a key gets one row per minute."""
    minutes = payments(spark, sf).groupBy("mcc", F.expr("t div 60000000").alias("minute")).agg(
        F.count("*").alias("n"), F.sum(F.col("is_fraud").cast("long")).alias("fraud")
    )
    make = lambda stream: state.keyed(stream, "mcc", state.MccBreaker(0.10, 60, 5, 120), state.BREAKER)
    return stateful(spark, minutes, "minute", SPLIT // 60_000_000, make, state.BREAKER)


_BUCKET = """calls AS (
  SELECT tx_id, account AS entity, t, row_number() OVER (PARTITION BY account ORDER BY t, tx_id) AS r FROM payments
), buckets AS (
  SELECT tx_id, entity, t, r, TRUE AS allowed, 1.0::DOUBLE AS tokens FROM calls WHERE r = 1
  UNION ALL
  SELECT tx_id, entity, t, r, full_to >= 1, full_to - CASE WHEN full_to >= 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END
  FROM (SELECT c.*, least(2.0::DOUBLE, b.tokens + (c.t - b.t) / 1e6::DOUBLE * (1.0::DOUBLE / 1800.0::DOUBLE)) AS full_to
        FROM buckets b JOIN calls c ON c.entity = b.entity AND c.r = b.r + 1))"""


@query(
    "k17_rate_limit",
    sql("SELECT tx_id, entity, allowed FROM buckets", "payments", then=_BUCKET).replace("WITH ", "WITH RECURSIVE ", 1),
)
def rate_limit(spark, sf):
    """Which calls exceed an account's budget of one per half hour with a burst of two."""
    make = lambda stream: state.keyed(stream, "entity", state.TokenBucket(1 / 1800, 2.0), state.LIMITED)
    rows = payments(spark, sf).select("tx_id", F.col("account").alias("entity"), "t")
    return stateful(spark, rows, "t", SPLIT, make, state.LIMITED)


@query(
    "q18_batch_stream_parity",
    sql("SELECT count(*) AS rows, 0 AS different FROM payments", "payments"),
)
def parity(spark, sf):
    """Features of rows arriving in batches against the same features over the whole history."""
    base = scratch(spark)
    schema = T.StructType(
        [f for f in flows.PAYMENT.fields if f.name in ("tx_id", "account", "counterparty", "t", "amount")]
    )
    p = payments(spark, sf)
    hot = hot_keys(spark, sf, p)
    exact = ["tx_count_60s", "tx_count_1h", "tx_count_24h", "tx_count_7d", "counterparty_is_new_for_account"]
    real = ["amount_sum_24h", "amount_sum_7d", "seconds_since_last_tx"]

    def features(rows: DataFrame) -> DataFrame:
        placed = rows.withColumn("lat", F.lit(0.0)).withColumn("lon", F.lit(0.0))
        out = ft.pair_history(ft.account_history(placed, hot), "counterparty", "_cp", hot)
        out = out.withColumn("counterparty_is_new_for_account", F.col("_cp_prev").isNull())
        return out.select("tx_id", *exact, *real)

    # Novelty and recency reach back without limit, so the horizon covers all of it.
    batches = flows.feature_batches(features, f"{base}/history", f"{base}/features", schema, 400 * DAY)

    def run(part: DataFrame) -> None:
        part.write.mode("append").parquet(f"{base}/in")
        stream = flows.payment_stream(spark, f"{base}/in", 1_000)
        flows.run_available(stream, batches, f"{base}/ckpt").awaitTermination()

    _in_two_runs(spark, _payments(p), "t", SPLIT, run)
    streamed = spark.read.parquet(f"{base}/features").drop("batch")
    whole = features(p.select(*[f.name for f in schema.fields]))
    bad = quality.parity(whole, streamed, "tx_id", exact, real).agg(F.count("*").cast("int").alias("different"))
    k = F.lit(0).alias("k")
    return streamed.agg(F.count("*").alias("rows")).select("*", k).join(bad.select("*", k), "k").drop("k")


@query(
    "k05_missing_feeds",
    sql(
        f"""SELECT 'I' || CAST(account % 4 AS VARCHAR) AS producer, count(*) AS payments,
  count(*) FILTER (WHERE k % 3 = 0 AND {EPOCH + 30 * DAY} - t > {21 * DAY}) AS overdue,
  count(*) FILTER (WHERE k % 3 = 0 AND {EPOCH + 30 * DAY} - t > {21 * DAY}) > 0 AS missing FROM payments GROUP BY 1""",
        "payments",
    ),
)
def missing_feeds(spark, sf):
    """A third of the labels never came."""
    p = payments(spark, sf).withColumn("label_at", F.when(F.col("k") % 3 != 0, F.col("label_at")))
    rows = p.withColumn("producer", operations.institution())
    return flows.missing_feeds(rows, EPOCH + 30 * DAY).select("producer", "payments", "overdue", "missing")


@query(
    "k03_stream_labels",
    sql(
        f"""SELECT p.tx_id, count(h.tx_id) AS confirmed FROM payments p LEFT JOIN payments h ON h.counterparty = p.counterparty
  AND h.is_fraud AND h.t < p.t AND h.t > p.t - {90 * DAY} AND h.label_at < p.t GROUP BY 1""",
        "payments",
    ),
)
def stream_labels(spark, sf):
    """Payments and labels as one stream, each at the time it becomes known."""
    p = payments(spark, sf)
    paid = p.select("counterparty", F.lit("payment").alias("kind"), F.col("t").alias("at"), "t", "tx_id")
    told = p.filter("is_fraud").select("counterparty", F.lit("label").alias("kind"), F.col("label_at").alias("at"), "t", "tx_id")
    make = lambda stream: state.keyed(stream, "counterparty", state.CounterpartyLabels(90 * DAY), state.LABELLED)
    return stateful(spark, paid.unionByName(told), "at", SPLIT, make, state.LABELLED).drop("counterparty")


@query(
    "k10_stream_hold_timeout",
    sql(
        f"""SELECT s.tx_id, CASE WHEN s.tx_id % 2 = 0 THEN 'TIMEOUT_RELEASE' ELSE 'DECLINE' END AS decision,
  CASE WHEN s.tx_id % 2 = 0 THEN 'REVIEW_TIMEOUT' ELSE 'REVIEW_TIMEOUT_DECLINED' END AS reason
FROM states s WHERE seq = 1 AND decision = 'HOLD' AND NOT EXISTS (SELECT 1 FROM states x WHERE x.tx_id = s.tx_id AND x.seq > 1)
  AND s."at" + {1800 * SECOND} < (SELECT max("at") FROM states) - {600 * SECOND}""",
        "states",
    ),
)
def stream_hold_timeout(spark, sf):
    """Event-time timers: a hold nobody answered is settled once the watermark passes its deadline."""
    base = scratch(spark)
    s = operations.decision_states(payments(spark, sf)).select("tx_id", "seq", "decision", "at").withColumn(
        "policy", F.when(F.col("tx_id") % 2 == 0, "RELEASE_WITH_TIMEOUT_LABEL").otherwise("DECLINE_AND_VERIFY")
    )
    s.write.parquet(f"{base}/in")
    stream = spark.readStream.schema(s.schema).parquet(f"{base}/in")
    timed = stream.withColumn("ts", F.timestamp_micros("at")).withWatermark("ts", "10 minutes")
    out = state.keyed(state.bucketed(timed, "tx_id"), "bucket", state.HoldTimeout(1800 * SECOND), state.HOLD, time="EventTime")
    flows.run_available(out, flows.append_to(f"{base}/out"), f"{base}/ckpt").awaitTermination()
    return flows.stored(spark, f"{base}/out", state.HOLD).drop("resolved_at")


@query(
    "k16_parent_wait",
    sql(
        f"""SELECT tx_id, k % 5 <> 0 AS has_parent FROM payments
WHERE k % 5 <> 0 OR t < (SELECT max(t) FROM payments) - {3600 * SECOND}""",
        "payments",
    ),
)
def parent_wait(spark, sf):
    """Children wait five minutes for their parent; those without one come out when it has run out."""
    base = scratch(spark)
    p = payments(spark, sf).select("tx_id", "t", "k")
    p.write.parquet(f"{base}/children")
    p.filter("k % 5 <> 0").write.parquet(f"{base}/parents")

    def read(name: str) -> DataFrame:
        return spark.readStream.schema(p.schema).parquet(f"{base}/{name}").withColumn("ts", F.timestamp_micros("t"))

    joined = flows.with_parent(read("children"), read("parents"), "tx_id")
    rows = joined.select("tx_id", "t", F.col("p_key").isNotNull().alias("has_parent"))
    flows.run_available(rows, flows.append_to(f"{base}/out"), f"{base}/ckpt").awaitTermination()
    out = flows.stored(spark, f"{base}/out", T.StructType.fromDDL("tx_id long, t long, has_parent boolean"))
    last = p.agg((F.max("t") - 3600 * SECOND).alias("w")).withColumn("k", F.lit(0))
    kept = out.withColumn("k", F.lit(0)).join(F.broadcast(last), "k").filter("has_parent or t < w")
    return kept.select("tx_id", "has_parent")


@query(
    "s06_packs_from_json",
    sql(
        """SELECT left(country, 2) || CAST(country_key AS VARCHAR) AS alpha2, continent, bloc AS blocs, utc_offset_hours, currency, 2 AS currency_minor_units,
  d1 || ',' || d2 || ',0' AS round_denominations FROM countries""",
        "countries",
    ),
)
def packs_from_json(spark, sf):
    """The countries as JSON packs, one object a country, read back by the packs' contract."""
    base = scratch(spark)
    rows = tables.countries(spark, sf).select(
        F.concat(F.substring("country", 1, 2), F.col("country_key").cast("string")).alias("alpha2"), "continent", "blocs", "utc_offset_hours", "currency",
        F.col("minor_units").alias("currency_minor_units"), F.col("denominations").alias("round_denominations"))
    rows.write.json(f"{base}/packs")
    out = history.load_packs(spark, f"{base}/packs", one_per_line=True)
    return out.select(
        "alpha2", "continent", F.array_join("blocs", ",").alias("blocs"), "utc_offset_hours", "currency", "currency_minor_units",
        F.array_join(F.col("round_denominations").cast("array<string>"), ",").alias("round_denominations"))


@query(
    "v01_rate_fold_and_corridor_functions",
    sql(
        """SELECT account, fold, corridor, n, fraud, round(CASE WHEN lo < 0 THEN 0 ELSE lo END, 6) AS lower, round(CASE WHEN hi > 1 THEN 1 ELSE hi END, 6) AS upper FROM (
  SELECT account, n, fraud, corridor, CAST(list_reduce(list_prepend(0, list_transform(string_split(CAST(account AS VARCHAR), ''), lambda c: ascii(c))),
      lambda a, b: CAST((CAST(a AS BIGINT) * 131 + b) % 2147483647 AS BIGINT)) % 5 AS INTEGER) AS fold,
    ((fraud / n + 3.8416::DOUBLE / (2 * n)) - 1.96::DOUBLE * sqrt(fraud / n * (1 - fraud / n) / n + 3.8416::DOUBLE / (4 * n * n))) / (1 + 3.8416::DOUBLE / n) AS lo,
    ((fraud / n + 3.8416::DOUBLE / (2 * n)) + 1.96::DOUBLE * sqrt(fraud / n * (1 - fraud / n) / n + 3.8416::DOUBLE / (4 * n * n))) / (1 + 3.8416::DOUBLE / n) AS hi
  FROM (SELECT l.account, CASE WHEN h.country = a.country THEN 'DOMESTIC' WHEN h.bloc = a.bloc THEN 'INTRA_BLOC'
      WHEN h.continent = a.continent THEN 'CROSS_BLOC_AFRICA' ELSE 'INTERCONTINENTAL' END AS corridor,
      CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (WHERE is_fraud) AS DOUBLE) AS fraud
    FROM located l JOIN countries h ON h.country = l.country JOIN countries a ON a.country = l.counterparty_country GROUP BY 1, 2))""",
        "located",
    ),
)
def rate_functions(spark, sf):
    """Fraud rates with their interval by account and corridor, in SQL text that calls the functions."""
    from tidewatch.functions.sql import register

    register(spark)
    tables.with_countries(payments(spark, sf), spark, sf).createOrReplaceTempView("tidewatch_placed")
    tables.countries(spark, sf).createOrReplaceTempView("tidewatch_countries")
    return spark.sql(
        """SELECT account, fold_of(cast(account AS STRING), 5) AS fold, corridor, n, fraud, round(wilson_lower(fraud, n), 6) AS lower, round(wilson_upper(fraud, n), 6) AS upper
FROM (SELECT account, corridor_class(h.country, h.blocs, h.continent, a.country, a.blocs, a.continent) AS corridor,
    cast(count(*) AS DOUBLE) AS n, cast(sum(cast(is_fraud AS INT)) AS DOUBLE) AS fraud
  FROM tidewatch_placed p JOIN tidewatch_countries h ON h.country = p.country JOIN tidewatch_countries a ON a.country = p.counterparty_country GROUP BY 1, 2)"""
    )


@query(
    "v01_sql_functions",
    sql(
        f"""SELECT tx_id, cell, CAST(hour(make_timestamp(t + utc_offset_hours * 3600000000)) AS INTEGER) AS hour,
  round({'12742.0176::DOUBLE'} * asin(sqrt(pow(sin(radians(0 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(0)) * pow(sin(radians(30 - lon) / 2), 2))), 6) AS km
FROM located""",
        "located",
    ),
)
def sql_functions(spark, sf):
    from tidewatch.functions.sql import register

    register(spark)
    tables.with_countries(payments(spark, sf), spark, sf).createOrReplaceTempView("tidewatch_located")
    return spark.sql(
        "SELECT tx_id, geo_cell(lat, lon) AS cell, local_hour(t, utc_offset_hours) AS hour,"
        " round(haversine_km(lat, lon, 0D, 30D), 6) AS km FROM tidewatch_located"
    )
