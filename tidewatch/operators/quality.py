"""Data-set checks: leakage, labels, formats, distributions. Each gives rows of one shape.

A check row is (check_name, passed, value, requirement). Bands follow the null of the statistic at the
sample at hand, so a small set is not failed by noise nor a large one passed by slack.
"""

from __future__ import annotations

import hashlib
import json
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions import keys, stats
from tidewatch.operators import aggregates as ag
from tidewatch.operators import evaluate as ev
from tidewatch.operators.asof import next_event
from tidewatch.operators.models import cross_validated_auc
from tidewatch.plans.registry import AGENT_FEATURES, DEVICE_FEATURES

# Limits of the checks.
SINGLE_FEATURE_LIMIT = 0.80
ORDER_TOLERANCE = 0.03
FAMILY_ALPHA = 0.05
MIN_TOKEN_POSITIVES = 30
SHARE_TOLERANCE_PP = 0.5
NOISE_RANGE = (0.01, 0.02)
MIN_ROWS_FULL = 5_000_000
FINGERPRINT_ROWS = 1024

SCHEMA = "check_name string, passed boolean, value double, requirement string"


def _row(df: DataFrame, name: str, passed: Column, value: Column, requirement: str) -> DataFrame:
    return df.select(
        F.lit(name).alias("check_name"), F.coalesce(passed, F.lit(False)).alias("passed"),
        value.cast("double").alias("value"), F.lit(requirement).alias("requirement"),
    )


def _literal(spark: SparkSession, name: str, passed: bool, value: float, requirement: str) -> DataFrame:
    return spark.createDataFrame([(name, bool(passed), float(value), requirement)], SCHEMA)


# ---- leakage ---------------------------------------------------------------------------------------------


def raw_column_auc(rows: DataFrame, columns: list[str], label: str = "is_fraud") -> DataFrame:
    """Separation of each raw column on its own, all in one pass."""
    return ev.feature_separation(rows, columns, label).select(
        F.concat(F.lit("single-feature AUC: "), "name").alias("check_name"),
        (F.col("separation") <= SINGLE_FEATURE_LIMIT).alias("passed"),
        F.col("separation").alias("value"), F.lit(f"<= {SINGLE_FEATURE_LIMIT}").alias("requirement"),
    )


def order_auc(rows: DataFrame, order: Column) -> DataFrame:
    """Whether the file or month a row lies in gives its class away."""
    out = ev.auc(ev.histogram(rows.select("is_fraud", order.cast("double").alias("score"))))
    value = ev.separation(F.col("auc"))
    return _row(out, "file order", value <= 0.5 + ORDER_TOLERANCE, value, f"<= {0.5 + ORDER_TOLERANCE}")


def _band(rows: DataFrame, z: float) -> tuple[int, int, float]:
    y = F.col("is_fraud").cast("long")
    n = rows.agg(F.sum(y).alias("p"), F.sum(1 - y).alias("n")).first()
    p, q = n["p"] or 0, n["n"] or 0
    if not p or not q:
        return p, q, 0.0
    return p, q, z * stats.CV_NULL_INFLATION * math.sqrt((p + q + 1) / (12.0 * p * q))


def _detector(rows: DataFrame, columns: list[str], group: str, name: str, z: float) -> DataFrame:
    spark = rows.sparkSession
    p, q, band = _band(rows, z)
    if not p or not q:
        return _literal(spark, name, True, 0.5, "one class only: nothing to detect")
    value = cross_validated_auc(rows, columns, group)
    return _literal(spark, name, abs(value - 0.5) <= band, value, f"within {band:.4f} of 0.5")


def shortcut_columns(rows: DataFrame, uuid: Column) -> tuple[DataFrame, list[str]]:
    """Columns that construction alone determines: id bytes, sub-second part, label delay."""
    bytes_ = keys.uuid_bytes(uuid)
    named = {f"id_byte_{i:02d}": bytes_[i] for i in range(16)}
    named["sub_second"] = F.col("t") % 1_000_000
    named["label_delay"] = F.col("label_at") - F.col("t")
    return rows.withColumns(named), list(named)


def shortcut_detector(rows: DataFrame, columns: list[str]) -> DataFrame:
    """A depth-3 tree over non-behavioural columns, folds by account, against its null band."""
    z = stats.normal_quantile(1 - FAMILY_ALPHA / 2)
    return _detector(rows, columns, "account", "shortcut detector", z)


def event_construction(events: DataFrame, payments: DataFrame) -> DataFrame:
    """Whether an account event's timestamp gives away accounts that carry fraud.

    Gated on the sub-second part and day of month; how soon a payment follows is signal, so its
    AUC is reported and never judged.
    """
    victims = payments.groupBy("account").agg(F.bool_or("is_fraud").alias("is_fraud"))
    marked = events.join(victims, "account", "left").withColumn(
        "is_fraud", F.coalesce("is_fraud", F.lit(False))
    )
    built = marked.withColumn("sub_second", F.col("at") % 1_000_000).withColumn(
        "day", F.dayofmonth(F.timestamp_micros("at"))
    )
    z = stats.normal_quantile(1 - FAMILY_ALPHA / 2)
    gate = _detector(built, ["sub_second", "day"], "account", "event construction", z)
    followed = next_event(marked.distinct(), payments, "account", "at", "t", "next_t").filter("next_t is not null")
    same_month = F.date_trunc("month", F.timestamp_micros("at")) == F.date_trunc("month", F.timestamp_micros("next_t"))
    delay = followed.filter(same_month).withColumn("score", (F.col("next_t") - F.col("at")) / F.lit(1e6))
    out = ev.auc(ev.histogram(delay))
    report = _row(out, "event delay (reported)", F.lit(True), ev.separation(F.col("auc")), "reported, never gated")
    return gate.unionByName(report)


def identifier_construction(rows: DataFrame, columns: list[str], full: bool = False) -> DataFrame:
    """Whether the characters of tokens give away the ones that carry fraud, per token column."""
    spark = rows.sparkSession
    z = stats.normal_quantile(1 - FAMILY_ALPHA / (2 * len(columns)))
    out = None
    for column in columns:
        tokens = ag.ever_fraud(rows, [column]).select(
            F.col("value").alias("token"), F.col("fraud").alias("is_fraud")
        )
        p, _, _ = _band(tokens, z)
        name = f"identifier construction: {column}"
        if p < MIN_TOKEN_POSITIVES:
            part = _literal(spark, name, not full, p, f"needs {MIN_TOKEN_POSITIVES} fraud tokens to judge")
        else:
            codes = keys.token_codes(F.col("token"))
            width = tokens.agg(F.max(F.size(codes))).first()[0]
            named = {f"c{i:02d}": F.coalesce(F.try_element_at(codes, F.lit(i + 1)), F.lit(0)) for i in range(width)}
            part = _detector(tokens.withColumns(named), list(named), "token", name, z)
        out = part if out is None else out.unionByName(part)
    return out


# ---- labels, ids, formats ------------------------------------------------------------------------------------


def label_noise(rows: DataFrame) -> DataFrame:
    """Missed and false labels, each as a share of truly fraudulent rows."""
    true, seen = F.col("is_fraud_true"), F.col("is_fraud_observed")
    sums = rows.agg(
        F.sum(true.cast("long")).alias("t"),
        F.sum((true & ~seen).cast("long")).alias("missed"),
        F.sum((~true & seen).cast("long")).alias("false"),
    )
    low, high = NOISE_RANGE
    parts = []
    for kind in ("missed", "false"):
        rate = F.col(kind) / F.greatest(F.col("t"), F.lit(1))
        parts.append(_row(sums, f"label noise: {kind}", rate.between(low, high), rate, f"{low} to {high}"))
    return parts[0].unionByName(parts[1])


def novel_placement(rows: DataFrame, variant: str, test_start: int) -> DataFrame:
    early = rows.filter((F.col("variant") == variant) & (F.col("t") < test_start)).agg(F.count("*").alias("n"))
    return _row(early, "novel variant placement", F.col("n") == 0, F.col("n"), "none before the test start")


def duplicate_ids(rows: DataFrame, key: str = "tx_id") -> DataFrame:
    extra = rows.groupBy(key).count().agg(F.sum(F.col("count") - 1).alias("n"))
    return _row(extra, "identifier uniqueness", F.col("n") == 0, F.col("n"), "no duplicates")


def early_labels(rows: DataFrame) -> DataFrame:
    n = rows.agg(F.coalesce(F.sum((F.col("label_at") < F.col("t")).cast("long")), F.lit(0)).alias("n"))
    return _row(n, "label before its payment", F.col("n") == 0, F.col("n"), "none")


def value_formats(rows: DataFrame, tokens: list[str], minor_units: int = 2) -> DataFrame:
    """Violations per kind of format, counted in one pass."""
    scale = F.col("amount") * F.lit(10**minor_units)
    bad = {
        "token_format": ~F.forall(F.array(*[F.col(c) for c in tokens]), lambda v: v.rlike(keys.TOKEN)),
        "mcc_format": ~F.col("mcc").rlike(keys.MCC),
        "amount_scale": scale != F.floor(scale),
        "coordinate_precision": (F.round("lat", 6) != F.col("lat")) | (F.round("lon", 6) != F.col("lon")),
    }
    counts = rows.agg(*[F.sum(F.coalesce(c, F.lit(True)).cast("long")).alias(n) for n, c in bad.items()])
    pairs = F.explode(F.array(*[F.struct(F.lit(f"value formats: {n}").alias("c"), F.col(n).alias("n")) for n in bad]))
    return counts.select(pairs.alias("p")).select(
        F.col("p.c").alias("check_name"), (F.col("p.n") == 0).alias("passed"),
        F.col("p.n").cast("double").alias("value"), F.lit("no violations").alias("requirement"),
    )


def null_signature_check(rows: DataFrame, columns: list[str]) -> DataFrame:
    n = ag.unmatched_signatures(rows, columns).agg(F.count("*").alias("n"))
    return _row(n, "null signatures per channel", F.col("n") == 0, F.col("n"), "every fraud pattern also legitimate")


# ---- distributions and features ----------------------------------------------------------------------------------


def fraud_rate(rows: DataFrame, target: float) -> DataFrame:
    rate = rows.agg(F.avg(F.col("is_fraud").cast("double")).alias("r"))
    off = F.abs(F.col("r") - target) * 100
    return _row(rate, "fraud rate", off <= SHARE_TOLERANCE_PP, F.col("r"), f"{target} +/- {SHARE_TOLERANCE_PP} pp")


def mix(rows: DataFrame, column: str, targets: dict[str, float]) -> DataFrame:
    worst = ag.share_deviation(rows, column, targets).agg(F.max("deviation_pp").alias("w"))
    return _row(worst, f"{column} mix", F.col("w") <= SHARE_TOLERANCE_PP, F.col("w"), f"within {SHARE_TOLERANCE_PP} pp")


def size(rows: DataFrame, minimum: int = MIN_ROWS_FULL) -> DataFrame:
    n = rows.agg(F.count("*").alias("n"))
    return _row(n, "size", F.col("n") >= minimum, F.col("n"), f">= {minimum}")


def computability(matrix: DataFrame, declared: dict[str, str]) -> DataFrame:
    """Declared against observed state of each feature: absent, constant or varying.

    An empty sample is an error: it would call every feature absent.
    """
    seen = ag.missingness(matrix, list(declared))
    state = F.when(F.col("distinct") == 0, "absent").when(F.col("distinct") == 1, "constant").otherwise("varying")
    spark = matrix.sparkSession
    wanted = spark.createDataFrame(sorted(declared.items()), "name string, declared string")
    out = F.broadcast(wanted).join(seen, "name", "left").select(
        "name", "declared",
        F.when(F.col("distinct").isNull(), F.raise_error(F.lit("no rows to judge features on")))
        .otherwise(state).alias("observed"), "missing_rate",
    )
    return out.withColumn("agrees", F.col("declared") == F.col("observed"))


def missing_together(matrix: DataFrame) -> DataFrame:
    """Rows on which the device or agent features are neither all missing nor all present."""
    parts = []
    for name, group in (("device", DEVICE_FEATURES), ("agent", AGENT_FEATURES)):
        cols = [c for c in group if c in matrix.columns]
        nulls = sum((F.col(c).isNull().cast("int") for c in cols), F.lit(0))
        n = matrix.agg(F.sum(((nulls > 0) & (nulls < len(cols))).cast("long")).alias("n"))
        parts.append(_row(n, f"{name} features missing together", F.col("n") == 0, F.col("n"), "all or none"))
    return parts[0].unionByName(parts[1])


# ---- fingerprints, parity -------------------------------------------------------------------------------------------


def fingerprint(df: DataFrame, columns: list[str], order: list[str], n: int = FINGERPRINT_ROWS) -> DataFrame:
    """Row count and a digest over the first ``n`` rows in canonical order.

    Independent of partitioning: the top rows are merged from every partition's own top, and only
    those are gathered.
    """
    k = F.lit(0).alias("__k")
    top = df.select(*order, F.to_json(F.array(*[F.col(c).cast("string") for c in columns])).alias("__row"))
    top = top.orderBy(*order, "__row").limit(n)
    packed = top.agg(F.sort_array(F.collect_list(F.struct(*order, "__row"))).alias("r"))
    joined = F.array_join(F.transform("r", lambda r: r["__row"]), "\n")
    digest = packed.select(F.sha2(joined, 256).alias("digest"), k)
    return df.agg(F.count("*").alias("rows")).select("*", k).join(digest, "__k").drop("__k")


def digest_of(parameters: dict) -> str:
    """Digest of the checks' own settings, so a report of other settings is refused."""
    return hashlib.sha256(json.dumps(parameters, sort_keys=True).encode()).hexdigest()


def parity(first: DataFrame, second: DataFrame, key: str, exact: list[str], real: list[str]) -> DataFrame:
    """Rows on which two computations of the same features differ.

    Counts, flags and missing positions must agree exactly, reals within 1e-12 absolute plus
    relative. A row on one side only is a difference.
    """
    a = first.select(key, *[F.col(c).alias(f"a_{c}") for c in (*exact, *real)], F.lit(1).alias("__a"))
    b = second.select(key, *[F.col(c).alias(f"b_{c}") for c in (*exact, *real)], F.lit(1).alias("__b"))
    joined = a.join(b, key, "full_outer")
    differs = {c: ~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}")) for c in exact}
    for c in real:
        x, y = F.col(f"a_{c}"), F.col(f"b_{c}")
        differs[c] = (x.isNull() != y.isNull()) | F.coalesce(
            F.abs(x - y) > F.lit(1e-12) + F.lit(1e-12) * F.abs(x), F.lit(False)
        )
    found = F.array_compact(F.array(*[F.when(d, F.lit(c)) for c, d in differs.items()]))
    return joined.select(key, found.alias("differs"), F.col("__a").isNull().alias("only_second"), F.col("__b").isNull().alias("only_first")).filter(
        (F.size("differs") > 0) | F.col("only_second") | F.col("only_first")
    )
