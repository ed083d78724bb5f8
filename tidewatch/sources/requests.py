"""Ingest requests: validation with every error listed, canonical fingerprints, replays and conflicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.functions import keys
from tidewatch.plans.registry import CHANNELS
from tidewatch.session import cut

# Fields of a request in schema order, those required, and accepted currencies.
FIELDS = (
    "transaction_id", "account_id", "counterparty_id", "amount", "currency", "channel",
    "merchant_category_code", "merchant_name", "latitude", "longitude", "device_fingerprint",
    "agent_id", "counterparty_country", "transaction_timestamp",
)
REQUIRED = (
    "transaction_id", "account_id", "counterparty_id", "amount", "currency", "channel",
    "merchant_category_code", "latitude", "longitude", "transaction_timestamp",
)
CURRENCIES = ("RWF", "KES", "TZS", "UGX", "CDF", "BIF", "SSP", "SOS", "USD", "EUR")
NUMBERS = ("latitude", "longitude")
NULLABLE = ("device_fingerprint",)
DECIMAL = r"^-?(0|[1-9][0-9]*)(\.[0-9]+)?$"
TIMESTAMP = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]{1,9})?Z$"
FUTURE_MICROS = 5 * 60 * 1_000_000
MAX_BATCH = 1000

#: A request as parsed text: every field a string, and the names it came with.
REQUEST = T.MapType(T.StringType(), T.StringType())


def parse(df: DataFrame, body: str = "body") -> DataFrame:
    """Adds ``fields``, the JSON object's members as text, and ``json``, the object itself."""
    json = F.try_parse_json(body)
    is_object = F.schema_of_variant(json).startswith("OBJECT")
    return df.withColumn("json", json).withColumn(
        "fields", F.when(is_object, F.from_json(body, REQUEST))
    )


def _type(name: str) -> Column:
    """JSON type of a member; NULL when it is absent."""
    return F.schema_of_variant(F.try_variant_get("json", f"$.{name}", "variant"))


def _field(name: str) -> Column:
    """Text of a member of the expected type, else NULL."""
    right = ~_type(name).isin("STRING", "VOID", "BOOLEAN") if name in NUMBERS else _type(name) == "STRING"
    return F.when(right, F.try_element_at(F.col("fields"), F.lit(name)))


def _error(condition: Column, field: str, code: str) -> Column:
    return F.when(condition, F.struct(F.lit(field).alias("field"), F.lit(code).alias("code")))


def errors(now_us: Column, currencies: tuple[str, ...] = CURRENCIES) -> Column:
    """All problems of a request, in field order; empty when it is valid."""
    found: list[Column] = []
    for name in REQUIRED:
        missing = ~F.array_contains(F.map_keys("fields"), name)
        found.append(_error(missing, name, "required"))

    def pattern(name: str, regex: str, code: str = "invalid_format") -> None:
        found.append(_error(_field(name).isNotNull() & ~_field(name).rlike(regex), name, code))

    for name in FIELDS:
        wrong = _type(name).isNotNull() & _field(name).isNull()
        if name in NULLABLE:
            wrong = wrong & (_type(name) != "VOID")
        found.append(_error(wrong, name, "type_mismatch"))
    pattern("transaction_id", keys.UUID)
    for name in ("account_id", "counterparty_id", "device_fingerprint", "agent_id"):
        pattern(name, keys.TOKEN, "not_a_token")
    amount = _field("amount")
    whole = F.length(F.regexp_replace(F.substring_index(amount, ".", 1), "-", ""))
    parts = F.length(F.regexp_extract(amount, r"\.([0-9]+)$", 1))
    shaped = amount.rlike(DECIMAL)
    zero = ~F.regexp_replace(amount, "[-.]", "").rlike("[1-9]")
    out_of_range = amount.startswith("-") & ~zero | (whole > 14)
    found += [
        _error(amount.isNotNull() & ~shaped, "amount", "invalid_format"),
        _error(shaped & out_of_range, "amount", "out_of_range"),
        _error(shaped & ~out_of_range & (parts > 4), "amount", "invalid_format"),
        _error(shaped & ~out_of_range & (parts <= 4) & zero, "amount", "out_of_range"),
    ]
    for name, domain in (("currency", currencies), ("channel", CHANNELS)):
        found.append(_error(_field(name).isNotNull() & ~_field(name).isin(list(domain)), name, "unsupported_value"))
    pattern("merchant_category_code", keys.MCC)
    found.append(_error(F.length(_field("merchant_name")) > 100, "merchant_name", "length_out_of_range"))
    for name, bound in (("latitude", 90), ("longitude", 180)):
        found.append(_error(F.abs(_field(name).try_cast("double")) > bound, name, "out_of_range"))
    pattern("counterparty_country", keys.COUNTRY)
    stamp = _field("transaction_timestamp")
    at = F.unix_micros(F.when(stamp.rlike(TIMESTAMP), stamp).try_cast("timestamp"))
    found += [
        _error(stamp.isNotNull() & at.isNull(), "transaction_timestamp", "invalid_format"),
        _error(at > now_us + FUTURE_MICROS, "transaction_timestamp", "timestamp_in_future"),
        _error(
            (_field("channel") == "AGENT_BANKING") & ~F.array_contains(F.map_keys("fields"), "agent_id"),
            "agent_id", "required",
        ),
    ]
    unknown = F.transform(
        F.array_sort(F.array_except(F.map_keys("fields"), F.array(*[F.lit(f) for f in FIELDS]))),
        lambda n: F.struct(n.alias("field"), F.lit("unknown_field").alias("code")),
    )
    malformed = F.array(F.struct(F.lit("").alias("field"), F.lit("malformed_json").alias("code")))
    return F.when(F.col("fields").isNull(), malformed).otherwise(
        F.concat(unknown, F.array_compact(F.array(*found)))
    )


def validate(df: DataFrame, now_us: Column, currencies: tuple[str, ...] = CURRENCIES) -> DataFrame:
    """Adds ``errors``, and ``status``: 202 valid, 400 with a malformed body or field, else 422."""
    parsed = parse(df).withColumn("errors", errors(now_us, currencies))
    bad = F.exists(
        "errors", lambda e: e["code"].isin("malformed_json", "required", "unknown_field", "not_a_token")
    )
    return parsed.withColumn(
        "status", F.when(F.size("errors") == 0, 202).when(bad, 400).otherwise(422)
    )


def fingerprint() -> Column:
    """SHA-256 over the request's canonical values: formatting of equal values does not matter."""
    amount = F.regexp_replace(
        F.regexp_replace(_field("amount").cast("decimal(18,4)").cast("string"), "0+$", ""), "\\.$", ""
    )
    at = F.unix_micros(_field("transaction_timestamp").try_cast("timestamp")).cast("string")
    canonical = {
        "transaction_id": F.lower(_field("transaction_id")), "amount": amount,
        "latitude": _field("latitude").cast("double").cast("string"),
        "longitude": _field("longitude").cast("double").cast("string"), "transaction_timestamp": at,
    }
    return F.sha2(F.to_json(F.array(*[canonical.get(f, _field(f)) for f in FIELDS])), 256)


def admissions(requests: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """Outcome of each valid request: accepted, replay (same content) or conflict (other content).

    ``requests``: tx_id, fingerprint, arrival. The first arrival of an id decides; ``seen`` holds the
    (tx_id, fingerprint) of earlier batches. An aggregate and an equi-join, however often an id
    repeats.
    """
    first = requests.groupBy("tx_id").agg(
        F.min(F.struct("arrival", "fingerprint")).alias("__first")
    )
    joined = requests.join(first, "tx_id")
    known = F.lit(None).cast("string")
    if seen is not None:
        joined = joined.join(seen.select("tx_id", F.col("fingerprint").alias("__seen")), "tx_id", "left")
        known = F.col("__seen")
    holder = F.coalesce(known, F.col("__first.fingerprint"))
    opening = known.isNull() & (F.col("arrival") == F.col("__first.arrival"))
    outcome = (
        F.when(opening, "accepted").when(F.col("fingerprint") == holder, "replay").otherwise("conflict")
    )
    return joined.withColumn("outcome", outcome).drop("__first", "__seen")


def submit_batch(items: DataFrame, now_us: Column, currencies: tuple[str, ...] = CURRENCIES) -> DataFrame:
    """Per-item outcome of bulk submissions (batch_id, item, body); a batch holds 1 to 1000 items."""
    checked = validate(items, now_us, currencies).select(
        "batch_id", "item", F.transform("errors", lambda e: F.concat_ws(":", e["field"], e["code"])).alias("errors"),
        _field("transaction_id").alias("tx_id"), fingerprint().alias("fingerprint"),
    )
    # The validation expression is large; it is evaluated once and its result read twice.
    checked = cut(checked)
    sizes = checked.groupBy("batch_id").agg((F.count("*") > MAX_BATCH).alias("too_large"))
    sized = checked.join(sizes, "batch_id")
    admitted = admissions(
        sized.filter((F.size("errors") == 0) & ~F.col("too_large")).select(
            "batch_id", "item", "tx_id", "fingerprint", F.struct("batch_id", "item").alias("arrival")
        )
    ).select("batch_id", "item", "outcome")
    outcome = F.when(F.col("too_large"), "batch_too_large").otherwise(F.coalesce("outcome", F.lit("rejected")))
    return sized.join(admitted, ["batch_id", "item"], "left").select(
        "batch_id", "item", outcome.alias("outcome"), "errors"
    )
