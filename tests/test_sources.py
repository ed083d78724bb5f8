"""Sources and sinks: month edges, pack conflicts, releases, replays, first writes, request errors."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import audit, quality
from tidewatch.sources import history, release, requests


def test_utc_month_reads_the_next_local_month_too(spark):
    edge = 1_706_745_600_000_000  # 2024-02-01T00:00Z
    rows = [(1, edge - 1, "2024-02"), (2, edge, "2024-02"), (3, edge - 40_000_000_000, "2024-01")]
    df = spark.createDataFrame(rows, "id int, t long, month string")
    assert sorted(r.id for r in history.scan_utc_month(df, "2024-01", "t").collect()) == [1, 3]


def test_packs_sharing_a_currency_are_refused(spark, tmp_path):
    for i, currency in enumerate(("AAA", "BBB")):
        (tmp_path / f"{i}.json").write_text(json.dumps({"alpha2": f"X{i}", "blocs": ["B"], "currency": currency}))
    assert history.load_packs(spark, str(tmp_path)).count() == 2
    (tmp_path / "2.json").write_text(json.dumps({"alpha2": "X2", "blocs": [], "currency": "AAA"}))
    with pytest.raises(Exception, match="share the currency AAA"):
        history.load_packs(spark, str(tmp_path)).collect()


def test_release_is_reconciled_and_verified(spark, tmp_path):
    out = str(tmp_path / "r")
    df = spark.range(50).withColumn("x", F.col("id") * 2)
    row = release.export_release({"t": df}, out).first()
    assert (row.source_rows, row.csv_rows, row.reconciled) == (50, 50, True)
    release.checksums(spark, out).write.parquet(str(tmp_path / "list"))
    listed = spark.read.parquet(str(tmp_path / "list"))
    assert listed.count() > 2 and release.verify(spark, out, listed).count() == 0
    (tmp_path / "r" / "csv" / "t" / "extra.csv").write_text("more")
    assert [r.state for r in release.verify(spark, out, listed).collect()] == ["added"]
    with pytest.raises(release.ReleaseError):
        release.export_release({"t": df}, out + "2", {"t": "a"}, {"t": "b"})


def test_feature_cache_misses_on_another_key(spark, tmp_path):
    calls = []

    def compute(n):
        calls.append(n)
        return spark.range(n)

    path = str(tmp_path / "c")
    for key, n in (({"a": 1}, 3), ({"a": 1}, 3), ({"a": 2}, 4)):
        assert release.feature_cache(spark, path, key, lambda n=n: compute(n)).count() == n
    assert calls == [3, 4]


def test_profiles_move_earlier_and_open_once(spark):
    schema = "account long, first_seen long, opened_at long"
    old = spark.createDataFrame([(1, 10, None), (2, 5, 1)], schema)
    new = spark.createDataFrame([(1, 7, 3), (2, 9, 1)], schema)
    assert sorted(map(tuple, release.upsert_profiles(old, new).collect())) == [(1, 7, 3), (2, 5, 1)]
    clash = spark.createDataFrame([(2, 9, 2)], schema)
    with pytest.raises(Exception, match="two opening dates"):
        release.upsert_profiles(old, clash).collect()


def test_request_errors_are_all_listed(spark):
    body = {"transaction_id": "x", "account_id": 7, "counterparty_id": "tok_" + "a" * 24, "amount": "0.00",
            "currency": "RWF", "channel": "AGENT_BANKING", "merchant_category_code": "12", "latitude": "1",
            "longitude": 200, "transaction_timestamp": "2024-01-01T00:00:00Z", "device_fingerprint": None}
    df = spark.createDataFrame([(json.dumps(body),), ("[]",)], "body string")
    rows = requests.validate(df, F.lit(0)).collect()
    told = {(e.field, e.code) for e in rows[0].errors}
    assert told == {
        ("transaction_id", "invalid_format"), ("account_id", "type_mismatch"), ("amount", "out_of_range"),
        ("merchant_category_code", "invalid_format"), ("latitude", "type_mismatch"), ("longitude", "out_of_range"),
        ("transaction_timestamp", "timestamp_in_future"), ("agent_id", "required"),
    }
    assert [e.code for e in rows[1].errors] == ["malformed_json"] and rows[1].status == 400


def _chain(n):
    rows, prev = [], audit.GENESIS
    for i in range(1, n + 1):
        content = f"c{i}"
        h = hashlib.sha256(f"{prev}|{content}".encode()).hexdigest()
        rows.append((0, i, prev, h, content))
        prev = h
    return rows


@pytest.mark.parametrize(
    "change, want",
    [
        (lambda r: r, (20, None, None)),
        (lambda r: r[:7] + r[8:], (7, 8, "missing row: sequence gap")),
        (lambda r: r[:4] + [(*r[4][:4], "x")] + r[5:], (4, 5, "row content does not match row_hash")),
        (lambda r: r[:4] + [(0, 5, "z", *r[4][3:])] + r[5:], (4, 5, "prev_hash does not match the previous row")),
    ],
)
def test_audit_chain(spark, change, want):
    df = spark.createDataFrame(change(_chain(20)), "writer int, seq long, prev_hash string, row_hash string, content string")
    r = audit.verify_chains(df, span=6).first()
    assert (r.checked, r.first_bad_seq, r.problem) == want


def test_audit_head_ahead_of_rows(spark):
    df = spark.createDataFrame(_chain(5), "writer int, seq long, prev_hash string, row_hash string, content string")
    heads = spark.createDataFrame([(0, 6)], "writer int, last_seq long")
    r = audit.verify_chains(df, heads).first()
    assert (r.first_bad_seq, r.problem) == (6, "missing row: chain head is ahead of stored rows")


def _root(leaves):
    if len(leaves) == 1:
        return hashlib.sha256(b"\0" + leaves[0]).digest()
    k = 1
    while k * 2 < len(leaves):
        k *= 2
    return hashlib.sha256(b"\x01" + _root(leaves[:k]) + _root(leaves[k:])).digest()


def test_merkle_root_equals_the_recursive_definition(spark, monkeypatch):
    monkeypatch.setattr(audit, "BLOCK", 4)
    for n in (1, 2, 5, 16, 23):
        hashes = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(n)]
        df = spark.createDataFrame([(0, i, h) for i, h in enumerate(hashes)], "day int, i long, row_hash string")
        assert audit.merkle_roots(df, n).first().root == _root([bytes.fromhex(h) for h in hashes]).hex()


def test_quality_checks_fail_on_planted_defects(spark):
    rows = [(i, i, i % 4 == 0, i + (-1 if i == 3 else 5), "V4" if i == 2 else "V1", float(i % 4 == 0)) for i in range(40)]
    df = spark.createDataFrame(rows, "tx_id long, t long, is_fraud boolean, label_at long, variant string, leak double")
    assert quality.early_labels(df).first().passed is False
    assert quality.novel_placement(df, "V4", 10).first().passed is False
    assert quality.duplicate_ids(df.unionByName(df.limit(1))).first().passed is False
    assert quality.duplicate_ids(df).first().passed is True
    assert quality.raw_column_auc(df, ["leak"]).first().passed is False
    assert quality.order_auc(df, F.col("leak")).first().passed is False


def test_fingerprint_ignores_partitioning(spark):
    df = spark.range(2000).withColumn("x", F.col("id") % 7)
    a = quality.fingerprint(df.repartition(3), ["id", "x"], ["id"]).first()
    b = quality.fingerprint(df.repartition(11), ["id", "x"], ["id"]).first()
    c = quality.fingerprint(df.withColumn("x", F.col("x") + 1), ["id", "x"], ["id"]).first()
    assert a == b and a.digest != c.digest


def test_fingerprints_of_requests_are_made_once(spark, sf):
    from tidewatch.queries import streams

    plan = streams.idempotent(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "sha2" not in plan and "variant" not in plan
