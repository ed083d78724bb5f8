"""Window operators against brute force, with exact ties and window edges, split and unsplit."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import quantiles as qt
from tidewatch.operators.asof import asof, next_event
from tidewatch.operators.hotkeys import HotKeys, Split, find_hot_keys
from tidewatch.operators.order import prefix_sums, quantiles, spread, time_index, value_index
from tidewatch.operators.running import Agg, Trailing, distinct_deltas, label_deltas, sweep, trailing

SPLITS = [None, Split("account", ("1", "3"), 37)]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    out = []
    for i in range(300):
        a, t = rng.choice([1, 1, 1, 1, 2, 3]), rng.randrange(0, 1500)
        out.append((i, a, t, float(rng.randrange(1, 40)), rng.random(), rng.random(), rng.randrange(6), t + rng.randrange(0, 400), rng.random() < 0.3))
    # On the edge of a 50-wide window, one inside it, and two at one instant.
    out += [(300 + j, 2, 5000 + d, 1.0, 0.5, 0.5, j % 2, 5050, True) for j, d in enumerate((0, 1, 49, 50, 50))]
    return out


@pytest.fixture(scope="module")
def df(spark, rows):
    schema = "tx_id long, account long, t long, amount double, lat double, lon double, m long, label_at long, y boolean"
    return spark.createDataFrame(rows, schema).persist()


@pytest.mark.parametrize("split", SPLITS)
def test_trailing_sums(df, rows, split):
    one = F.lit(1).cast("long")
    windows = {"n50": Trailing(one, 50), "n500": Trailing(one, 500), "s7": Trailing(F.col("amount"), 7)}
    got = trailing(df, ["account"], "t", windows, {"mx": Agg("max", F.col("t"))}, split).collect()
    assert len(got) == len(rows)
    for r in got:
        def inside(w):
            return [q for q in rows if q[1] == r.account and r.t - w < q[2] < r.t]
        assert (r.n50, r.n500) == (len(inside(50)), len(inside(500)))
        assert r.s7 == pytest.approx(sum(q[3] for q in inside(7)))
        assert r.mx == max((q[2] for q in rows if q[1] == r.account and q[2] < r.t), default=None)


@pytest.mark.parametrize("split", SPLITS)
def test_distinct_members_and_labels(df, rows, split):
    pairs = trailing(df, ["account", "m"], "t", {}, {"p": Agg("max", F.col("t"))}, split)
    from pyspark.sql import Window

    first = F.min("tx_id").over(Window.partitionBy("account", "m", "t")) == F.col("tx_id")
    pairs = pairs.withColumn("first", first)
    from tidewatch.operators.features import _when

    deltas = _when(distinct_deltas(F.col("t"), F.col("p"), 200, "d"), F.col("first"))
    deltas += label_deltas(F.col("t"), F.col("label_at"), 300, {"f": F.col("y").cast("long")})
    got = sweep(pairs, "account", "t", deltas, {"d": "sum", "f": "sum"}, split=split).collect()
    assert len(got) == len(rows)
    for r in got:
        members = {q[6] for q in rows if q[1] == r.account and r.t - 200 < q[2] < r.t}
        fraud = sum(q[8] for q in rows if q[1] == r.account and r.t - 300 < q[2] < r.t and q[7] < r.t)
        assert (r.d or 0, r.f or 0) == (len(members), fraud)


def test_sliding_order_statistics_both_paths(df, rows, monkeypatch):
    monkeypatch.setattr(qt, "BLOCK", 16)
    hot = HotKeys({"account": ("1", "3")}, grain=200)
    plain = {r.tx_id: r for r in qt.window_stats(df, 500).collect()}
    split = {r.tx_id: r for r in qt.window_stats(df, 500, hot).collect()}
    assert len(plain) == len(split) == len(rows)
    for i, a, t, *_ in rows:
        w = [r for r in rows if r[1] == a and t - 500 < r[2] < t]
        for got in (plain[i], split[i]):
            assert got.n == len(w)
            if w:
                m = statistics.median(r[3] for r in w)
                want = (m, statistics.median(abs(r[3] - m) for r in w), max(r[3] for r in w),
                        statistics.median(r[4] for r in w), statistics.median(r[5] for r in w))
                assert tuple(got)[2:] == pytest.approx(want)


@pytest.mark.parametrize("split", SPLITS)
def test_asof_and_next_event(spark, df, rows, split):
    versions = [(1, 100, 7, "late"), (1, 100, 3, "kept"), (1, 900, 9, "new"), (2, 5050, 1, "edge")]
    table = spark.createDataFrame(versions, "account long, since long, version long, v string")
    got = asof(df, table, "account", "t", "since", ["v"], tie=F.col("version"), split=split).collect()
    for r in got:
        seen = [v for v in versions if v[0] == r.account and v[1] <= r.t]
        want = max(seen, key=lambda v: (v[1], -v[2]))[3] if seen else None
        assert r.v == want
    marks = spark.createDataFrame([(1, 700), (2, 5050), (3, 99999)], "account long, at long")
    for r in next_event(marks, df, "account", "at", "t", "nxt", split).collect():
        assert r.nxt == min((q[2] for q in rows if q[1] == r.account and q[2] >= r.at), default=None)


def test_global_positions(spark, df, rows):
    order = [r[0] for r in sorted(rows, key=lambda r: (r[2], r[0]))]
    got = {r.tx_id: r.row_index for r in time_index(df, "t", ["tx_id"], grain=90).collect()}
    assert [got[i] for i in order] == list(range(len(rows)))
    picked = sorted(r.tx_id for r in spread(df, "t", ["tx_id"], 10, grain=90).collect())
    assert picked == sorted(order[i * len(rows) // 10] for i in range(10))
    by_value = [r[0] for r in sorted(rows, key=lambda r: (r[3], r[2], r[0]))]
    hot = Split("amount", ("1.0",), 50)
    got = {r.tx_id: r.row_index for r in value_index(df, "amount", "t", ["tx_id"], hot).collect()}
    assert [got[i] for i in by_value] == list(range(len(rows)))


def test_prefix_sums_and_quantiles(df, rows):
    hist = df.groupBy("amount").agg(F.count("*").alias("c"))
    for r in prefix_sums(hist, "amount", {"below": "c"}, buckets=7).collect():
        assert r.below == sum(1 for q in rows if q[3] < r.amount)
    for r in quantiles(df, "amount", {"m": 0.5}, ["account"]).collect():
        assert r.m == statistics.median(q[3] for q in rows if q[1] == r.account)


def test_hot_keys_are_found(df):
    hot = find_hot_keys(df, ["account", "m"], "tx_id", min_rows=150, one_in=1)
    assert hot.found == {"account": ("1",)}
    assert not find_hot_keys(df, ["account"], "tx_id")
