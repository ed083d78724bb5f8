"""Keyed state: timelines against plain lists, features against plain windows, expiry, restore and release."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewatch.queries import keyed
from tidewatch.streaming import history, machines, recovery
from tidewatch.streaming.timeline import Timeline, unpack


class Value:
    def __init__(self):
        self.held = None

    def exists(self):
        return self.held is not None

    def get(self):
        return self.held

    def update(self, value):
        self.held = value

    def clear(self):
        self.held = None


class Map(dict):
    def getValue(self, key):
        return self[key]

    def updateValue(self, key, value):
        self[key] = value

    def containsKey(self, key):
        return key in self

    def removeKey(self, key):
        del self[key]

    def iterator(self):
        return iter(list(self.items()))


@pytest.mark.parametrize("seed", range(6))
def test_timeline_equals_a_list(seed):
    r = random.Random(seed)
    buckets, index, plain, edge = Map(), Value(), [], 0
    for _ in range(12):
        line = Timeline(buckets, index, 10, 2, 1)
        for _ in range(40):
            t, values = edge + r.randrange(120), [r.randrange(-5, 9), r.randrange(100), r.randrange(3)]
            if plain and r.random() < 0.2:
                t, values = plain.pop(r.randrange(len(plain)))
                line.remove(t, values)
            else:
                line.add(t, values)
                plain.append((t, values))
            a, b = sorted((edge + r.randrange(-5, 130), edge + r.randrange(130)))
            inside = [v for x, v in plain if a < x < b]
            assert line.between(a, b) == [len(inside), sum(v[0] for v in inside), sum(v[1] for v in inside)] or a == b
        edge += 20
        gone = line.trim(edge)
        assert sorted(gone[2]) == sorted(v[2] for t, v in plain if t < edge // 10 * 10)
        plain = [(t, v) for t, v in plain if t >= edge // 10 * 10]
        line.save()
    assert len(buckets) == len({t // 10 for t, _ in plain})


def test_taking_out_what_is_not_there():
    line = Timeline(Map(), Value(), 10, 0, 1)
    line.add(5, [1])
    with pytest.raises(KeyError):
        line.remove(5, [2])


# ---- processors without a stream ------------------------------------------------------------------------------


class Handle:
    def __init__(self):
        self.states, self.timers = {}, set()

    def getMapState(self, name, *_):
        return self.states.setdefault(name, Map())

    def getValueState(self, name, *_):
        return self.states.setdefault(name, Value())

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.discard(at)

    def listTimers(self):
        return iter(sorted(self.timers))


class Clock:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms

    def getExpiryTimeInMs(self):
        return self.ms


def run(processor, batches, key=(7,)):
    out = []
    for batch in batches:
        frames = [batch.iloc[: len(batch) // 2], batch.iloc[len(batch) // 2 :]]
        out += [r for f in processor.handleInputRows(key, iter([f for f in frames if len(f)]), None) for r in f.itertuples(index=False, name=None)]
    return out


SPEC = history.Keyed(
    "account",
    windows={"n_9": (9, "n"), "units_30": (30, "units")},
    members={"seen": (20, "counterparty", "seen"), "others": (20, "device", "others"), "own": (30, "device", "with_own")},
    labels={"told": (50, "n"), "bad": (50, "fraud")},
    bucket=7,
)


def random_events(seed):
    r = random.Random(seed)
    rows, t = [], 0
    for tx in range(120):
        t += r.choice([0, 0, 1, 3, 12])
        rows.append(("payment", t, t, tx, 0, r.randrange(50), r.randrange(5), r.choice([None, 1, 2, 3])))
        if r.random() < 0.4:
            rows.append(("label", t + r.randrange(1, 60), t, tx, r.randrange(2), None, None, None))
    df = pd.DataFrame(rows, columns=["kind", "at", "t", "tx_id", "fraud", "units", "counterparty", "device"]).assign(account=7)
    cuts = sorted(r.sample(range(t), 4))
    parts = [df[(df["at"] > a) & (df["at"] <= b)].sample(frac=1, random_state=seed) for a, b in zip([-1, *cuts], [*cuts, 10**9], strict=True)]
    return df, [p for p in parts if len(p)]


def plain(df):
    paid, told = df[df.kind == "payment"], df[df.kind == "label"]
    out = []
    for p in paid.itertuples():
        before = paid[paid.t < p.t]

        def inside(span, rows=before, t=p.t):
            return rows[rows.t > t - span]

        known = told[(told["at"] < p.t) & (told.t > p.t - 50) & (told.t < p.t)]
        devices = set(inside(20).device.dropna())
        own = set(inside(30).device.dropna())
        none = pd.isna(p.device)
        out.append((
            p.tx_id, len(inside(9)), int(inside(30).units.sum()), inside(20).counterparty.nunique(),
            None if none else len(devices - {p.device}), None if none else len(own | {p.device}),
            len(known), int(known.fraud.sum()), paid.t.min(), None if before.empty else before.t.max(), False,
        ))
    return out


def equal(a, b):
    def same(x, y):
        return (x is None or x != x) and (y is None or y != y) or x == y

    return len(a) == len(b) and all(all(same(x, y) for x, y in zip(p, q, strict=True)) for p, q in zip(sorted(a), sorted(b), strict=True))


@pytest.mark.parametrize("seed", range(5))
def test_history_equals_plain_windows(seed):
    df, parts = random_events(seed)
    processor, handle = history.KeyHistory(SPEC), Handle()
    processor.init(handle)
    assert equal(run(processor, parts), plain(df))
    # Nothing is kept longer than a window and a bucket reach.
    newest = int(df["at"].max())
    assert all(b * 7 + 7 > newest - SPEC.reach - 7 for (b,) in handle.states["rows_buckets"])
    sightings = sum(n for v in [handle.states["fresh_device_index"]] if v.exists() for n in unpack(v.get()[0])[1::2])
    assert sightings == len(handle.states["members_device"])


def test_quiet_key_loses_windows_then_labels_and_keeps_its_facts():
    df, parts = random_events(3)
    processor, handle = history.KeyHistory(SPEC, timers=True, idle=5_000, kept=9_000), Handle()
    processor.init(handle)
    run(processor, parts)
    newest = int(df["at"].max())
    assert handle.timers == {(newest + 5_000) // 1_000}
    handle.timers.clear()
    list(processor.handleExpiredTimer((7,), Clock((newest + 5_000) // 1_000), Clock((newest + 5_000) // 1_000)))
    assert not handle.states["rows_buckets"] and not handle.states["members_device"] and not handle.states["fresh_device_index"].exists()
    assert handle.states["labels_index"].exists() and handle.timers == {(newest + 9_000) // 1_000}
    list(processor.handleExpiredTimer((7,), Clock(10**6), Clock(10**6)))
    assert not handle.states["labels_index"].exists()
    assert handle.states["facts"].get() == (df[df.kind == "payment"].t.min(), df[df.kind == "payment"].t.max())


def test_freeze_is_released_and_freezes_again():
    events = [("high", 10, 1), ("high", 20, 2), ("high", 20, 3), ("high", 30, 4), ("release", 30, 5), ("high", 35, 6), ("release", 90, 7), ("release", 95, 8), ("high", 96, 9)]
    frame = pd.DataFrame(events, columns=["kind", "at", "tx_id"])
    for parts in ([frame], [frame.iloc[:3], frame.iloc[3:6], frame.iloc[6:]], [frame.iloc[[k]] for k in (0, 1)] + [frame.iloc[2:]]):
        processor = machines.FreezeMachine(count=3, span=50)
        processor.init(Handle())
        got = run(processor, parts)
        assert [(e, t) for _, _, e, t in got] == [("FROZEN", 20), ("RELEASED", 30), ("FROZEN", 35), ("RELEASED", 90)]


def test_children_wait_no_longer_than_their_budget():
    ms = 1_000
    rows = pd.DataFrame([("child", 10 * ms, 1.0), ("child", 200 * ms, 2.0)], columns=["kind", "at", "child"])
    late = pd.DataFrame([("parent", 150 * ms, None), ("child", 900 * ms, 3.0)], columns=["kind", "at", "child"])
    processor, handle = machines.ParentWait(budget=100 * ms), Handle()
    processor.init(handle)
    assert run(processor, [rows]) == [] and handle.timers == {110, 300}
    over = [r for f in processor.handleExpiredTimer((7,), Clock(110), Clock(110)) for r in f.itertuples(index=False, name=None)]
    assert over == [(7, 1, "parent_missing", 110 * ms)]
    # The parent is within the second child's time, the first stays dead, and the third finds it there.
    assert run(processor, [late]) == [(7, 2, "matched", 150 * ms), (7, 3, "matched", 900 * ms)]


# ---- over streams ----------------------------------------------------------------------------------------------


def test_without_a_snapshot_the_answers_differ(spark, sf):
    spec = history.ACCOUNT
    with_it, without = (
        {r.tx_id: tuple(r) for r in keyed.restored_answers(spark, sf, spec, s).collect()} for s in (True, False))
    assert with_it.keys() == without.keys()
    assert sum(with_it[k] != without[k] for k in with_it) > len(with_it) // 2


def test_facts_read_touched_buckets_only(spark, tmp_path):
    schema = "k long, day long, v string"
    store = recovery.KeyedFacts(str(tmp_path / "facts"), ["k"], ["v"], spark.createDataFrame([], schema).schema, F.col("day"))
    store.write(spark.createDataFrame([(1, 1, "a"), (2, 2, "b"), (3, 2, "c")], schema), 1)
    store.write(spark.createDataFrame([(2, 2, "again"), (4, 2, "d"), (4, 2, "e")], schema), 2)
    files = store.stored(spark, ["2"], before="batch-000000002").inputFiles()
    assert files and all("/bucket=2/" in f for f in files)
    store.write(spark.createDataFrame([(2, 2, "again"), (4, 2, "d"), (4, 2, "e")], schema), 2)  # repeated
    assert sorted(map(tuple, store.stored(spark).collect())) == [(1, 1, "a"), (2, 2, "b"), (3, 2, "c"), (4, 2, "d")]
    assert store.stored(spark, ["9"]).count() == 0


def test_failing_records_are_found_and_the_rest_is_written_once(spark, tmp_path):
    rows = spark.range(500).withColumn("x", F.col("id") % 7)

    def handle(df):
        bad = F.raise_error(F.lit("bad record")).cast("long")
        return df.withColumn("x", F.when(F.col("id").isin(13, 14, 400), bad).otherwise(F.col("x")))

    write = recovery.isolating(handle, str(tmp_path / "out"))
    write(rows, 1)
    write(rows, 1)  # a repeated batch replaces itself
    good, dead = recovery.isolated(spark, str(tmp_path / "out"), rows.schema)
    assert sorted(r.id for r in good.collect()) == sorted(set(range(500)) - {13, 14, 400})
    assert sorted((r.id, r.reason) for r in dead.collect()) == [(k, "handler_failure") for k in (13, 14, 400)]
    assert all("bad record" in r.detail for r in dead.collect())
    with pytest.raises(recovery.Outage):
        recovery.isolating(handle, str(tmp_path / "down"), most=2)(rows, 1)
