"""Buckets of keys: the answers of KeyHistory key by key, restore in parts, expiry, and few trips to the store."""

import random

import pandas as pd
import pytest
import test_keyed_state
from test_keyed_state import SPEC, Clock, Handle, equal, plain, random_events

from tidewatch.streaming import history
from tidewatch.streaming.keybuckets import BucketHistory, unpack


def run(processor, batches, key):
    return [tuple(None if pd.isna(v) else v for v in r) for r in test_keyed_state.run(processor, batches, key)]


def several_keys(seed, late=False):
    """Batches that hold rows of three keys, and the rows of each key."""
    batches, frames = [], {}
    for key in (7, 8, -3):
        df, parts = random_events(seed * 20 + key + 5)
        frames[key] = df.assign(account=key, tx_id=df.tx_id + 1_000 * (key + 5))
        parts = [p.assign(account=key, tx_id=p.tx_id + 1_000 * (key + 5)) for p in parts]
        if late:
            random.Random(seed).shuffle(parts)
        batches.append(parts)
    longest = max(map(len, batches))
    return [pd.concat([parts[k] for parts in batches if k < len(parts)]).sample(frac=1, random_state=seed) for k in range(longest)], frames


def by_key(batches, keys):
    """KeyHistory's answers, and its handle for each key."""
    out, handles = [], {}
    for key in keys:
        processor, handles[key] = history.KeyHistory(SPEC), Handle()
        processor.init(handles[key])
        out += run(processor, [b[b.account == key] for b in batches if (b.account == key).any()], (key,))
    return out, handles


@pytest.mark.parametrize("seed", range(5))
def test_a_bucket_answers_as_plain_windows(seed):
    batches, frames = several_keys(seed)
    processor = BucketHistory(SPEC)
    processor.init(Handle())
    assert equal(run(processor, batches, (0,)), [r for df in frames.values() for r in plain(df)])


@pytest.mark.parametrize("seed", range(8))
def test_a_bucket_answers_and_keeps_as_single_keys_also_when_late(seed):
    batches, frames = several_keys(seed, late=True)
    processor, handle = BucketHistory(SPEC), Handle()
    processor.init(handle)
    wanted, handles = by_key(batches, frames)
    assert equal(run(processor, batches, (0,)), wanted)
    kept = sum(len(unpack(data, 3)[0]) for (part, _), (data,) in handle.states["parts"].items() if part == "device")
    assert kept == sum(len(h.states["members_device"]) for h in handles.values())
    facts = dict(zip(*[c.tolist() for c in unpack(handle.states["facts"].get()[0], 3)[:2]], strict=True))
    assert facts == {key: int(df[df.kind == "payment"].t.min()) for key, df in frames.items()}


def test_keys_may_be_texts():
    batches, frames = several_keys(1)
    processor = BucketHistory(SPEC)
    processor.init(Handle())
    named = [b.assign(account=b.account.map(lambda k: f"{k}:\u00e9").astype(object)) for b in batches]
    assert equal(run(processor, named, (0,)), [r for df in frames.values() for r in plain(df)])


def test_a_batch_makes_no_trip_to_the_store_per_key_or_member():
    class Counted(Handle):
        trips = 0

    handle = Counted()
    processor = BucketHistory(history.Keyed("account", members={"seen": (10**12, "counterparty", "seen")}))
    processor.init(handle)
    for name in ("getValue", "updateValue", "containsKey", "removeKey"):
        def counted(*a, of=getattr(type(handle.states["parts"]), name), held=handle.states["parts"]):
            handle.trips += 1
            return of(held, *a)
        setattr(handle.states["parts"], name, counted)
    rows = pd.DataFrame({"account": [k % 500 for k in range(5_000)], "counterparty": range(5_000), "t": range(5_000)})
    rows = rows.assign(kind="payment", at=rows.t, tx_id=rows.t, fraud=0)
    assert len(run(processor, [rows], (0,))) == 5_000
    assert handle.trips < 10


def test_quiet_keys_of_a_bucket_lose_windows_then_labels_and_keep_their_facts():
    batches, frames = several_keys(3)
    processor, handle = BucketHistory(SPEC, timers=True, idle=5_000, kept=9_000), Handle()
    processor.init(handle)
    run(processor, batches, (0,))
    newest = {key: int(df["at"].max()) for key, df in frames.items()}

    def left(part):
        return {k for (p, _), (data,) in handle.states["parts"].items() if p == part for k in unpack(data, 3)[0].tolist()}

    def expire(ms):
        handle.timers.clear()
        list(processor.handleExpiredTimer((0,), Clock(ms), Clock(ms)))

    single = by_key(batches, frames)[1]
    assert left("device") == {k for k, h in single.items() if h.states["fresh_device_index"].exists()} != set()
    assert left("labels") == set(newest)
    assert handle.timers == {(min(newest.values()) + 5_000) // 1_000}
    expire((max(newest.values()) + 5_000) // 1_000)
    assert left("device") == left("rows") == set() and left("labels") == set(newest)
    assert handle.timers == {(min(newest.values()) + 9_000) // 1_000}
    expire(10**6)
    assert left("labels") == set() and not handle.timers
    assert set(unpack(handle.states["facts"].get()[0], 3)[0].tolist()) == set(newest)


def test_a_snapshot_in_parts_is_the_state_of_earlier_rows(spark):
    batches, frames = several_keys(2)
    cut = sorted(pd.concat(batches)["at"])[200]
    rows = pd.concat(batches)
    columns = SPEC.input_columns()
    schema = ", ".join(f"{c} {'string' if c == 'kind' else 'long'}" for c in columns)
    table = spark.createDataFrame([tuple(None if pd.isna(v) else v if isinstance(v, str) else int(v) for v in r) for r in rows[columns].itertuples(index=False, name=None)], schema)
    snapshot = history.snapshot_of(table, SPEC, int(cut)).toPandas()
    later = rows[rows["at"] >= cut]
    for make, keys in ((BucketHistory, {0: list(frames)}), (history.KeyHistory, {k: [k] for k in frames})):
        got = []
        for key, mine in keys.items():
            processor = make(SPEC)
            processor.init(Handle())
            own = snapshot[snapshot.account.isin(mine)]
            for k in range(0, len(own), 50):
                processor.handleInitialState((key,), own.iloc[k : k + 50], None)
            got += run(processor, [later[later.account.isin(mine)]], (key,))
        assert equal(got, [r for df in frames.values() for r in plain(df) if r[0] in set(later.tx_id[later.kind == "payment"])])
