"""Processors that hold many small keys in one bucket: one call, one timer and few states for all of them."""

import random

import pandas as pd
from test_keyed_state import Clock, Handle, run

from tidewatch.queries import QUERIES
from tidewatch.streaming import machines, state

MS = 1_000


def calls_of(monkeypatch, processor):
    """The keys with which keyed() is asked to call a processor."""
    seen, keyed = [], state.keyed
    monkeypatch.setattr(state, "keyed", lambda stream, key, p, *a, **k: seen.append((key, type(p) is processor)) or keyed(stream, key, p, *a, **k))
    return seen


def expired(processor, handle, now):
    """Fires what Spark would fire at this watermark, until nothing is due."""
    out = []
    while any(t < now for t in handle.timers):
        due = min(handle.timers)
        handle.timers.discard(due)
        for frame in processor.handleExpiredTimer((0,), Clock(now), Clock(due)):
            out += frame.itertuples(index=False, name=None)
    return out


def test_a_bucket_of_holds_has_one_timer_and_each_hold_its_own_end():
    def rows(*items):
        return pd.DataFrame(items, columns=["tx_id", "seq", "decision", "at", "policy"])

    big = 2**53 + 1
    first = rows(*[(k, 1, "HOLD", k * MS, "DECLINE_AND_VERIFY") for k in range(1, 900)], (big, 1, "HOLD", 900 * MS, "RELEASE_WITH_TIMEOUT_LABEL"),
                 (950, 1, "APPROVE", 5 * MS, "x"), (7, 2, "APPROVE", 9 * MS, "x"))
    processor, handle = state.HoldTimeout(100 * MS), Handle()
    processor.init(handle)
    assert run(processor, [first]) == [] and handle.timers == {101}
    assert run(processor, [rows((8, 2, "DECLINE", 9 * MS, "x"), (1, 2, "APPROVE", 9 * MS, "x"))]) == [] and handle.timers == {102}
    got = expired(processor, handle, 500)
    assert sorted(r[0] for r in got) == [k for k in range(2, 400) if k not in (7, 8)] and handle.timers == {500}
    assert got[0] == (2, "DECLINE", "REVIEW_TIMEOUT_DECLINED", 102 * MS)
    rest = expired(processor, handle, 10_000)
    assert rest[-1] == (big, "TIMEOUT_RELEASE", "REVIEW_TIMEOUT", 1_000 * MS) and len(rest) == 501
    assert not handle.timers and not handle.states["holds"].exists()


def test_holds_of_a_stream_are_called_by_bucket(spark, sf, monkeypatch):
    seen = calls_of(monkeypatch, state.HoldTimeout)
    QUERIES["k10_stream_hold_timeout"](spark, sf)
    assert seen and set(seen) == {("bucket", True)}


def test_a_bucket_of_parents_gives_what_a_parent_of_its_own_gives():
    r = random.Random(5)
    budget, parts = 100 * MS, []
    for step in range(4):
        events = [("child", step * 200 * MS + r.randrange(250 * MS), k, k * 10 + r.randrange(3)) for k in range(60) if r.random() < 0.6]
        events += [("parent", step * 200 * MS + r.randrange(250 * MS), k, None) for k in range(60) if r.random() < 0.3]
        parts.append(pd.DataFrame(events, columns=["kind", "at", "parent", "child"]))
    waits, shared = machines.ParentWaits(budget), Handle()
    waits.init(shared)
    alone = {k: (machines.ParentWait(budget), Handle()) for k in range(60)}
    for processor, handle in alone.values():
        processor.init(handle)
    wanted, got = [], []
    for step, part in enumerate(parts):
        got += run(waits, [part])
        assert len(shared.timers) <= 1
        for k, (processor, handle) in alone.items():
            mine = part[part.parent == k]
            if len(mine):
                wanted += [(k, *row[1:]) for row in run(processor, [mine.drop(columns="parent")])]
        got += expired(waits, shared, step * 200)
        for k, (processor, handle) in alone.items():
            wanted += [(k, *row[1:]) for row in expired(processor, handle, step * 200)]
    assert sorted(got) == sorted(wanted) and {row[2] for row in got} == {"matched", "parent_missing"}


def test_parent_waits_of_a_stream_are_called_by_bucket(spark, sf, monkeypatch):
    seen = calls_of(monkeypatch, machines.ParentWaits)
    QUERIES["k16_stream_parent_wait"](spark, sf)
    assert seen and set(seen) == {("bucket", True)}
