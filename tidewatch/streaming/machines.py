"""Keyed state machines: freezes that are released and armed again, children that wait for a parent."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidewatch.streaming.state import HOUR, MINUTE, Deadlines
from tidewatch.streaming.timeline import Timeline

HIGH, RELEASE = "high", "release"
FREEZES = T.StructType(
    [T.StructField("account", T.LongType()), T.StructField("tx_id", T.LongType()), T.StructField("event", T.StringType()), T.StructField("at", T.LongType())]
)


class FreezeMachine(StatefulProcessor):
    """HIGH decisions and releases of an account, interleaved: FROZEN and RELEASED come out.

    The account freezes when `count` HIGH decisions lie in the window ending at one of them, and not
    again until it is released. A release takes the freeze away and not the decisions: the next one
    freezes anew if the window still holds enough. At one instant decisions come before releases.
    """

    def __init__(self, count: int = 3, span: int = HOUR):
        self.count, self.span = count, span

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.buckets = handle.getMapState("highs_buckets", "bucket long", "data binary")
        self.index = handle.getValueState("highs_index", "data binary")
        self.frozen = handle.getValueState("frozen", "at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        found = sorted(
            (int(at), kind == RELEASE, int(tx)) for frame in rows for at, kind, tx in frame[["at", "kind", "tx_id"]].itertuples(index=False, name=None))
        highs, frozen, out, k = Timeline(self.buckets, self.index, self.span), self.frozen.exists(), [], 0
        while k < len(found):
            t, release, tx = found[k]
            if release:
                if frozen:
                    out.append((int(key[0]), tx, "RELEASED", t))
                frozen, k = False, k + 1
                continue
            while k < len(found) and found[k][:2] == (t, False):
                highs.add(t)
                k += 1
            if not frozen and highs.between(t - self.span, t + 1)[0] >= self.count:
                frozen = True
                out.append((int(key[0]), tx, "FROZEN", t))
        highs.trim(found[-1][0] - self.span)
        highs.save()
        if frozen:
            self.frozen.update((found[-1][0],))
        elif self.frozen.exists():
            self.frozen.clear()
        if out:
            yield pd.DataFrame(out, columns=[f.name for f in FREEZES.fields])

    def close(self) -> None:
        pass


PARENT, CHILD = "parent", "child"
MATCHED, PARENT_MISSING = "matched", "parent_missing"
WAITED = T.StructType(
    [T.StructField("parent", T.LongType()), T.StructField("child", T.LongType()), T.StructField("outcome", T.StringType()), T.StructField("at", T.LongType())]
)


def settled(parent: int | None, found: list[tuple[int, bool, int]], known: int | None, waiting: dict[int, int], budget: int) -> tuple[int | None, dict[int, int], list[tuple]]:
    """(when the parent came, children that wait and since when, outcomes) after rows (at, is a child, child) in order."""
    waiting, out = dict(waiting), []
    for at, is_child, child in found:
        if is_child:
            if known is not None and known <= at + budget:
                out.append((parent, child, MATCHED, max(at, known)))
            else:
                waiting[child] = at
        elif known is None:
            known = at
            for child, since in waiting.items():
                in_time = at <= since + budget
                out.append((parent, child, MATCHED if in_time else PARENT_MISSING, at if in_time else since + budget))
            waiting = {}
    return known, waiting, out


class ParentWait(StatefulProcessor):
    """Children wait for the parent of their key, each with a timer of its own.

    A parent may come long before its child, or up to `budget` after it; then the child leaves as
    matched. A child whose time runs out leaves as parent_missing, for the dead letters, and a parent
    that comes later does not call it back.
    """

    def __init__(self, budget: int = 5 * MINUTE):
        self.budget = budget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.parent = handle.getValueState("parent", "at long")
        self.waiting = handle.getMapState("waiting", "child long", "at long")

    def _due(self, at: int) -> int:
        """The millisecond at which a child's time is over."""
        return -(-(at + self.budget) // 1_000)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        found = sorted((int(at), kind == CHILD, int(child)) for frame in rows for at, kind, child in frame[["at", "kind", "child"]].fillna({"child": -1}).itertuples(index=False, name=None))
        before = int(self.parent.get()[0]) if self.parent.exists() else None
        old = {int(c[0]): int(s[0]) for c, s in self.waiting.iterator()}
        known, waiting, out = settled(None if key[0] is None else int(key[0]), found, before, old, self.budget)
        if known != before:
            self.parent.update((known,))
        for child in old.keys() - waiting.keys():
            self.waiting.removeKey((child,))
            self.handle.deleteTimer(self._due(old[child]))
        for child, at in waiting.items():
            if old.get(child) != at:
                self.waiting.updateValue((child,), (at,))
                self.handle.registerTimer(self._due(at))
        if out:
            yield pd.DataFrame(out, columns=[f.name for f in WAITED.fields])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        over = [(int(c[0]), int(s[0])) for c, s in self.waiting.iterator() if self._due(int(s[0])) <= now]
        for child, _ in over:
            self.waiting.removeKey((child,))
        if over:
            yield pd.DataFrame([(int(key[0]), c, PARENT_MISSING, since + self.budget) for c, since in over], columns=[f.name for f in WAITED.fields])

    def close(self) -> None:
        pass


class ParentWaits(ParentWait):
    """ParentWait for parents of a child or two each: the key is a bucket of them, `parent` a column.

    A bucket's parents and waiting children lie in slots by a hash of the parent; a batch reads the
    slots it touches. One timer a bucket stands at the earliest time that is over.
    """

    SLOTS = 16

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.deadlines = Deadlines(handle)
        self.slots = handle.getMapState("slots", "slot long", "data binary, due long")

    def _read(self, slot: int) -> tuple[dict[int, int], dict[int, dict[int, int]]]:
        """(when parents came, the children that wait for others)."""
        if not self.slots.containsKey((slot,)):
            return {}, {}
        came, waiting = json.loads(bytes(self.slots.getValue((slot,))[0]))
        return dict(came), {parent: dict(children) for parent, children in waiting}

    def _write(self, slot: int, came: dict[int, int], waiting: dict[int, dict[int, int]]) -> None:
        due = min((self._due(at) for children in waiting.values() for at in children.values()), default=None)
        data = [list(came.items()), [(parent, list(children.items())) for parent, children in waiting.items()]]
        self.slots.updateValue((slot,), (json.dumps(data).encode(), due))

    def _earliest(self) -> int | None:
        return min((int(v[1]) for v in self.slots.values() if v[1] is not None), default=None)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        found: dict[int, dict[int | None, list]] = {}
        for frame in rows:
            columns = [frame[c].tolist() for c in ("parent", "at", "kind")] + [frame["child"].fillna(-1).tolist()]
            for parent, at, kind, child in zip(*columns, strict=True):
                parent = None if pd.isna(parent) else int(parent)
                found.setdefault((parent or 0) % self.SLOTS, {}).setdefault(parent, []).append((int(at), kind == CHILD, int(child)))
        out = []
        for slot, parents in found.items():
            came, waiting = self._read(slot)
            for parent, events in parents.items():
                known, left, new = settled(parent, sorted(events), came.get(parent), waiting.pop(parent, {}), self.budget)
                if known is not None:
                    came[parent] = known
                if left:
                    waiting[parent] = left
                out += new
            self._write(slot, came, waiting)
        self.deadlines.set(self._earliest())
        if out:
            yield pd.DataFrame(out, columns=[f.name for f in WAITED.fields])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        over, out = self.deadlines.over(timerValues, expiredTimerInfo), []
        for slot in [int(k[0]) for k, v in self.slots.iterator() if v[1] is not None and over(int(v[1]))]:
            came, waiting = self._read(slot)
            for parent, children in list(waiting.items()):
                for child in [c for c, at in children.items() if over(self._due(at))]:
                    out.append((parent, child, PARENT_MISSING, children.pop(child) + self.budget))
                if not children:
                    del waiting[parent]
            self._write(slot, came, waiting)
        self.deadlines.set(self._earliest())
        if out:
            yield pd.DataFrame(out, columns=[f.name for f in WAITED.fields])
