"""The answers of KeyHistory for all keys of a bucket at once.

A call for each key, and a trip to the store for each member, take most of the time of KeyHistory. Here
the key of the stage is a bucket of keys, and the rows of a bucket's micro-batch are answered together:
every window is a difference of two counts of marks before an instant, found by binary search in sorted
arrays. A sighting or a label is a mark where it begins to count and a mark where it ends.

State of a bucket, all columns of whole numbers:
- ``parts``: payments, latest sightings of each kind of member and labels, by part and day;
- ``facts``: first and last sighting of each key, never removed;
- ``newest``: with timers, each key's latest event and whether its windows are gone;
- ``names``: keys that are texts, each numbered by its place.

A batch reads the windows of the buckets that it touches and writes the days that change. What is kept
and when it goes are those of KeyHistory: whole time buckets behind a key's windows, key by key.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidewatch.streaming import state
from tidewatch.streaming.history import FACTS, IDLE, KEPT, LABEL, LABELS, ROWS, Keyed
from tidewatch.streaming.state import DAY, Deadlines

_NEVER = np.iinfo(np.int64).min
#: Columns of a part beside the key, the time first.
Columns = list[np.ndarray]


def pack(columns: Columns) -> bytes:
    return np.concatenate(columns).astype(np.int64).tobytes()


def unpack(data: bytes, width: int) -> Columns:
    return list(np.frombuffer(bytes(data), dtype=np.int64).reshape(width, -1))


def _joined(parts: list[Columns], width: int) -> Columns:
    """The rows of several parts under each other."""
    return [np.concatenate([p[c] for p in parts]) if parts else np.empty(0, np.int64) for c in range(width)]


def _where(columns: Columns, kept: np.ndarray) -> Columns:
    return [c[kept] for c in columns]


class Marks:
    """Weights at times, by group: sums of those of a group before an instant."""

    def __init__(self, groups: np.ndarray, times: np.ndarray, *weights: np.ndarray):
        self.grid = np.unique(times)
        place = groups * (len(self.grid) + 1) + np.searchsorted(self.grid, times)
        order = np.argsort(place, kind="stable")
        self.place, self.order = place[order], order
        self.sums = [np.concatenate([[0], np.cumsum(w[order])]) for w in weights]

    def at(self, groups: np.ndarray, times: np.ndarray, inclusive: bool) -> tuple[np.ndarray, np.ndarray]:
        """Where each group begins, and where its marks before the times, or at them as well, end."""
        start = groups * (len(self.grid) + 1)
        rank = np.searchsorted(self.grid, times, side="right" if inclusive else "left")
        return np.searchsorted(self.place, start), np.searchsorted(self.place, start + rank)

    def before(self, groups: np.ndarray, times: np.ndarray, inclusive: bool = False) -> Columns:
        start, end = self.at(groups, times, inclusive)
        return [s[end] - s[start] for s in self.sums]


class BucketHistory(StatefulProcessor):
    def __init__(self, spec: Keyed, timers: bool = False, idle: int = IDLE, kept: int = KEPT):
        self.spec, self.timers, self.idle, self.kept = spec, timers, idle, kept

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.parts = handle.getMapState("parts", "part string, day long", "data binary")
        self.facts = handle.getValueState("facts", "data binary")
        self.newest = handle.getValueState("newest", "data binary")
        self.names = handle.getValueState("names", "data binary")
        self.deadlines = Deadlines(handle) if self.timers else None

    # ---- what is stored ----------------------------------------------------------------------------------

    def _widths(self) -> dict[str, int]:
        """Columns of each part: the key, the time, then its values."""
        return widths(self.spec)

    def _read(self) -> dict[str, dict[int, Columns]]:
        held: dict[str, dict[int, Columns]] = {part: {} for part in self._widths()}
        for (part, day), (data,) in self.parts.iterator():
            held[part][int(day)] = unpack(data, self._widths()[part])
        return held

    def _write(self, part: str, before: dict[int, Columns], rows: Columns) -> None:
        """Takes the rows as the part's new ones; days that have not changed stay as they are."""
        days = rows[1] // DAY
        order = np.lexsort((*rows[::-1], days))
        days, rows = days[order], [c[order] for c in rows]
        found, starts = np.unique(days, return_index=True)
        ends = np.append(starts[1:], len(days))[: len(found)]
        for day, start, end in zip(found.tolist(), starts, ends, strict=True):
            new = [c[start:end] for c in rows]
            old = before.get(day)
            if old is None or len(old[0]) != len(new[0]) or any(not np.array_equal(a, b) for a, b in zip(old, new, strict=True)):
                self.parts.updateValue((part, day), (pack(new),))
        for day in before.keys() - set(found.tolist()):
            self.parts.removeKey((part, day))

    @staticmethod
    def _table(value, width: int) -> Columns:
        return unpack(value.get()[0], width) if value.exists() else [np.empty(0, np.int64)] * width

    def _numbers(self, keys: np.ndarray) -> np.ndarray:
        """Keys as whole numbers: texts by their place among those that the bucket has seen."""
        if keys.dtype.kind in "iuf":
            return keys.astype(np.int64)
        found, places = np.unique(keys.astype(str), return_inverse=True)
        names = json.loads(bytes(self.names.get()[0])) if self.names.exists() else []
        number = {name: k for k, name in enumerate(names)}
        new = [name for name in found.tolist() if name not in number]
        if new:
            self.names.update((json.dumps(names + new).encode(),))
            number |= {name: len(names) + k for k, name in enumerate(new)}
        return np.array([number[name] for name in found.tolist()], dtype=np.int64)[places]

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        """Rows of a snapshot; a large bucket's come in several frames."""
        initialState = initialState.assign(**{self.spec.key: self._numbers(initialState[self.spec.key].to_numpy())})
        for part, rows in initialState.groupby("part"):
            if part == FACTS:
                self._add_facts(*(rows[c].to_numpy(np.int64) for c in (self.spec.key, "t", "last_seen")))
                continue
            before = {d: c for d, c in self._read()[part].items()}
            names = [self.spec.key, "t", *values_of(self.spec)[part]]
            new = [rows[c].fillna(0).to_numpy(np.int64) for c in names]
            self._write(part, before, _joined([*before.values(), new], len(names)))

    def _add_facts(self, keys: np.ndarray, first: np.ndarray, last: np.ndarray) -> None:
        keys, first, last = (np.concatenate([a, b]) for a, b in zip(self._table(self.facts, 3), (keys, first, last), strict=True))
        found, at = np.unique(keys, return_inverse=True)
        firsts, lasts = np.full(len(found), np.iinfo(np.int64).max), np.full(len(found), _NEVER)
        np.minimum.at(firsts, at, first)
        np.maximum.at(lasts, at, last)
        self.facts.update((pack([found, firsts, lasts]),))

    # ---- answers -----------------------------------------------------------------------------------------

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        spec = self.spec
        frames = list(rows)  # one bucket's rows of one micro-batch, whose size the source's limits bound
        batch = {c: np.concatenate([f[c].to_numpy() for f in frames]) for c in spec.input_columns()}
        told = batch.pop("kind") == LABEL
        whole = lambda c: batch[c].astype(np.int64)
        filled = lambda c: np.nan_to_num(batch[c].astype(np.float64)).astype(np.int64) if batch[c].dtype.kind in "fO" else whole(c)
        keys, group = np.unique(self._numbers(batch[spec.key]), return_inverse=True)
        at = whole("at")
        newest = np.full(len(keys), _NEVER)
        np.maximum.at(newest, group, at)
        held = self._read()
        old = {part: _joined(list(days.values()), self._widths()[part]) for part, days in held.items()}

        paid = ~told
        g, t = group[paid], at[paid]
        known = self._table(self.facts, 3)
        first, last = self._known(keys, known, g, t)
        answer = {"tx_id": whole("tx_id")[paid]}
        new = {}

        if spec.windows:
            new[ROWS] = [keys[g], t, *(filled(m)[paid] for m in spec.measures)]
            every, groups = self._with_old(keys, old[ROWS], new[ROWS])
            marks = Marks(groups, every[1], np.ones(len(groups), np.int64), *every[2:])
            for name, (span, measure) in spec.windows.items():
                at_measure = ["n", *spec.measures].index(measure)
                answer[name] = marks.before(g, t)[at_measure] - marks.before(g, t - span, inclusive=True)[at_measure]

        sighted = {kind: self._sightings(keys, old[kind], g, t, batch[kind][paid]) for kind in spec.kinds}
        for kind in spec.kinds:
            new[kind] = sighted[kind].latest
        for name, (span, kind, reading) in spec.members.items():
            answer[name] = sighted[kind].answers(span, reading)

        if spec.labels:
            new[LABELS] = [keys[group[told]], whole("t")[told], filled("fraud")[told]]
            every, groups = self._with_old(keys, old[LABELS], new[LABELS])
            # One that was there before the batch counts from its payment on, others from their availability.
            opens = np.maximum(np.concatenate([every[1][: len(groups) - told.sum()], at[told]]), every[1])
            for name, (span, measure) in spec.labels.items():
                weight = np.ones(len(groups), np.int64) if measure == "n" else every[2]
                counted = opens < every[1] + span
                begun = Marks(groups[counted], opens[counted], weight[counted]).before(g, t)[0]
                over = Marks(groups[counted], (every[1] + span)[counted], weight[counted]).before(g, t, inclusive=True)[0]
                answer[name] = begun - over

        answer["first_seen"] = first
        previous = self._previous(g, t, last)
        answer["previous"] = pd.array(np.where(previous < t, previous, 0), dtype="Int64")
        answer["previous"][(previous == _NEVER) | (previous >= t)] = pd.NA
        answer["late"] = t < last
        self._keep(keys, newest, held, old, new)
        if paid.any():
            self._add_facts(keys[g], t, t)
        if self.timers:
            self._wait(keys, newest)
        if len(t):
            yield pd.DataFrame(answer)[[f.name for f in spec.schema.fields]]

    def _with_old(self, keys: np.ndarray, old: Columns, new: Columns) -> tuple[Columns, np.ndarray]:
        """Stored rows of these keys and the batch's, and the group of each."""
        mine = np.isin(old[0], keys)
        every = [np.concatenate([a[mine], b]) for a, b in zip(old, new, strict=True)]
        return every, np.searchsorted(keys, every[0])

    @staticmethod
    def _known(keys, facts: Columns, g: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First sighting of each payment's key so far, and the last one before the batch (the least number: none)."""
        first, last = np.full(len(keys), np.iinfo(np.int64).max), np.full(len(keys), _NEVER)
        mine = np.isin(facts[0], keys)
        places = np.searchsorted(keys, facts[0][mine])
        first[places], last[places] = facts[1][mine], facts[2][mine]
        np.minimum.at(first, g, t)
        return first[g], last[g]

    @staticmethod
    def _previous(g: np.ndarray, t: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Latest payment of the key before each one, of the batch or the state."""
        marks = Marks(g, t)
        start, end = marks.at(g, t, False)
        inside = np.concatenate([t[marks.order], [_NEVER]])[end - 1]
        return np.maximum(np.where(end > start, inside, _NEVER), last)

    def _sightings(self, keys: np.ndarray, old: Columns, g: np.ndarray, t: np.ndarray, members: np.ndarray) -> Sightings:
        missing = pd.isna(members)
        own = np.where(missing, 0, members).astype(np.int64)
        mine = np.isin(old[0], keys)
        return Sightings(keys, _where(old, mine), g, t, own, missing)

    # ---- what is kept ------------------------------------------------------------------------------------

    def _keep(self, keys, newest, held, old, new) -> None:
        spec = self.spec
        spans = {part: spec.reach for part in old} | {LABELS: max([s for s, _ in spec.labels.values()], default=0)}
        for part, rows in new.items():
            others = ~np.isin(old[part][0], keys)
            # The latest sightings take the place of the old ones; payments and labels join them.
            mine = rows if part in spec.kinds else self._with_old(keys, old[part], rows)[0]
            whole_bucket = (newest[np.searchsorted(keys, mine[0])] - spans[part]) // spec.bucket
            mine = _where(mine, mine[1] // spec.bucket >= whole_bucket)
            self._write(part, held[part], _joined([_where(old[part], others), mine], len(rows)))

    # ---- expiry ------------------------------------------------------------------------------------------

    def _wait(self, keys: np.ndarray, newest: np.ndarray) -> None:
        """Keys of the batch wait anew for their windows' end."""
        known = self._table(self.newest, 3)
        mine = np.isin(known[0], keys)
        latest = newest.copy()
        places = np.searchsorted(keys, known[0][mine])
        latest[places] = np.maximum(latest[places], known[1][mine])
        self._set(_joined([_where(known, ~mine), [keys, latest, np.zeros(len(keys), np.int64)]], 3))

    def _set(self, waiting: Columns) -> None:
        if len(waiting[0]):
            self.newest.update((pack(waiting),))
        elif self.newest.exists():
            self.newest.clear()
        self.deadlines.set(int(self._due(waiting).min()) if len(waiting[0]) else None)

    def _due(self, waiting: Columns) -> np.ndarray:
        """The millisecond at which each key's windows are over, or its labels if the windows are gone."""
        return (waiting[1] + np.where(waiting[2] == 0, self.idle, self.kept)) // 1_000

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Keys that were quiet: their windows go first, their labels when they are out of reach too."""
        over = self.deadlines.over(timerValues, expiredTimerInfo)
        waiting = self._table(self.newest, 3)
        passed = lambda span: np.array([over(int(due)) for due in (waiting[1] + span) // 1_000], dtype=bool)
        quiet, forgotten = passed(self.idle), passed(max(self.idle, self.kept))
        for part, days in self._read().items():
            gone = waiting[0][forgotten if part == LABELS else quiet]
            rows = _joined(list(days.values()), self._widths()[part])
            self._write(part, days, _where(rows, ~np.isin(rows[0], gone)))
        waiting[2] = np.where(quiet, 1, waiting[2])
        self._set(_where(waiting, ~forgotten))
        yield from ()

    def close(self) -> None:
        pass


class Sightings:
    """Members of one kind, seen by payments of a batch and before it."""

    def __init__(self, keys: np.ndarray, old: Columns, g: np.ndarray, t: np.ndarray, own: np.ndarray, missing: np.ndarray):
        self.g, self.t, self.missing = g, t, missing
        groups = np.concatenate([np.searchsorted(keys, old[0]), g[~missing]])
        times, members = np.concatenate([old[1], t[~missing]]), np.concatenate([old[2], own[~missing]])
        stored = np.arange(len(groups)) < len(old[0])
        # A pair of key and member, numbered in order; in it the stored sighting, then later ones of the batch.
        order = np.lexsort((~stored, times, members, groups))
        groups, members, times, stored = groups[order], members[order], times[order], stored[order]
        changes = np.ones(len(groups), bool)
        changes[1:] = (groups[1:] != groups[:-1]) | (members[1:] != members[:-1])
        pair = np.cumsum(changes) - 1
        since = np.full(int(changes.sum()), _NEVER)
        since[pair[stored]] = times[stored]
        kept = stored | (times > since[pair] if len(pair) else stored)
        repeated = np.zeros(len(groups), bool)
        repeated[1:] = (pair[1:] == pair[:-1]) & (times[1:] == times[:-1]) & kept[:-1]
        kept &= ~repeated
        self.pair_of = np.full(len(t), -1)
        places = np.empty(len(order), np.int64)
        places[order] = pair
        self.pair_of[~missing] = places[len(old[0]) :]
        self.groups, self.pairs, self.times = groups[kept], pair[kept], times[kept]
        follows = np.zeros(len(self.pairs), bool)
        follows[:-1] = self.pairs[1:] == self.pairs[:-1]
        self.next = np.full(len(self.pairs), np.iinfo(np.int64).max)
        self.next[:-1][follows[:-1]] = self.times[1:][follows[:-1]] + 1
        self.latest = [keys[self.groups[~follows]], self.times[~follows], members[kept][~follows]]

    def answers(self, span: int, reading: str):
        """Members whose latest sighting lies in the window before each payment, read as the spec says."""
        one = np.ones(len(self.times), np.int64)
        # A sighting counts after its instant, up to the next one of the same member and as far as the window reaches.
        begun = Marks(self.groups, self.times, one).before(self.g, self.t)[0]
        over = Marks(self.groups, np.minimum(self.next, self.times + span), one).before(self.g, self.t, inclusive=True)[0]
        seen = begun - over
        if reading == "seen":
            return seen
        marks = Marks(self.pairs, self.times)
        start, end = marks.at(self.pair_of, self.t, False)
        latest = np.concatenate([self.times[marks.order], [_NEVER]])[end - 1]
        mine = ((end > start) & (latest > self.t - span)).astype(np.int64)
        out = pd.array(seen - mine if reading == "others" else seen + 1 - mine, dtype="Int64")
        out[self.missing] = pd.NA
        return out


def values_of(spec: Keyed) -> dict[str, list[str]]:
    """The parts of a bucket's state and the columns beside the key and the time."""
    return {ROWS: spec.measures, LABELS: ["fraud"]} | {kind: ["member"] for kind in spec.kinds}


def widths(spec: Keyed) -> dict[str, int]:
    return {part: 2 + len(values) for part, values in values_of(spec).items()}


# ---- stages and what they leave -------------------------------------------------------------------------------


def stage(stream: DataFrame, processor: BucketHistory, time: str = "None", initial: DataFrame | None = None) -> DataFrame:
    """One stage of a stream of history.events; ``initial`` is a history.snapshot_of."""
    key = processor.spec.key
    before = None if initial is None else state.bucketed(initial, key)
    return state.keyed(state.bucketed(stream, key), "bucket", processor, processor.spec.schema, time=time, initial=before)


def kept_facts(spark, checkpoint: str, spec: Keyed) -> DataFrame:
    """(key, first_seen, last_seen) of every key, a whole number, as the last batch left it."""
    held = state.read_back(spark, checkpoint, "facts").select("value.data")
    return _rows(held, lambda data: unpack(data, 3), [spec.key, "first_seen", "last_seen"])


def kept_keys(spark, checkpoint: str, spec: Keyed, part: str) -> DataFrame:
    """The keys, whole numbers, of which a part of the state is left."""
    held = state.read_back(spark, checkpoint, "parts").filter(F.col("user_map_key.part") == part).select("user_map_value.data")
    width = widths(spec)[part]
    return _rows(held, lambda data: [np.unique(unpack(data, width)[0])], [spec.key]).distinct()


def _rows(held: DataFrame, read, names: list[str]) -> DataFrame:
    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for data in frame["data"]:
                yield pd.DataFrame(dict(zip(names, read(data), strict=True)))

    return held.mapInPandas(rows, ", ".join(f"{n} long" for n in names))
