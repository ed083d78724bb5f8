"""Keyed feature state: what an account, counterparty, device, agent or cell did before each payment.

One processor serves every kind of key. A payment is answered before it is stored, and payments of one
instant are all answered before any of them is, so none sees itself or a simultaneous one. Labels are
rows of the same stream, at the instant they become available, and are seen by later payments only.

State of a key:
- ``rows``: payments by time bucket with running sums, for trailing counts and sums;
- ``fresh`` and ``members``: for each kind of member its latest sighting, and those sightings by time
  bucket, so that the distinct members of a window are the sightings inside it;
- ``labels``: labels that are available, by the time of their payment;
- ``facts``: first and last sighting. They are durable: no window and no expiry removes them, and they
  are never guessed from what a window still holds.

A key that was quiet for ``idle`` loses its windows by an event-time timer, after ``kept`` its labels
too. The facts stay. Windows count by event time, so an expiry never changes an answer as long as
``idle`` and ``kept`` are not shorter than the windows they free.

Rows of a key and micro-batch are put in order by time. A row older than what its key has already
answered is marked late: its counts and sums are exact as of its time, its distinct members are taken
by their latest sightings.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidewatch.streaming.state import DAY, HOUR, MINUTE
from tidewatch.streaming.timeline import Timeline

PAYMENT, LABEL = "payment", "label"
#: Parts of a snapshot beside the kinds of members.
FACTS, ROWS, LABELS = "facts", "rows", "labels"
#: First moment at which an idle key may lose its windows, and its labels.
IDLE, KEPT = 30 * DAY, 90 * DAY


@dataclass(frozen=True)
class Keyed:
    """What is kept and answered for one kind of key.

    windows: feature -> (span, measure); the measure "n" counts, others are whole-number columns.
    members: feature -> (span, member column, reading), where the reading is "seen" (distinct members
    in the window), "others" (without the row's own) or "with_own".
    labels: feature -> (span, "n" or "fraud").
    """

    key: str
    windows: dict[str, tuple[int, str]] = field(default_factory=dict)
    members: dict[str, tuple[int, str, str]] = field(default_factory=dict)
    labels: dict[str, tuple[int, str]] = field(default_factory=dict)
    bucket: int = HOUR

    @property
    def measures(self) -> list[str]:
        return sorted({m for _, m in self.windows.values() if m != "n"})

    @property
    def kinds(self) -> list[str]:
        """The member columns."""
        return sorted({m for _, m, _ in self.members.values()})

    @property
    def reach(self) -> int:
        """The longest window over payments."""
        return max([s for s, *_ in [*self.windows.values(), *self.members.values()]], default=0)

    @property
    def schema(self) -> T.StructType:
        names = [*self.windows, *self.members, *self.labels]
        longs = [T.StructField(n, T.LongType()) for n in ["tx_id", *names, "first_seen", "previous"]]
        return T.StructType([*longs, T.StructField("late", T.BooleanType())])

    def input_columns(self) -> list[str]:
        return [self.key, "kind", "at", "t", "tx_id", "fraud", *self.measures, *self.kinds]


ACCOUNT = Keyed(
    "account",
    windows={
        "tx_count_60s": (MINUTE, "n"), "tx_count_1h": (HOUR, "n"), "tx_count_24h": (DAY, "n"), "tx_count_7d": (7 * DAY, "n"),
        "tx_count_30d": (30 * DAY, "n"), "units_24h": (DAY, "units"), "units_7d": (7 * DAY, "units"),
    },
    members={"unique_counterparties_24h": (DAY, "counterparty", "seen"), "device_changes_24h": (DAY, "device", "others")},
    bucket=DAY,
)
COUNTERPARTY = Keyed(
    "counterparty",
    members={"counterparty_unique_senders_24h": (DAY, "account", "seen")},
    labels={"counterparty_confirmed_fraud_90d": (90 * DAY, "fraud")},
)
DEVICE = Keyed("device", members={"accounts_per_device_7d": (7 * DAY, "account", "with_own")}, bucket=6 * HOUR)
AGENT = Keyed(
    "agent", windows={"agent_cashout_count_1h": (HOUR, "cash")}, members={"agent_unique_customers_1h": (HOUR, "account", "with_own")},
    bucket=10 * MINUTE,
)
CELL = Keyed("cell", labels={"labelled_30d": (30 * DAY, "n"), "fraud_30d": (30 * DAY, "fraud")}, bucket=DAY)


def events(payments: DataFrame, labels: DataFrame | None, spec: Keyed) -> DataFrame:
    """One table of payments and labels in the processor's input columns, rows without the key left out.

    payments: the key, t, tx_id, and the measures and members; labels: the key, t, tx_id, label_at,
    is_fraud.
    """
    zero = F.lit(0).cast("long")
    own = {c: F.col(c).cast("long") for c in [*spec.measures, *spec.kinds]}
    paid = payments.filter(F.col(spec.key).isNotNull()).select(
        spec.key, F.lit(PAYMENT).alias("kind"), F.col("t").alias("at"), "t", "tx_id", zero.alias("fraud"), *[c.alias(n) for n, c in own.items() if n != spec.key])
    if labels is None:
        return paid
    null = F.lit(None).cast("long")
    told = labels.filter(F.col(spec.key).isNotNull() & F.col("label_at").isNotNull()).select(
        spec.key, F.lit(LABEL).alias("kind"), F.col("label_at").alias("at"), "t", "tx_id", F.col("is_fraud").cast("long").alias("fraud"),
        *[null.alias(n) for n in own if n != spec.key])
    return paid.unionByName(told)


class KeyHistory(StatefulProcessor):
    def __init__(self, spec: Keyed, timers: bool = False, idle: int = IDLE, kept: int = KEPT):
        self.spec, self.timers, self.idle, self.kept = spec, timers, idle, kept

    def init(self, handle: StatefulProcessorHandle) -> None:
        def line(name):
            return handle.getMapState(f"{name}_buckets", "bucket long", "data binary"), handle.getValueState(f"{name}_index", "data binary")

        self.handle = handle
        self.rows = line("rows")
        self.labels = line("labels")
        self.fresh = {kind: line(f"fresh_{kind}") for kind in self.spec.kinds}
        self.members = {kind: handle.getMapState(f"members_{kind}", "member long", "last long") for kind in self.spec.kinds}
        self.facts = handle.getValueState("facts", "first_seen long, last_seen long")
        self.newest = handle.getValueState("newest", "at long")

    def _lines(self) -> tuple[Timeline, Timeline, dict[str, Timeline]]:
        spec = self.spec
        fresh = {kind: Timeline(*self.fresh[kind], spec.bucket, 0, 1) for kind in spec.kinds}
        return Timeline(*self.rows, spec.bucket, len(spec.measures)), Timeline(*self.labels, spec.bucket, 1), fresh

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        """Rows of a snapshot: payments with their measures, labels, latest sightings by member, and the facts."""
        rows, labels, fresh = self._lines()
        for r in initialState.itertuples():
            if r.part == FACTS:
                self.facts.update((int(r.t), int(r.last_seen)))
            elif r.part in self.members:
                self.members[r.part].updateValue((int(r.member),), (int(r.t),))
                fresh[r.part].add(int(r.t), [int(r.member)])
            elif r.part == ROWS:
                rows.add(int(r.t), [int(getattr(r, m)) for m in self.spec.measures])
            else:
                labels.add(int(r.t), [int(r.fraud)])
        for line in (rows, labels, *fresh.values()):
            line.save()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        spec = self.spec
        columns = spec.input_columns()
        # One key's rows of one micro-batch, whose size the source's limits bound.
        found = [r for frame in rows for r in frame[columns].itertuples(index=False, name=None)]
        at, kind, t_at, tx_at, fraud = (columns.index(c) for c in ("at", "kind", "t", "tx_id", "fraud"))
        places = {c: columns.index(c) for c in [*spec.measures, *spec.kinds]}
        found.sort(key=lambda r: (r[at], r[kind] == LABEL, r[tx_at]))
        lines, labels, fresh = self._lines()
        last_of: dict[str, dict[int, int | None]] = {k: {} for k in spec.kinds}
        facts = self.facts.get() if self.facts.exists() else None
        first, last = (int(facts[0]), int(facts[1])) if facts else (None, None)
        answered, out, newest = last, [], None

        def sighting(kind_of: str, member: int) -> int | None:
            known = last_of[kind_of]
            if member not in known:
                stored = self.members[kind_of].getValue((member,)) if self.members[kind_of].containsKey((member,)) else None
                known[member] = None if stored is None else int(stored[0])
            return known[member]

        k = 0
        while k < len(found):
            row = found[k]
            newest = int(row[at]) if newest is None else max(newest, int(row[at]))
            if row[kind] == LABEL:
                labels.add(int(row[t_at]), [int(row[fraud])])
                k += 1
                continue
            t = int(row[at])
            instant = k
            while k < len(found) and found[k][at] == row[at] and found[k][kind] == PAYMENT:
                k += 1
            previous = last
            spans = {s for s, _ in spec.windows.values()}
            in_rows = {s: lines.between(t - s, t) for s in spans}
            in_labels = {s: labels.between(t - s, t) for s in {s for s, _ in spec.labels.values()}}
            in_fresh = {(s, m): fresh[m].between(t - s, t)[0] for s, m, _ in spec.members.values()}
            sums = ["n", *spec.measures]
            for r in found[instant:k]:
                answer = [int(r[tx_at])]
                answer += [in_rows[s][sums.index(m)] for s, m in spec.windows.values()]
                for s, m, reading in spec.members.values():
                    own = r[places[m]]
                    if _missing(own):
                        answer.append(None if reading != "seen" else in_fresh[s, m])
                        continue
                    seen = sighting(m, int(own))
                    mine = int(seen is not None and t - s < seen < t)
                    answer.append(in_fresh[s, m] + {"seen": 0, "others": -mine, "with_own": 1 - mine}[reading])
                answer += [in_labels[s][0 if m == "n" else 1] for s, m in spec.labels.values()]
                answer += [t if first is None else min(first, t), previous if previous is None or previous < t else None]
                out.append((*answer, answered is not None and t < answered))
            for r in found[instant:k]:
                if spec.windows:
                    lines.add(t, [int(r[places[m]]) for m in spec.measures])
                for m in spec.kinds:
                    own = r[places[m]]
                    if _missing(own):
                        continue
                    seen = sighting(m, int(own))
                    if seen is None or seen < t:
                        if seen is not None:
                            fresh[m].remove(seen, [int(own)])
                        fresh[m].add(t, [int(own)])
                        last_of[m][int(own)] = t
            first = t if first is None else min(first, t)
            last = t if last is None else max(last, t)
        self._store(lines, labels, fresh, last_of, first, last, newest)
        if out:
            yield pd.DataFrame(out, columns=[f.name for f in spec.schema.fields])

    def _store(self, lines, labels, fresh, last_of, first, last, newest) -> None:
        spec = self.spec
        # What is behind every window is forgotten, a member with its latest sighting.
        lines.trim(newest - spec.reach)
        labels.trim(newest - max([s for s, _ in spec.labels.values()], default=0))
        for kind, line in fresh.items():
            for member, t in last_of[kind].items():
                if t is not None:
                    self.members[kind].updateValue((member,), (t,))
            for member in line.trim(newest - spec.reach)[0]:
                self.members[kind].removeKey((member,))
            line.save()
        lines.save()
        labels.save()
        if last is not None:
            self.facts.update((first, last))
        if self.timers:
            for due in list(self.handle.listTimers()):
                self.handle.deleteTimer(due)
            self.newest.update((newest,))
            self.handle.registerTimer((newest + self.idle) // 1_000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """The key was quiet: its windows go first, its labels when they are out of reach too."""
        newest = int(self.newest.get()[0])
        over = (newest + self.kept) // 1_000
        for buckets, index in [self.rows, *self.fresh.values()]:
            buckets.clear()
            index.clear()
        for members in self.members.values():
            members.clear()
        if timerValues.getCurrentWatermarkInMs() > over:
            for state in self.labels:
                state.clear()
        else:
            self.handle.registerTimer(over)
        yield from ()

    def close(self) -> None:
        pass


def _missing(value) -> bool:
    return value is None or value != value


def snapshot_of(rows: DataFrame, spec: Keyed, before: int) -> DataFrame:
    """What the state of every key holds once all events before an instant are in: initial state for a processor.

    (key, part, t, last_seen, member, fraud, measures): a row for each payment and label in reach, for the
    latest sighting of each member in reach, and for each key's facts, whose t is its first sighting.
    """
    rows = rows.filter(F.col("at") < before)
    paid, told = rows.filter(F.col("kind") == PAYMENT), rows.filter(F.col("kind") == LABEL)

    def part(df: DataFrame, name: str, *values: str) -> DataFrame:
        others = [F.col(n) if n in values else F.lit(None).cast("long").alias(n) for n in ("last_seen", "member", "fraud", *spec.measures)]
        return df.select(spec.key, F.lit(name).alias("part"), "t", *others)

    reach = before - spec.reach - spec.bucket
    out = part(paid.groupBy(spec.key).agg(F.min("t").alias("t"), F.max("t").alias("last_seen")), FACTS, "last_seen")
    if spec.windows:
        out = out.unionByName(part(paid.filter(F.col("t") > reach), ROWS, *spec.measures))
    for kind in spec.kinds:
        latest = paid.filter(F.col(kind).isNotNull()).groupBy(spec.key, F.col(kind).alias("member")).agg(F.max("t").alias("t"))
        out = out.unionByName(part(latest.filter(F.col("t") > reach), kind, "member"))
    if spec.labels:
        far = before - max(s for s, _ in spec.labels.values()) - spec.bucket
        out = out.unionByName(part(told.filter(F.col("t") > far), LABELS, "fraud"))
    return out
