"""Keyed state over a stream: velocity with labels, freezes, breakers, hold timers, rate limits.

A key's rows of one micro-batch are sorted by (t, id) first, and rows of one instant are answered
before any of them is stored, so no row sees itself or a simultaneous one. Windows are timelines:
sorted times in buckets with running sums, trimmed to the longest window. With a time to live, which
needs processing time and so a stream that keeps running, the state of a quiet key expires by itself.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidewatch.streaming.timeline import Timeline

MINUTE = 60_000_000
HOUR = 60 * MINUTE
DAY = 24 * HOUR
#: How long a quiet key is kept where a processor is given a time to live.
TTL_MS = 30 * 24 * 3_600 * 1_000

_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def enable(spark) -> None:
    """Keyed state with several variables needs the RocksDB store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _PROVIDER)


def _rows(frames: Iterator[pd.DataFrame], order: list[str]) -> pd.DataFrame:
    parts = list(frames)  # one key's rows of one micro-batch
    return pd.concat(parts).sort_values(order, kind="stable") if parts else pd.DataFrame()


def _sorted(frames: Iterator[pd.DataFrame], columns: list[str]) -> list[tuple]:
    """One key's rows of one micro-batch, whose size the source's limits bound, in order of the columns."""
    return sorted(r for frame in frames for r in frame[columns].itertuples(index=False, name=None))


def _timeline(handle: StatefulProcessorHandle, name: str, ttl_ms: int | None = None) -> tuple:
    """The two states of a Timeline."""
    return (
        handle.getMapState(f"{name}_buckets", "bucket long", "data binary", ttlDurationMs=ttl_ms),
        handle.getValueState(f"{name}_index", "data binary", ttlDurationMs=ttl_ms),
    )


def _frame(rows: list[tuple], schema: T.StructType) -> Iterator[pd.DataFrame]:
    """One frame of output, or none at all when there is nothing to say."""
    if rows:
        yield pd.DataFrame(rows, columns=[f.name for f in schema.fields])


VELOCITY = T.StructType(
    [
        T.StructField("tx_id", T.LongType()),
        T.StructField("account", T.LongType()),
        T.StructField("tx_count_60s", T.LongType()),
        T.StructField("tx_count_1h", T.LongType()),
        T.StructField("tx_count_24h", T.LongType()),
        T.StructField("tx_count_7d", T.LongType()),
        T.StructField("seconds_since_last_tx", T.DoubleType()),
        T.StructField("first_seen", T.LongType()),
    ]
)
_SPANS = (MINUTE, HOUR, DAY, 7 * DAY)


class AccountVelocity(StatefulProcessor):
    """Compute, then observe, over arrival times trimmed to seven days.

    First and last sighting are durable: they come from the initial state when there is one and are
    never guessed from what the window still holds.
    """

    def __init__(self, ttl_ms: int | None = None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.times = _timeline(handle, "times", self.ttl_ms)
        self.facts = handle.getValueState("facts", "first_seen long, last_seen long")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        row = initialState.iloc[0]
        self.facts.update((int(row["first_seen"]), int(row["last_seen"])))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        found = _sorted(rows, ["t", "tx_id"])
        known = Timeline(*self.times, DAY)
        facts = self.facts.get() if self.facts.exists() else None
        first, last = (int(facts[0]), int(facts[1])) if facts else (None, None)
        out, k = [], 0
        while k < len(found):
            t, start = int(found[k][0]), k
            counts = [known.between(t - span, t)[0] for span in _SPANS]
            since = None if last is None else (t - last) / 1e6
            while k < len(found) and found[k][0] == t:
                out.append((int(found[k][1]), int(key[0]), *counts, since, t if first is None else first))
                k += 1
            first = t if first is None else min(first, t)
            last = t if last is None else max(last, t)
            for _ in range(start, k):
                known.add(t)
        known.trim(last - _SPANS[-1])
        known.save()
        self.facts.update((first, last))
        yield from _frame(out, VELOCITY)

    def close(self) -> None:
        pass


FREEZE = T.StructType(
    [T.StructField("account", T.LongType()), T.StructField("tx_id", T.LongType()), T.StructField("frozen_at", T.LongType())]
)


class AccountFreeze(StatefulProcessor):
    """Fires once at the third HIGH decision within the window, until the state is cleared."""

    def __init__(self, count: int = 3, span: int = HOUR, ttl_ms: int | None = None):
        self.count, self.span, self.ttl_ms = count, span, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.highs = _timeline(handle, "highs", self.ttl_ms)
        self.frozen = handle.getValueState("frozen", "at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        found, out, k = _sorted(rows, ["t", "tx_id"]), [], 0
        if not self.frozen.exists():
            held = Timeline(*self.highs, self.span)
            while k < len(found) and not out:
                t, tx = int(found[k][0]), int(found[k][1])
                while k < len(found) and found[k][0] == t:
                    held.add(t)
                    k += 1
                if held.between(t - self.span, t + 1)[0] >= self.count:
                    out.append((int(key[0]), tx, t))
                    self.frozen.update((t,))
            held.trim(t - self.span)
            held.save()
        yield from _frame(out, FREEZE)

    def close(self) -> None:
        pass


BREAKER = T.StructType(
    [
        T.StructField("mcc", T.StringType()),
        T.StructField("minute", T.LongType()),
        T.StructField("open", T.BooleanType()),
        T.StructField("change", T.StringType()),
    ]
)


class MccBreaker(StatefulProcessor):
    """Minute totals of a category in, breaker state out; open until a clean reset period has passed."""

    def __init__(self, threshold: float = 0.05, minutes: int = 15, minimum: int = 20, reset: int = 60):
        self.settings = (threshold, minutes, minimum, reset)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.totals = _timeline(handle, "totals")
        self.breach = handle.getValueState("breach", "last long, open boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        threshold, minutes, minimum, reset = self.settings
        found = _sorted(rows, ["minute", "n", "fraud"])
        totals = Timeline(*self.totals, minutes, 2)
        state = self.breach.get() if self.breach.exists() else None
        last, was_open = (state[0], bool(state[1])) if state else (None, False)
        out = []
        for minute, n, fraud in ((int(m), int(n), int(f)) for m, n, f in found):
            known = totals.between(minute - 1, minute + 1)
            if known[0]:  # a minute's new total takes the place of its old one
                totals.remove(minute, known[1:])
            totals.add(minute, [n, fraud])
            _, n, fraud = totals.between(minute - minutes, minute + 1)
            # In ten-thousandths, so that a rate exactly at the threshold is no breach.
            if n >= minimum and min(fraud, n) * 10_000 > round(threshold * 10_000) * n:
                last = minute
            now_open = last is not None and minute < last + reset
            change = "OPENED" if now_open and not was_open else "CLOSED" if was_open and not now_open else None
            out.append((key[0], minute, now_open, change))
            was_open = now_open
        totals.trim(int(found[-1][0]) - minutes)
        totals.save()
        if last is not None:
            self.breach.update((last, was_open))
        yield from _frame(out, BREAKER)

    def close(self) -> None:
        pass


HOLD = T.StructType(
    [
        T.StructField("tx_id", T.LongType()),
        T.StructField("decision", T.StringType()),
        T.StructField("reason", T.StringType()),
        T.StructField("resolved_at", T.LongType()),
    ]
)


#: Buckets that keys of a row or two each are put into, so that a task is not called for every one of them.
BUCKETS = 4_096


def bucketed(stream: DataFrame, key: str, buckets: int = BUCKETS) -> DataFrame:
    """Adds ``bucket``, a hash bucket of the key: the key of processors that hold many small states each.

    Rows without a key have a bucket of their own, so that no other bucket's keys are read as floats.
    """
    return stream.withColumn("bucket", F.when(F.col(key).isNull(), -1).otherwise(F.pmod(F.xxhash64(key), F.lit(buckets))))


class Deadlines:
    """One event-time timer of a bucket, at the earliest of its deadlines."""

    def __init__(self, handle: StatefulProcessorHandle):
        self.handle = handle
        self.at = handle.getValueState("next_ms", "at long")

    def set(self, earliest: int | None) -> None:
        """Moves the timer to the earliest deadline in milliseconds; None takes it away."""
        old = int(self.at.get()[0]) if self.at.exists() else None
        if old == earliest:
            return
        if old is not None:
            self.handle.deleteTimer(old)
        if earliest is None:
            self.at.clear()
        else:
            self.at.update((earliest,))
            self.handle.registerTimer(earliest)

    def over(self, timerValues, expiredTimerInfo):
        """Tells whether a deadline has passed: the one that has fired, or any before the watermark."""
        self.at.clear()
        fired, now = expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()
        return lambda due: due <= fired or due < now


class HoldTimeout(StatefulProcessor):
    """Holds with a deadline; an answer in time cancels it, else the policy answers.

    The key is a bucket of payments: its open holds, which end within the review time, are one value.
    """

    def __init__(self, review_us: int):
        self.review_us = review_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.deadlines = Deadlines(handle)
        self.holds = handle.getValueState("holds", "data binary")

    def _open(self) -> dict[int | None, tuple[int, str]]:
        return dict(json.loads(bytes(self.holds.get()[0]))) if self.holds.exists() else {}

    def _keep(self, held: dict[int | None, tuple[int, str]]) -> None:
        if held:
            self.holds.update((json.dumps(list(held.items())).encode(),))
        elif self.holds.exists():
            self.holds.clear()
        self.deadlines.set(min((due for due, _ in held.values()), default=None))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = self._open()
        opened, answered = {}, set()
        for frame in rows:
            columns = [frame[c].tolist() for c in ("tx_id", "seq", "decision", "at", "policy")]
            for tx, seq, decision, at, policy in zip(*columns, strict=True):
                tx = None if pd.isna(tx) else int(tx)
                if seq > 1:
                    answered.add(tx)
                elif seq == 1 and decision == "HOLD" and tx not in opened:
                    opened[tx] = (at, policy)
        for tx in answered:
            held.pop(tx, None)
        new = {tx: ((int(at) + self.review_us) // 1_000, str(policy)) for tx, (at, policy) in opened.items() if tx not in answered}
        self._keep(held | new)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out, held, over = [], self._open(), self.deadlines.over(timerValues, expiredTimerInfo)
        for tx, (due, policy) in held.items():
            if over(due):
                release = policy == "RELEASE_WITH_TIMEOUT_LABEL"
                out.append(
                    (tx, "TIMEOUT_RELEASE" if release else "DECLINE",
                     "REVIEW_TIMEOUT" if release else "REVIEW_TIMEOUT_DECLINED", int(due) * 1_000)
                )
        self._keep({tx: hold for tx, hold in held.items() if not over(hold[0])})
        yield from _frame(out, HOLD)

    def close(self) -> None:
        pass


LIMITED = T.StructType(
    [T.StructField("tx_id", T.LongType()), T.StructField("entity", T.LongType()), T.StructField("allowed", T.BooleanType())]
)


class TokenBucket(StatefulProcessor):
    """Which calls of an entity exceed its budget: tokens refill with time, a call takes one or none."""

    def __init__(self, rate_per_s: float, burst: float, ttl_ms: int | None = None):
        self.rate, self.burst, self.ttl_ms = rate_per_s, burst, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.bucket = handle.getValueState("bucket", "tokens double, at long", ttlDurationMs=self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = _rows(rows, ["t", "tx_id"])
        state = self.bucket.get() if self.bucket.exists() else None
        tokens, at = (float(state[0]), int(state[1])) if state else (self.burst, None)
        out = []
        for r in pdf.itertuples():
            if at is not None:
                tokens = min(self.burst, tokens + max(0, int(r.t) - at) / 1e6 * self.rate)
            at = int(r.t) if at is None else max(at, int(r.t))
            allowed = tokens >= 1.0
            tokens -= 1.0 if allowed else 0.0
            out.append((int(r.tx_id), int(key[0]), allowed))
        self.bucket.update((tokens, at))
        yield from _frame(out, LIMITED)

    def close(self) -> None:
        pass


def keyed(
    stream: DataFrame, key: str, processor: StatefulProcessor, schema: T.StructType, mode: str = "Append",
    time: str = "None", initial: DataFrame | None = None,
) -> DataFrame:
    """One keyed stage of a stream.

    Processing time never runs out of work, so a run over what is available uses no time mode and
    a processor without a time to live.
    """
    enable(stream.sparkSession)
    return stream.groupBy(key).transformWithStateInPandas(
        processor, schema, mode, time, None if initial is None else initial.groupBy(key)
    )


def read_back(spark, checkpoint: str, variable: str) -> DataFrame:
    """(key, value, ...) of one state variable, as the last batch of a stream's checkpoint left it."""
    enable(spark)
    return spark.read.format("statestore").option("path", checkpoint).option("stateVarName", variable).load()


LABELLED = T.StructType(
    [
        T.StructField("tx_id", T.LongType()),
        T.StructField("counterparty", T.LongType()),
        T.StructField("confirmed", T.LongType()),
    ]
)


class CounterpartyLabels(StatefulProcessor):
    """Confirmed fraud per counterparty from a label stream, visible from its availability on.

    Input rows are payments and labels of one key: (kind, at, t, tx_id), where ``at`` is the
    payment's time or the label's availability. A label still to come is not in the state, and one
    that came early is held back by its own availability.
    """

    def __init__(self, span: int):
        self.span = span

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.labels = _timeline(handle, "labels")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        # At one instant payments come first: a label is seen by later ones only.
        found = sorted((int(at), kind == "label", int(t), int(tx)) for at, kind, t, tx in _sorted(rows, ["at", "kind", "t", "tx_id"]))
        held, out = Timeline(*self.labels, DAY), []
        for at, is_label, t, tx in found:
            if is_label:
                held.add(t)
            else:
                out.append((tx, int(key[0]), held.between(at - self.span, at)[0]))
        held.trim(found[-1][0] - self.span)
        held.save()
        yield from _frame(out, LABELLED)

    def close(self) -> None:
        pass
