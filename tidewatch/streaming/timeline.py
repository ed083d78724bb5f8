"""Ordered times with running sums, kept in keyed state by time bucket.

A key's times of one bucket are one entry of a map state, and an index of (bucket, count, sums) is one
value state. A question reads the index and the one bucket that the asked instant falls into; all
earlier buckets answer by their totals, so an answer costs binary searches however many rows the key
has. Only buckets that changed are written.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from itertools import accumulate

import numpy as np


def pack(numbers) -> bytes:
    return np.asarray(numbers, dtype=np.int64).tobytes()


def unpack(data: bytes) -> list[int]:
    return np.frombuffer(bytes(data), dtype=np.int64).tolist()


class _Bucket:
    """Times in order, the columns beside them, and running sums of the summed ones, made when asked."""

    __slots__ = ("times", "columns", "sums")

    def __init__(self, flat: list[int], width: int):
        n = len(flat) // (1 + width)
        self.times = flat[:n]
        self.columns = [flat[n * (k + 1) : n * (k + 2)] for k in range(width)]
        self.sums: list[list[int]] | None = None

    def insert(self, at: int, t: int, values: list[int]) -> None:
        last = at == len(self.times)
        self.times.insert(at, t)
        for column, value in zip(self.columns, values, strict=True):
            column.insert(at, value)
        if self.sums is not None and last:
            for sums, value in zip(self.sums, values, strict=False):
                sums.append(sums[-1] + value)
        else:
            self.sums = None

    def upto(self, n: int, summed: int) -> list[int]:
        """Sums of the first n entries."""
        if self.sums is None:
            self.sums = [[0, *accumulate(c)] for c in self.columns[:summed]]
        return [s[n] for s in self.sums]


class Timeline:
    """Times of one key, with `summed` whole numbers each that are added up and `carried` ones that are not.

    ``buckets`` is a map state (bucket long -> data binary), ``index`` a value state (data binary).
    """

    def __init__(self, buckets, index, span: int, summed: int = 0, carried: int = 0):
        self.state, self.index, self.span, self.summed, self.width = buckets, index, span, summed, summed + carried
        rows = unpack(index.get()[0]) if index.exists() else []
        step = 2 + summed
        self.ids = rows[0::step]
        self.totals = [rows[k::step] for k in range(1, step)]  # the count, then each sum, by bucket
        self.before: list[list[int]] | None = None
        self.open: dict[int, _Bucket] = {}
        self.changed: set[int] = set()
        self.moved = False

    def _bucket(self, bucket: int) -> _Bucket:
        if bucket not in self.open:
            at = bisect_left(self.ids, bucket)
            known = at < len(self.ids) and self.ids[at] == bucket
            self.open[bucket] = _Bucket(unpack(self.state.getValue((bucket,))[0]) if known else [], self.width)
        return self.open[bucket]

    def _prefix(self) -> list[list[int]]:
        """Totals of all buckets before each one, and of all of them."""
        if self.before is None:
            self.before = [[0, *accumulate(t)] for t in self.totals]
        return self.before

    def _count(self, bucket: int, values: list[int], sign: int) -> None:
        at = bisect_left(self.ids, bucket)
        if at == len(self.ids) or self.ids[at] != bucket:
            self.ids.insert(at, bucket)
            for total in self.totals:
                total.insert(at, 0)
            self.before = None
        change = [sign, *(sign * v for v in values[: self.summed])]
        for total, value in zip(self.totals, change, strict=True):
            total[at] += value
        if self.before is not None and at == len(self.ids) - 1:
            for before, value in zip(self.before, change, strict=True):
                before[-1] += value
        else:
            self.before = None
        self.changed.add(bucket)

    def add(self, t: int, values: list[int] | tuple = ()) -> None:
        entries = self._bucket(t // self.span)
        entries.insert(bisect_right(entries.times, t), t, list(values))
        self._count(t // self.span, list(values), 1)

    def remove(self, t: int, values: list[int] | tuple = ()) -> None:
        """Takes out the entry of these values at t, which must be there."""
        entries = self._bucket(t // self.span)
        for at in range(bisect_left(entries.times, t), bisect_right(entries.times, t)):
            if [c[at] for c in entries.columns] == list(values):
                break
        else:
            raise KeyError(t)
        del entries.times[at]
        for column in entries.columns:
            del column[at]
        entries.sums = None
        self._count(t // self.span, list(values), -1)

    def upto(self, t: int, inclusive: bool) -> list[int]:
        """(count, sums) of the entries before t, or at t as well."""
        bucket = t // self.span
        at = bisect_left(self.ids, bucket)
        out = [total[at] for total in self._prefix()]
        if at < len(self.ids) and self.ids[at] == bucket:
            entries = self._bucket(bucket)
            n = bisect_right(entries.times, t) if inclusive else bisect_left(entries.times, t)
            out = [a + b for a, b in zip(out, [n, *entries.upto(n, self.summed)], strict=True)]
        return out

    def between(self, after: int, before: int) -> list[int]:
        """(count, sums) of the entries in the open interval (after, before)."""
        return [a - b for a, b in zip(self.upto(before, False), self.upto(after, True), strict=True)]

    def trim(self, t: int) -> list[list[int]]:
        """Forgets whole buckets that end at or before t; gives the columns beside the times that go."""
        upto = bisect_left(self.ids, t // self.span)
        gone: list[list[int]] = [[] for _ in range(self.width)]
        for bucket in self.ids[:upto]:
            if self.width > self.summed:
                for column, own in zip(gone, self._bucket(bucket).columns, strict=True):
                    column += own
            self._forget(bucket)
            self.changed.discard(bucket)
            self.open.pop(bucket, None)
        if upto:
            del self.ids[:upto]
            for total in self.totals:
                del total[:upto]
            self.before, self.moved = None, True
        return gone

    def _forget(self, bucket: int) -> None:
        if self.state.containsKey((bucket,)):
            self.state.removeKey((bucket,))

    def save(self) -> None:
        if not self.changed and not self.moved:
            return
        for bucket in self.changed:
            entries = self.open[bucket]
            if entries.times:
                self.state.updateValue((bucket,), (pack([*entries.times, *(v for c in entries.columns for v in c)]),))
            else:
                self._forget(bucket)
        kept = [k for k, n in enumerate(self.totals[0]) if n]
        rows = [v for k in kept for v in (self.ids[k], *(t[k] for t in self.totals))]
        if rows:
            self.index.update((pack(rows),))
        elif self.index.exists():
            self.index.clear()
        self.changed.clear()
        self.moved = False
