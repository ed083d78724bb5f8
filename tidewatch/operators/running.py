"""Running aggregates per key over time, safe for keys of any size.

Everything windowed in this library comes down to one primitive: for each row, an associative
aggregate over the rows of its key that lie strictly before it. An open trailing window is a
difference of two such aggregates, a count under a label delay or a distinct count is a sum of
signed deltas, and an as-of lookup is a running maximum of (time, version).

The frames all start at UNBOUNDED PRECEDING, which Spark evaluates incrementally; a sliding frame
is re-evaluated for every row and turns quadratic on a busy key.

A hot key is split into time buckets. Each bucket gets one carry row holding the aggregate of all
earlier buckets, so the buckets are independent tasks and no key is ever sorted in one place.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.operators.hotkeys import Split

_FN = {"sum": F.sum, "max": F.max, "min": F.min}
#: Rows without a key are spread over this many groups; they join no group of their own.
_NULL_SPREAD = 4096


@dataclass(frozen=True)
class Agg:
    """``fn`` over ``expr`` for rows of the key with time <= own time - ``lag`` (1: strictly before).

    A lag other than 1 looks further back than a bucket may hold, so it is only meaningful for
    keys that are not split; ``trailing`` adds the expiry rows that split keys need.
    """

    fn: str
    expr: Column
    lag: int = 1


def running(
    rows: DataFrame,
    keys: list[str],
    at: str,
    aggs: dict[str, Agg],
    split: Split | None = None,
    nullable_key: bool = False,
    tie: list[Column] | None = None,
) -> DataFrame:
    """``rows`` plus one column per aggregate. With ``tie``, rows before in (at, tie) order count."""
    inputs = {f"__in_{n}": a.expr for n, a in aggs.items()}
    base = rows.select("*", *[e.alias(n) for n, e in inputs.items()])
    part = list(keys)
    if split is not None or nullable_key:
        bucket = split.bucket(F.col(at)) if split is not None else F.lit(0).cast("long")
        if nullable_key:
            spread = F.pmod(F.xxhash64(F.col(at)), F.lit(_NULL_SPREAD))
            bucket = F.when(F.col(keys[0]).isNull(), spread).otherwise(bucket)
        base = base.withColumn("__b", bucket)
        part.append("__b")
    if split is not None:
        base = base.withColumn("__carry", F.lit(False)).unionByName(
            _carry_rows(base, keys, at, aggs, split), allowMissingColumns=True
        )
    window = Window.partitionBy(*part)
    if tie is None:
        ordered = window.orderBy(at)
        frames = {n: ordered.rangeBetween(Window.unboundedPreceding, -a.lag) for n, a in aggs.items()}
    else:
        first = [F.col("__carry").desc()] if split is not None else []
        ordered = window.orderBy(*first, F.col(at), *tie)
        frames = {n: ordered.rowsBetween(Window.unboundedPreceding, -1) for n in aggs}
    out = base.select(
        *[F.col(c) for c in rows.columns],
        *[_FN[a.fn](F.col(f"__in_{n}")).over(frames[n]).alias(n) for n, a in aggs.items()],
        *([F.col("__carry")] if split is not None else []),
    )
    return out.filter(~F.col("__carry")).drop("__carry") if split is not None else out


def _carry_rows(
    base: DataFrame, keys: list[str], at: str, aggs: dict[str, Agg], split: Split
) -> DataFrame:
    """One row per (hot key, bucket) holding the aggregate of every earlier bucket.

    The inner window sees one row per bucket of a key: its size is the time span over the grain,
    whatever the number of rows.
    """
    names = list(aggs)
    totals = (
        base.filter(split.hot())
        .groupBy(*keys, "__b")
        .agg(*[_FN[aggs[n].fn](f"__in_{n}").alias(f"__in_{n}") for n in names])
    )
    earlier = (
        Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    )
    return totals.select(
        *keys,
        "__b",
        (F.col("__b") * F.lit(split.grain) - 1).cast(base.schema[at].dataType).alias(at),
        F.lit(True).alias("__carry"),
        *[_FN[aggs[n].fn](f"__in_{n}").over(earlier).alias(f"__in_{n}") for n in names],
    )


@dataclass(frozen=True)
class Trailing:
    """Sum of ``expr`` over the open window (t - span, t). A count is the sum of 1."""

    expr: Column
    span: int


def trailing(
    df: DataFrame,
    keys: list[str],
    at: str,
    windows: dict[str, Trailing],
    extra: dict[str, Agg] | None = None,
    split: Split | None = None,
    nullable_key: bool = False,
) -> DataFrame:
    """Open trailing sums for several spans over one shuffle, plus plain running aggregates.

    (t - W, t) is "everything before t" minus "everything at or before t - W". For an ordinary key
    both are incremental frames over the same sort, with no extra rows. For a split key the second
    term may lie in another bucket, so each of its rows also sends one expiry row to t + W - 1.
    """
    extra = extra or {}
    before = {f"__p_{n}": Agg("sum", w.expr) for n, w in windows.items()}
    gone = {f"__e_{n}": Agg("sum", w.expr, w.span) for n, w in windows.items()}
    cols = df.columns
    if split is None or not windows:
        out = running(df, keys, at, {**before, **gone, **extra}, split, nullable_key)
        return out.select(
            *cols,
            *[_difference(n, F.col(f"__e_{n}")) for n in windows],
            *extra,
        )
    names = list(windows)
    values = df.select(
        *cols,
        *[w.expr.alias(f"__v_{n}") for n, w in windows.items()],
        *[a.expr.alias(f"__x_{n}") for n, a in extra.items()],
        F.lit(True).alias("__data"),
    )
    expiry = (
        values.filter(split.hot())
        .select(
            *keys,
            F.explode(
                F.array(
                    *[
                        F.struct(
                            (F.col(at) + F.lit(windows[n].span - 1)).alias(at),
                            *[
                                (F.col(f"__v_{m}") if m == n else F.lit(None).cast(
                                    values.schema[f"__v_{m}"].dataType
                                )).alias(f"__g_{m}")
                                for m in names
                            ],
                        )
                        for n in names
                    ]
                )
            ).alias("__x"),
        )
        .select(*keys, "__x.*", F.lit(False).alias("__data"))
    )
    rows = values.unionByName(expiry, allowMissingColumns=True)
    aggs = {f"__p_{n}": Agg("sum", F.col(f"__v_{n}")) for n in names}
    aggs |= {f"__e_{n}": Agg("sum", F.col(f"__v_{n}"), windows[n].span) for n in names}
    aggs |= {f"__h_{n}": Agg("sum", F.col(f"__g_{n}")) for n in names}
    aggs |= {n: Agg(a.fn, F.col(f"__x_{n}")) for n, a in extra.items()}
    out = running(rows, keys, at, aggs, split, nullable_key).filter("__data")
    gone_of = {
        n: F.when(split.hot(), F.col(f"__h_{n}")).otherwise(F.col(f"__e_{n}")) for n in names
    }
    return out.select(*cols, *[_difference(n, gone_of[n]) for n in names], *extra)


def _difference(name: str, gone: Column) -> Column:
    return (F.coalesce(F.col(f"__p_{name}"), F.lit(0)) - F.coalesce(gone, F.lit(0))).alias(name)


@dataclass(frozen=True)
class Delta:
    """A row sent to time ``at`` carrying measures; it is seen by strictly later rows of the key."""

    at: Column
    measures: dict[str, Column]
    when: Column | None = None


def sweep(
    df: DataFrame,
    key: str,
    at: str,
    deltas: list[Delta],
    aggs: dict[str, str],
    versions: list[DataFrame] | None = None,
    split: Split | None = None,
    nullable_key: bool = False,
    tasks: int | None = None,
) -> DataFrame:
    """Every row of ``df`` plus running aggregates of the deltas that rows of its key emitted.

    Rows and their deltas are produced by one explode, so the input is read once and the result
    needs no join back. ``versions`` are further tables of (key, at, measures) to be looked up as
    of each row: reference data versions, opening dates, label streams.

    With ``tasks``, ``df`` lies in so many tasks by ``key``. The versions are laid out the same way, so the rows
    and their deltas stay where they are and only the versions move.
    """
    cols = df.columns
    versions = versions or []
    types = _measure_types(df, deltas, versions, aggs)
    row_type = df.select(F.struct(*cols).alias("r")).schema["r"].dataType
    nulls = {m: F.lit(None).cast(types[m]) for m in aggs}

    def item(when_at: Column, row: Column, measures: dict[str, Column]) -> Column:
        return F.struct(
            when_at.cast("long").alias("__at"),
            row.alias("__row"),
            *[measures.get(m, nulls[m]).cast(types[m]).alias(m) for m in aggs],
        )

    items = [item(F.col(at), F.struct(*cols), {})]
    for d in deltas:
        made = item(d.at, F.lit(None).cast(row_type), d.measures)
        condition = F.col(key).isNotNull()
        condition = condition if d.when is None else condition & d.when
        items.append(F.when(condition, made))
    rows = df.select(
        F.col(key).alias("__key"), F.explode(F.array_compact(F.array(*items))).alias("__x")
    ).select("__key", "__x.*")
    for table in versions:
        table = table.repartition(tasks, key) if tasks else table
        rows = rows.unionByName(
            table.select(
                F.col(key).alias("__key"),
                F.col("at").cast("long").alias("__at"),
                *[F.col(m).cast(types[m]) for m in table.columns if m in aggs],
            ),
            allowMissingColumns=True,
        )
    inner = None if split is None else Split("__key", split.values, split.grain)
    out = running(
        rows,
        ["__key"],
        "__at",
        {f"__o_{m}": Agg(fn, F.col(m)) for m, fn in aggs.items()},
        inner,
        nullable_key,
    )
    return out.filter(F.col("__row").isNotNull()).select(
        "__row.*", *[F.col(f"__o_{m}").alias(m) for m in aggs]
    )


def _measure_types(df, deltas, versions, aggs):
    types = {}
    for d in deltas:
        for name, expr in d.measures.items():
            types[name] = df.select(expr.alias("x")).schema["x"].dataType
    for table in versions:
        for name in table.columns:
            if name in aggs:
                types[name] = table.schema[name].dataType
    return types


def distinct_deltas(at: Column, previous: Column, span: int, measure: str) -> list[Delta]:
    """Deltas whose running sum is the exact number of distinct members seen in (t - span, t).

    A member's sighting covers (t, t + span - 1]. Where its previous sighting still covers part of
    that, only the uncovered rest is added, so a member counts once however often it appears.
    """
    start = F.greatest(at, F.coalesce(previous + F.lit(span - 1), at))
    end = at + F.lit(span - 1)
    # Simultaneous sightings share one `previous`; the caller marks the first of them.
    one = F.lit(1).cast("long")
    return [Delta(start, {measure: one}), Delta(end, {measure: -one})]


def label_deltas(
    at: Column, available: Column, span: int, measures: dict[str, Column]
) -> list[Delta]:
    """Deltas that count a label while its row is in (t - span, t) and it is available before t."""
    shown = F.greatest(at, available)
    gone = F.greatest(at + F.lit(span - 1), shown)
    return [Delta(shown, measures), Delta(gone, {m: -e for m, e in measures.items()})]
