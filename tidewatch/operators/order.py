"""Global order without a global sort in one task: row numbers, prefix sums, even samples.

An unpartitioned window puts every row in one task. Here the order is cut into buckets, each
bucket is summed or numbered on its own, and what lies before it is added from a short table with
one row per bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.operators.hotkeys import HOUR, Split
from tidewatch.operators.running import Agg, running
from tidewatch.session import stored

#: Buckets per group of a prefix sum: enough tasks for a large group, a short table of totals.
BUCKETS = 256


def time_index(df: DataFrame, at: str, tie: list[str], grain: int = HOUR) -> DataFrame:
    """Zero-based position of every row in (at, tie) order, as ``row_index``."""
    split = Split("__all", ("0",), grain)
    rows = df.withColumn("__all", F.lit(0))
    out = running(
        rows, ["__all"], at, {"row_index": Agg("sum", F.lit(1).cast("long"))}, split,
        tie=[F.col(c) for c in tie],
    )
    return out.withColumn("row_index", F.coalesce(F.col("row_index"), F.lit(0))).drop("__all")


def global_running(
    df: DataFrame, at: str, tie: list[str], sums: dict[str, Column], grain: int = HOUR
) -> DataFrame:
    """Sums over all rows earlier in (at, tie) order."""
    split = Split("__all", ("0",), grain)
    out = running(
        df.withColumn("__all", F.lit(0)), ["__all"], at,
        {n: Agg("sum", e) for n, e in sums.items()}, split, tie=[F.col(c) for c in tie],
    )
    return out.drop("__all")


def spread(df: DataFrame, at: str, tie: list[str], n: int, grain: int = HOUR) -> DataFrame:
    """``n`` rows at an even stride through time order: positions floor(i * N / n)."""
    indexed = time_index(df, at, tie, grain)
    total = df.groupBy().agg(F.count("*").alias("__n")).withColumn("__k", F.lit(0))
    rows = indexed.withColumn("__k", F.lit(0)).join(F.broadcast(total), "__k")  # one row
    # Position r is chosen when some i has floor(i * N / n) = r: the first i at or past r * n / N.
    i = F.expr(f"(row_index * {n} + __n - 1) div __n")
    chosen = (F.col("__n") <= n) | ((i < n) & (F.expr(f"({_i(n)} * __n) div {n}") == F.col("row_index")))
    return rows.filter(chosen).drop("__k", "__n", "row_index")


def _i(n: int) -> str:
    return f"((row_index * {n} + __n - 1) div __n)"


def prefix_sums(
    df: DataFrame,
    order: str,
    sums: dict[str, str],
    group: list[str] | None = None,
    descending: bool = False,
    buckets: int = BUCKETS,
    few_groups: bool = False,
) -> DataFrame:
    """For each row, the sum of each column over rows of its group with a strictly smaller ``order``
    (larger when descending). ``order`` is unique in its group: pass a histogram.

    Buckets are cut at approximate quantiles of the group, which only balances the work. The cuts
    and bucket totals are broadcast where their number is fixed: for one group, or for ``few_groups``
    named by the caller's own list. Joining them by shuffle would gather a large group in one task.
    """
    group = group or []
    small = F.broadcast if few_groups or not group else (lambda d: d)
    keyed = df if group else df.withColumn("__g", F.lit(0))
    keys = group or ["__g"]
    cuts = keyed.groupBy(*keys).agg(
        F.percentile_approx(order, [i / buckets for i in range(1, buckets)], 10 * buckets).alias("__cuts")
    )
    rows = keyed.join(small(cuts), keys).withColumn(
        "__b", F.size(F.filter("__cuts", lambda c: c < F.col(order)))
    ).drop("__cuts")
    sign = "__b" if not descending else "__nb"
    if descending:
        rows = rows.withColumn("__nb", -F.col("__b"))
    totals = rows.groupBy(*keys, sign).agg(*[F.sum(c).alias(f"__t_{n}") for n, c in sums.items()])
    before = Window.partitionBy(*keys).orderBy(sign).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *keys, sign, *[F.coalesce(F.sum(f"__t_{n}").over(before), F.lit(0)).alias(f"__o_{n}") for n in sums]
    )
    direction = F.col(order).desc() if descending else F.col(order).asc()
    local = Window.partitionBy(*keys, sign).orderBy(direction).rowsBetween(Window.unboundedPreceding, -1)
    out = rows.select(
        *rows.columns, *[F.coalesce(F.sum(c).over(local), F.lit(0)).alias(f"__l_{n}") for n, c in sums.items()]
    ).join(small(offsets), [*keys, sign])
    return out.select(
        *df.columns, *[(F.col(f"__l_{n}") + F.col(f"__o_{n}")).alias(n) for n in sums]
    )


def value_index(
    df: DataFrame, value: str, at: str, tie: list[str], split: Split | None = None
) -> DataFrame:
    """Zero-based position of every row in (value, at, tie) order, as ``row_index``.

    Counts below the value come from its histogram; the place among equal values is a running
    count per value, split in time when one value holds very many rows.
    """
    hist = df.groupBy(value).agg(F.count("*").alias("__c"))
    below = prefix_sums(hist, value, {"__below": "__c"}).select(value, "__below")
    placed = running(
        df, [value], at, {"__tie": Agg("sum", F.lit(1).cast("long"))}, split,
        tie=[F.col(c) for c in tie],
    )
    return placed.join(below, value).withColumn(
        "row_index", F.col("__below") + F.coalesce(F.col("__tie"), F.lit(0))
    ).drop("__below", "__tie")


def quantiles(
    df: DataFrame, value: str, probabilities: dict[str, float], group: list[str] | None = None,
    nearest_rank: bool = False, few_groups: bool = False,
) -> DataFrame:
    """Exact quantiles per group as columns, linearly interpolated or by nearest rank.

    The order statistics are found in the prefix sums of the value histogram, so no group's values
    ever meet in one task. With ``few_groups``, named by the caller's own list, the histogram is
    written once for its several passes and short tables are broadcast.
    """
    group = group or []
    rows = df if group else df.withColumn("__g", F.lit(0))
    hist = rows.filter(F.col(value).isNotNull()).groupBy(*(group or ["__g"]), value).agg(F.count("*").alias("__c"))
    hist = stored(hist, "histogram") if few_groups else hist
    return _of_histogram(hist, value, probabilities, group, nearest_rank, few_groups)


def medians(df: DataFrame, names: list[str]) -> dict[str, float]:
    """Exact medians of the columns that have values, interpolated like `quantiles`.

    Sketches tell where each median lies, and only the values there, about a hundredth of all, meet in a histogram;
    what lies outside is counted. A sketch that missed would show, and all values would be taken.
    """
    values = {n: F.col(n).cast("double") for n in names}
    ends = df.agg(*[F.percentile_approx(v, [0.495, 0.505], 1_000).alias(n) for n, v in values.items()]).first()
    values = {n: v for n, v in values.items() if ends[n]}
    if not values:
        return {}
    low, high = ({n: F.lit(ends[n][k]) for n in values} for k in (0, 1))
    counts = [[F.count(F.when(v < low[n], v)).alias(f"l_{n}"), F.count(F.when(v > high[n], v)).alias(f"h_{n}"), F.count(v).alias(f"n_{n}")] for n, v in values.items()]
    found = df.agg(*[c for three in counts for c in three]).first()
    at = {n: (found[f"l_{n}"], found[f"h_{n}"], found[f"n_{n}"]) for n in values}
    missed = [n for n, (below, above, size) in at.items() if below > (size - 1) // 2 or above > (size - 1) // 2]
    inside = [F.when(v.between(low[n], high[n]), F.struct(F.lit(n).alias("name"), v.alias("value"))) for n, v in values.items() if n not in missed]
    out: dict[str, float] = {}
    if inside:
        near = df.select(F.explode(F.array_compact(F.array(*inside))).alias("p")).groupBy("p.name", "p.value").agg(F.count("*").alias("__c"))
        far = [(n, end, c) for n, (below, above, _) in at.items() if n not in missed for end, c in (("-inf", below), ("inf", above)) if c]
        rest = df.sparkSession.createDataFrame([(n, float(end), c) for n, end, c in far], "name string, value double, __c long")
        hist = stored(near.unionByName(rest), "histogram")
        out = {r["name"]: r["m"] for r in _of_histogram(hist, "value", {"m": 0.5}, ["name"], False, True).collect()}
    if missed:
        long = df.select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), values[n].alias("value")) for n in missed])).alias("p")).select("p.*")
        out |= {r["name"]: r["m"] for r in quantiles(long, "value", {"m": 0.5}, ["name"], few_groups=True).collect()}
    return out


def _of_histogram(
    hist: DataFrame, value: str, probabilities: dict[str, float], group: list[str], nearest_rank: bool, few_groups: bool
) -> DataFrame:
    """Quantiles of values that occur ``__c`` times."""
    keys = group or ["__g"]
    low = prefix_sums(hist, value, {"__below": "__c"}, group, few_groups=few_groups)
    sizes = hist.groupBy(*keys).agg(F.sum("__c").alias("__n"))
    placed = low.join(F.broadcast(sizes) if few_groups or not group else sizes, keys)

    def holds(position: Column) -> Column:
        return (F.col("__below") <= position) & (position < F.col("__below") + F.col("__c"))

    aggs, finals = [], []
    for name, q in probabilities.items():
        if nearest_rank:
            rank = F.ceil(F.lit(q) * F.col("__n"))
            at = F.when(rank < 1, 0).otherwise(rank - 1)
            aggs.append(F.max(F.when(holds(at), F.col(value))).alias(name))
            finals.append(F.col(name))
            continue
        place = F.lit(q) * (F.col("__n") - 1)
        aggs += [
            F.max(F.when(holds(F.floor(place)), F.col(value))).alias(f"__lo_{name}"),
            F.max(F.when(holds(F.ceil(place)), F.col(value))).alias(f"__hi_{name}"),
            F.max(place - F.floor(place)).alias(f"__f_{name}"),
        ]
        lo, hi = F.col(f"__lo_{name}").cast("double"), F.col(f"__hi_{name}").cast("double")
        finals.append((lo + (hi - lo) * F.col(f"__f_{name}")).alias(name))
    return placed.groupBy(*keys).agg(*aggs).select(*group, *finals)
