"""Exact medians, MAD and maximum over a sliding 90-day window per account.

A median has no running form, so this is the one feature family that looks at window contents in
Python. Ordinary accounts are handled one group at a time with a sorted sliding window. A hot
account is never gathered: its rows are numbered in time order and cut into blocks, and a task
answers the rows of one (upper block, lower block) pair from

* the rows of those two blocks, where the window's ends move, and
* only those values of the full blocks in between that can be the wanted order statistic, found
  by narrowing a value histogram with the counts of full blocks.

Both paths are exact.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.geo import haversine_km
from tidewatch.operators.hotkeys import HotKeys, Split
from tidewatch.operators.running import Agg, Trailing, trailing
from tidewatch.plans.registry import FEATURES, MAD_TO_SIGMA
from tidewatch.session import cut

#: Rows per block of a hot account, and the most value bins its histogram may have.
BLOCK = 100_000
MAX_BINS = 4_096

_STATS = "tx_id {id}, n long, x_med double, x_mad double, x_max double, lat_med double, lon_med double"


# ---- order statistics of a sorted list ------------------------------------------------------------


def _middle(values: list[float], below: int, n: int) -> float:
    """Median of n values of which ``below`` smaller ones are not in the list."""
    low, high = values[(n - 1) // 2 - below], values[n // 2 - below]
    return (low + high) / 2.0


def _kth_deviation(values: list[float], centre: float, k: int) -> float:
    """k-th smallest (0-based) of |v - centre| over a sorted list, by bisection on the split."""
    cut_at = bisect_left(values, centre)
    left, right = cut_at, len(values) - cut_at
    low, high = max(0, k + 1 - right), min(k + 1, left)
    while low < high:
        take = (low + high) // 2  # from the left side; the rest of k + 1 from the right
        if centre - values[cut_at - 1 - take] < values[cut_at + (k - take)] - centre:
            low = take + 1
        else:
            high = take
    best = 0.0
    if low > 0:
        best = centre - values[cut_at - low]
    if k + 1 - low > 0:
        best = max(best, values[cut_at + k - low] - centre)
    return best


def _mad(values: list[float], centre: float, inside: int, n: int) -> float:
    """Median deviation of n values of which ``inside`` nearer ones are not in the list."""
    a = _kth_deviation(values, centre, (n - 1) // 2 - inside)
    return a if n % 2 else (a + _kth_deviation(values, centre, n // 2 - inside)) / 2.0


def _drop(values: list[float], v: float) -> None:
    del values[bisect_left(values, v)]


# ---- ordinary accounts ------------------------------------------------------------------------------


def _sliding(span: int):
    def stats(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t", kind="stable")
        t = pdf["t"].to_numpy()
        cols = [pdf[c].to_numpy().tolist() for c in ("x", "lat", "lon")]
        upper = np.searchsorted(t, t, side="left").tolist()
        lower = np.searchsorted(t, t - span, side="right").tolist()
        held: list[list[float]] = [[], [], []]
        added = gone = 0
        out = []
        for lo, hi in zip(lower, upper):
            for column, values in zip(cols, held):
                for i in range(added, hi):
                    insort(values, column[i])
                for i in range(gone, lo):
                    _drop(values, column[i])
            added, gone, n = hi, lo, hi - lo
            if n == 0:
                out.append((0, None, None, None, None, None))
                continue
            x = held[0]
            centre = _middle(x, 0, n)
            out.append(
                (n, centre, _mad(x, centre, 0, n), x[-1], _middle(held[1], 0, n),
                 _middle(held[2], 0, n))
            )
        frame = pd.DataFrame(out, columns=["n", "x_med", "x_mad", "x_max", "lat_med", "lon_med"])
        frame.insert(0, "tx_id", pdf["tx_id"].to_numpy())
        return frame

    return stats


def window_stats(p: DataFrame, span: int, hot: HotKeys | None = None) -> DataFrame:
    """(tx_id, n, x_med, x_mad, x_max, lat_med, lon_med) of the open window before each payment."""
    rows = p.select("tx_id", "account", "t", F.col("amount").cast("double").alias("x"), "lat", "lon")
    schema = _STATS.format(id=rows.schema["tx_id"].dataType.simpleString())
    split = hot.split("account") if hot else None
    if split is None:
        return rows.groupBy("account").applyInPandas(_sliding(span), schema)
    ordinary = rows.filter(~split.hot()).groupBy("account").applyInPandas(_sliding(span), schema)
    return ordinary.unionByName(_hot_stats(rows.filter(split.hot()), span, split, schema))


# ---- hot accounts -----------------------------------------------------------------------------------


def _hot_stats(
    rows: DataFrame, span: int, split: Split, schema: str, block: int | None = None
) -> DataFrame:
    block = block or BLOCK
    one = F.lit(1).cast("long")
    counted = trailing(
        rows, ["account"], "t", {"n": Trailing(one, span)}, {"before": Agg("sum", one)}, split
    )
    same_time = Window.partitionBy("account", "t").orderBy("tx_id")
    hi = F.coalesce(F.col("before"), F.lit(0))
    base = cut(
        counted.withColumn("hi", hi)
        .withColumn("lo", hi - F.col("n"))
        .withColumn("rn", hi + F.row_number().over(same_time) - 1)
        .withColumn("blk", F.expr(f"rn div {block}"))
        .withColumn("hb", F.expr(f"hi div {block}"))
        .withColumn("lb", F.expr(f"lo div {block}"))
        .drop("before")
    )
    asked = base.filter("n > 0")
    med = cut(_order_stats(base, asked, "x", block, None))
    centred = asked.join(med.withColumnRenamed("value", "centre"), "tx_id")
    mad = _order_stats(base, centred, "x", block, "centre")
    lat = _order_stats(base, asked, "lat", block, None)
    lon = _order_stats(base, asked, "lon", block, None)
    out = base.select("tx_id", "n")
    for stats, name in ((med, "x_med"), (mad, "x_mad"), (lat, "lat_med"), (lon, "lon_med")):
        out = out.join(stats.withColumnRenamed("value", name), "tx_id", "left")
    out = out.join(_window_max(base, block), "tx_id", "left")
    names = [part.strip().split(" ")[0] for part in schema.split(",")]
    return out.select(*names)


def _chunks(asked: DataFrame) -> DataFrame:
    """One row per task: the range of window sizes met in it, and of centres if there are any."""
    aggs = [F.min("n").alias("n_min"), F.max("n").alias("n_max")]
    if "centre" in asked.columns:
        aggs += [F.min("centre").alias("m_lo"), F.max("centre").alias("m_hi")]
    return asked.groupBy("account", "hb", "lb").agg(*aggs)


def _order_stats(
    base: DataFrame, asked: DataFrame, col: str, block: int, centre: str | None
) -> DataFrame:
    """(tx_id, value) of the asked rows: window median of ``col``, or median distance from ``centre``."""
    binned, bins = _bins(base, col, block)
    chunks = _chunks(asked)
    wanted = _wanted_bins(binned, bins, chunks, centre is not None)
    ids = ["account", "hb", "lb"]
    null = F.lit(None)
    queries = asked.select(
        *ids, F.lit("q").alias("kind"), "tx_id", "rn", "lo", "hi",
        F.col(centre).alias("v") if centre else null.cast("double").alias("v"),
        F.lit(0).cast("long").alias("skip"),
    )
    def shipped(df: DataFrame, kind: str, skip) -> DataFrame:
        return df.select(
            *ids, F.lit(kind).alias("kind"), null.cast(base.schema["tx_id"].dataType).alias("tx_id"),
            F.col("rn"), null.cast("long").alias("lo"), null.cast("long").alias("hi"),
            F.col("v"), skip.cast("long").alias("skip"),
        )

    raw = base.select("account", F.col("blk"), "rn", F.col(col).alias("v"))
    ends = chunks.select(*ids, F.explode(F.array_distinct(F.array("hb", "lb"))).alias("blk"))
    edges = shipped(ends.join(raw, ["account", "blk"]), "e", F.lit(0))
    # One row per (task, wanted bin, full block) makes this an equi-join spread over all blocks.
    fetch = wanted.filter("fetch and hb - lb > 1").select(
        *ids, "bin", F.explode(F.sequence(F.col("lb") + 1, F.col("hb") - 1)).alias("blk")
    )
    core = shipped(
        fetch.join(binned.select("account", "bin", "blk", "rn", "v"), ["account", "bin", "blk"]),
        "c", F.lit(0),
    )
    skips = shipped(
        wanted.groupBy(*ids)
        .agg(F.first("skip").alias("s"))
        .withColumn("rn", null.cast("long"))
        .withColumn("v", null.cast("double")),
        "s", F.col("s"),
    )
    tasks = queries.unionByName(edges).unionByName(core).unionByName(skips)
    id_type = base.schema["tx_id"].dataType.simpleString()
    return tasks.groupBy(*ids).applyInPandas(
        _answer(centre is not None, block), f"tx_id {id_type}, value double"
    )


def _bins(base: DataFrame, col: str, block: int) -> tuple[DataFrame, DataFrame]:
    """Rows with a value bin, and each bin's exact range. Edges are only a layout: any will do."""
    spark = base.sparkSession
    edges = base.groupBy("account").agg(
        F.count("*").alias("rows"),
        F.percentile_approx(
            col, [i / MAX_BINS for i in range(1, MAX_BINS)], 4 * MAX_BINS
        ).alias("q"),
    )
    # About one bin per block of rows. The list is short by construction: hot accounts only, at
    # most MAX_BINS edges each.
    table = {}
    for row in edges.collect():
        step = max(1, MAX_BINS * block // row["rows"])
        table[row["account"]] = np.unique(np.asarray(row["q"][step - 1 :: step]))
    known = spark.sparkContext.broadcast(table)

    @F.pandas_udf("int")
    def bin_of(account: pd.Series, v: pd.Series) -> pd.Series:
        out = np.zeros(len(v), dtype=np.int32)
        for key, at in v.groupby(account).indices.items():
            out[at] = np.searchsorted(known.value[key], v.to_numpy()[at], side="left")
        return pd.Series(out)

    binned = cut(
        base.select("account", "blk", "rn", F.col(col).alias("v")).withColumn(
            "bin", bin_of("account", "v")
        )
    )
    ranges = binned.groupBy("account", "bin").agg(F.min("v").alias("b_lo"), F.max("v").alias("b_hi"))
    return binned, ranges


def _wanted_bins(
    binned: DataFrame, ranges: DataFrame, chunks: DataFrame, deviations: bool
) -> DataFrame:
    """Per task and bin: whether its full-block values must be shipped, and how many are skipped."""
    hist = binned.groupBy("account", "bin", "blk").agg(F.count("*").alias("c"))
    probes = chunks.join(ranges, "account").select(
        "account", "hb", "lb", "bin",
        F.explode(
            F.array(
                F.struct(F.col("lb").alias("blk"), F.lit(-1).alias("sign")),
                F.struct(F.greatest(F.col("hb") - 1, F.col("lb")).alias("blk"), F.lit(1).alias("sign")),
            )
        ).alias("p"),
    ).select("account", "hb", "lb", "bin", "p.*")
    rows = hist.unionByName(probes, allowMissingColumns=True)
    upto = (
        Window.partitionBy("account", "bin")
        .orderBy("blk")
        .rangeBetween(Window.unboundedPreceding, 0)
    )
    counts = (
        rows.withColumn("upto", F.coalesce(F.sum("c").over(upto), F.lit(0)))
        .filter("sign is not null")
        .groupBy("account", "hb", "lb", "bin")
        .agg(F.sum(F.col("sign") * F.col("upto")).alias("c"))
    )
    table = counts.join(ranges, ["account", "bin"]).join(chunks, ["account", "hb", "lb"])
    schema = "account {a}, hb long, lb long, bin int, fetch boolean, skip long".format(
        a=binned.schema["account"].dataType.simpleString()
    )
    return table.groupBy("account", "hb", "lb").applyInPandas(
        _choose_deviation_bins if deviations else _choose_median_bins, schema
    )


def _chosen(pdf: pd.DataFrame, fetch: np.ndarray, skip: int) -> pd.DataFrame:
    out = pdf[["account", "hb", "lb", "bin"]].copy()
    out["fetch"] = fetch & (pdf["c"].to_numpy() > 0)
    out["skip"] = skip
    return out


def _choose_median_bins(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("bin")
    count = pdf["c"].to_numpy()
    core = int(count.sum())
    n_min, n_max = int(pdf["n_min"].iloc[0]), int(pdf["n_max"].iloc[0])
    # Edge rows only shift the wanted rank by their number, n - core.
    first = min((n - 1) // 2 - (n - core) for n in (n_min, n_max))
    last = n_max // 2
    below = np.cumsum(count) - count
    fetch = (below <= last) & (below + count > first)
    skip = int(below[fetch].min()) if fetch.any() else 0
    return _chosen(pdf, fetch, skip)


def _choose_deviation_bins(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("bin")
    count = pdf["c"].to_numpy()
    lo, hi = pdf["b_lo"].to_numpy(), pdf["b_hi"].to_numpy()
    core = int(count.sum())
    n_min, n_max = int(pdf["n_min"].iloc[0]), int(pdf["n_max"].iloc[0])
    m_lo, m_hi = float(pdf["m_lo"].iloc[0]), float(pdf["m_hi"].iloc[0])
    # A bin is surely within radius d of every centre from `need`, possibly of one from `reach`.
    need = np.maximum(m_hi - lo, hi - m_lo)
    reach = np.maximum(0.0, np.maximum(lo - m_hi, m_lo - hi))
    order = np.argsort(need, kind="stable")
    enough = np.flatnonzero(np.cumsum(count[order]) >= n_max // 2 + 1)
    d_hi = need[order][enough[0]] if len(enough) else np.inf
    floor = min((n - 1) // 2 + 1 - (n - core) for n in (n_min, n_max))
    order = np.argsort(reach, kind="stable")
    within = np.cumsum(count[order])
    # Largest radius that even with every reachable bin holds too few: the next bin's reach.
    few = np.searchsorted(within, floor, side="left")
    d_lo = reach[order][few] if floor > 0 and few < len(order) else 0.0
    inside = need < d_lo
    fetch = ~inside & (reach <= d_hi)
    return _chosen(pdf, fetch, int(count[inside].sum()))


def _answer(deviations: bool, block: int):
    def answer(pdf: pd.DataFrame) -> pd.DataFrame:
        kind = pdf["kind"].to_numpy()
        skip = int(pdf.loc[kind == "s", "skip"].max()) if (kind == "s").any() else 0
        values = sorted(pdf.loc[kind == "c", "v"].tolist())
        edges = pdf[kind == "e"].sort_values("rn")
        e_rn, e_v = edges["rn"].astype("int64").to_numpy(), edges["v"].to_numpy().tolist()
        queries = pdf[kind == "q"].sort_values("rn")
        hb, lb = int(pdf["hb"].iloc[0]), int(pdf["lb"].iloc[0])
        lows = queries["lo"].astype("int64").to_numpy()
        highs = queries["hi"].astype("int64").to_numpy()
        # The lower block's rows leave as `lo` moves on; the upper block's join as `hi` does.
        if hb == lb:
            start = int(np.searchsorted(e_rn, lows[0])) if len(lows) else 0
            added = gone = start
        else:
            gone = int(np.searchsorted(e_rn, lows[0]))
            added = int(np.searchsorted(e_rn, hb * block))
            for i in range(gone, added):
                insort(values, e_v[i])
        out = []
        centres = queries["v"].to_numpy()
        for j, tx in enumerate(queries["tx_id"]):
            lo_i, hi_i = int(np.searchsorted(e_rn, lows[j])), int(np.searchsorted(e_rn, highs[j]))
            for i in range(added, hi_i):
                insort(values, e_v[i])
            for i in range(gone, lo_i):
                _drop(values, e_v[i])
            added, gone = max(added, hi_i), max(gone, lo_i)
            n = int(highs[j] - lows[j])
            if deviations:
                out.append((tx, _mad(values, float(centres[j]), skip, n)))
            else:
                out.append((tx, _middle(values, skip, n)))
        return pd.DataFrame(out, columns=["tx_id", "value"])

    return answer


def _window_max(base: DataFrame, block: int) -> DataFrame:
    """Maximum of x over each window: full blocks from block maxima, the ends by sorted scans."""
    ids = ["account", "hb", "lb"]
    chunks = _chunks(base.filter("n > 0"))
    tops = base.groupBy("account", "blk").agg(F.max("x").alias("top"))
    full = (
        chunks.filter("hb - lb > 1")
        .select(*ids, F.explode(F.sequence(F.col("lb") + 1, F.col("hb") - 1)).alias("blk"))
        .join(tops, ["account", "blk"])
        .groupBy(*ids)
        .agg(F.max("top").alias("core_max"))
    )
    head = Window.partitionBy("account", "blk").orderBy("rn").rowsBetween(Window.unboundedPreceding, 0)
    tail = Window.partitionBy("account", "blk").orderBy(F.desc("rn")).rowsBetween(
        Window.unboundedPreceding, 0
    )
    marks = base.select(
        "account", "rn", F.max("x").over(head).alias("head_max"), F.max("x").over(tail).alias("tail_max")
    )
    q = base.filter("n > 0").select("tx_id", *ids, "lo", "hi")
    far = (
        q.filter("hb > lb")
        .join(full, ids, "left")
        .join(marks.select("account", F.col("rn").alias("lo"), "tail_max"), ["account", "lo"], "left")
        .join(
            marks.select("account", (F.col("rn") + 1).alias("hi"), "head_max"), ["account", "hi"], "left"
        )
        .withColumn("head_max", F.when(F.col("hi") > F.col("hb") * F.lit(block), F.col("head_max")))
        .select("tx_id", F.greatest("core_max", "tail_max", "head_max").alias("x_max"))
    )
    # Both ends in one block: at most one block of rows per task.
    near = q.filter("hb = lb").select("tx_id", "account", F.col("hb").alias("blk"), "lo", "hi")
    rows = near.withColumn("rn", F.lit(None).cast("long")).withColumn("x", F.lit(None).cast("double"))
    rows = rows.unionByName(
        base.select("account", "blk", "rn", "x"), allowMissingColumns=True
    )
    id_type = base.schema["tx_id"].dataType.simpleString()
    inner = rows.groupBy("account", "blk").applyInPandas(
        _inner_max, f"tx_id {id_type}, x_max double"
    )
    return far.unionByName(inner)


def _inner_max(pdf: pd.DataFrame) -> pd.DataFrame:
    data = pdf[pdf["tx_id"].isna()].sort_values("rn")
    q = pdf[pdf["tx_id"].notna()].sort_values(["hi", "lo"])
    rn, x = data["rn"].astype("int64").to_numpy(), data["x"].to_numpy().tolist()
    lows = np.searchsorted(rn, q["lo"].astype("int64").to_numpy()).tolist()
    highs = np.searchsorted(rn, q["hi"].astype("int64").to_numpy()).tolist()
    held: list[float] = []
    added = gone = lows[0] if lows else 0
    out = []
    for lo, hi in zip(lows, highs):
        for i in range(added, hi):
            insort(held, x[i])
        for i in range(gone, lo):
            _drop(held, x[i])
        added, gone = max(added, hi), max(gone, lo)
        out.append(held[-1])
    return pd.DataFrame({"tx_id": q["tx_id"].to_numpy(), "x_max": out})


# ---- the three features -------------------------------------------------------------------------------


def amount_and_home(p: DataFrame, hot: HotKeys | None = None) -> DataFrame:
    """(tx_id, amount_zscore_90d, amount_to_max_90d_ratio, distance_from_home_centroid_km)."""
    z = FEATURES["amount_zscore_90d"]
    stats = window_stats(p, z.span, hot)
    x = F.col("amount").cast("double")
    rows = p.select("tx_id", "amount", "lat", "lon").join(stats, "tx_id")
    zscore = (x - F.col("x_med")) / (F.lit(MAD_TO_SIGMA) * F.col("x_mad"))
    return rows.select(
        "tx_id",
        F.when((F.col("n") >= z.minimum_history) & (F.col("x_mad") > 0), zscore).alias(
            "amount_zscore_90d"
        ),
        F.when(F.col("x_max") > 0, x / F.col("x_max")).alias("amount_to_max_90d_ratio"),
        F.when(
            F.col("n") > 0,
            haversine_km(F.col("lat_med"), F.col("lon_med"), F.col("lat"), F.col("lon")),
        ).alias("distance_from_home_centroid_km"),
    )
