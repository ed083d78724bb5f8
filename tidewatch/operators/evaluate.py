"""Model evaluation from score histograms.

A histogram (score, positives, negatives) is all that rank metrics need. It is an aggregate, so
one very common score costs one row, and its prefix sums are computed in value buckets rather than
in one ordered task.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.functions import stats
from tidewatch.operators.hotkeys import Split
from tidewatch.operators.order import prefix_sums, value_index
from tidewatch.session import stored

# Operating points, budgets and gate thresholds.
FLAG, BLOCK, FPR_BUDGET, ECE_BINS, PSI_BINS = 0.60, 0.85, 0.01, 15, 10
GATES = (
    ("ML-GATE-01", "auc", 0.940, True),
    ("ML-GATE-02", "recall_at_1pct_fpr", 0.720, True),
    ("ML-GATE-03", "recall_at_flag", 0.880, True),
    ("ML-GATE-04", "f1_at_flag", 0.800, True),
    ("ML-GATE-05", "fpr_at_block", 0.015, False),
    ("ML-GATE-06", "fnr_at_flag", 0.120, False),
    ("ML-GATE-07", "auc_MOBILE_MONEY", 0.920, True),
    ("ML-GATE-08", "auc_USSD", 0.900, True),
    ("ML-GATE-09", "auc_AGENT_BANKING", 0.910, True),
    ("ML-GATE-10", "explained_share", 1.000, True),
    ("ML-GATE-11", "ece_equal_mass", 0.050, False),
)
SHADOW_MIN_HOURS, SHADOW_MIN_SCORED, SHADOW_MIN_COVERAGE = 24, 50_000, 0.30
SHADOW_MIN_AUC_DELTA, SHADOW_MAX_PSI, PSI_FLOOR = -0.010, 0.2, 1e-4

_BIG = "decimal(38,0)"


def histogram(
    rows: DataFrame, score: str = "score", label: str = "is_fraud", group: list[str] | None = None
) -> DataFrame:
    """(group, score, pos, neg); rows without a score are left out with their labels."""
    y = F.col(label).cast("boolean")
    return (
        rows.filter(F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")))
        .groupBy(*(group or []), F.col(score).alias("score"))
        .agg(
            F.sum(y.cast("long")).alias("pos"),
            F.sum((~y).cast("long")).alias("neg"),
        )
    )


def auc(hist: DataFrame, group: list[str] | None = None, few_groups: bool = False) -> DataFrame:
    """(group, pos, neg, auc) with ties counted half; NULL where a class is missing."""
    group = group or []
    ranked = prefix_sums(hist, "score", {"neg_below": "neg"}, group, few_groups=few_groups)
    # Twice the count of (positive above negative) pairs, an exact integer.
    wins = F.sum(
        F.col("pos").cast(_BIG) * (2 * F.col("neg_below") + F.col("neg")).cast(_BIG)
    ).cast(_BIG)
    out = ranked.groupBy(*group).agg(
        F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), wins.alias("__wins")
    )
    pairs = F.col("pos").cast("double") * F.col("neg").cast("double")
    value = F.col("__wins").cast("double") / (2 * F.nullif(pairs, F.lit(0.0)))
    return out.select(*group, "pos", "neg", value.alias("auc"))


def separation(value: Column) -> Column:
    """How well a feature separates the classes in either direction."""
    return F.when(value >= 0.5, value).otherwise(1 - value)


def unpivot_features(matrix: DataFrame, names: list[str], keep: list[str]) -> DataFrame:
    """(keep, name, value) for every feature with a value: one pass for all features."""
    pairs = F.explode(
        F.array(
            *[F.struct(F.lit(n).alias("name"), F.col(n).cast("double").alias("value")) for n in names]
        )
    ).alias("p")
    return matrix.select(*keep, pairs).select(*keep, "p.name", "p.value").filter(
        F.col("value").isNotNull()
    )


def feature_separation(matrix: DataFrame, names: list[str], label: str = "is_fraud") -> DataFrame:
    """Separation of every single feature with its counts and standard error."""
    long = unpivot_features(matrix, names, [label])
    scored = auc(histogram(long, "value", label, ["name"]), ["name"], few_groups=True)
    return scored.withColumn("separation", separation(F.col("auc"))).withColumn(
        "error", stats.auc_standard_error(F.col("auc"), F.col("pos"), F.col("neg"))
    )


def _with_totals(hist: DataFrame, group: list[str]) -> DataFrame:
    totals = hist.groupBy(*group).agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    if group:
        return hist.join(totals, group)
    one = F.lit(0).alias("__k")
    return hist.select("*", one).join(F.broadcast(totals.select("*", one)), "__k").drop("__k")


def budget_point(
    hist: DataFrame, fpr: float = FPR_BUDGET, group: list[str] | None = None
) -> DataFrame:
    """Threshold, recall, precision and realised rate at a false-positive budget.

    The threshold is the negative at position max(0, floor(N * fpr) - 1) from the top, and only
    scores strictly above it are flagged, so ties on it are never charged to the budget.
    """
    group = group or []
    above = prefix_sums(hist, "score", {"tp": "pos", "fp": "neg"}, group, descending=True)
    rows = _with_totals(above, group)
    at = F.greatest(F.lit(0), F.floor(F.col("N") * F.lit(fpr)) - 1)
    at = F.when(at > F.col("N") - 1, F.col("N") - 1).otherwise(at)
    hit = (F.col("fp") <= at) & (at < F.col("fp") + F.col("neg"))
    return rows.filter(hit).select(
        *group,
        F.col("score").alias("threshold"),
        (F.col("tp") / F.nullif(F.col("P"), F.lit(0))).alias("recall"),
        (F.col("tp") / F.nullif(F.col("tp") + F.col("fp"), F.lit(0))).alias("precision"),
        (F.col("fp") / F.col("N")).alias("realised_fpr"),
        (F.col("P") / (F.col("P") + F.col("N"))).alias("base_rate"),
    )


def rank_summary(hist: DataFrame, fpr: float = FPR_BUDGET) -> DataFrame:
    """(pos, neg, auc, recall): `auc` and the recall of `budget_point` in one row, from one ranking.

    What lies above a score is all that is not below it and not its own.
    """
    ranked = _with_totals(prefix_sums(hist, "score", {"neg_below": "neg", "pos_below": "pos"}), [])

    def above(total: str, below: str, own: str) -> Column:
        return F.coalesce(F.col(total), F.lit(0)) - F.col(below) - F.coalesce(F.col(own), F.lit(0))

    fp = above("N", "neg_below", "neg")
    at = F.greatest(F.lit(0), F.floor(F.col("N") * F.lit(fpr)) - 1)
    at = F.when(at > F.col("N") - 1, F.col("N") - 1).otherwise(at)
    hit = (fp <= at) & (at < fp + F.col("neg"))
    recall = above("P", "pos_below", "pos") / F.nullif(F.col("P"), F.lit(0))
    wins = F.col("pos").cast(_BIG) * (2 * F.col("neg_below") + F.col("neg")).cast(_BIG)
    out = ranked.agg(
        F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.sum(wins).cast(_BIG).alias("__wins"),
        F.max(F.when(hit, recall)).alias("recall"),
    )
    pairs = F.col("pos").cast("double") * F.col("neg").cast("double")
    return out.select("pos", "neg", (F.col("__wins").cast("double") / (2 * F.nullif(pairs, F.lit(0.0)))).alias("auc"), "recall")


def operating_point(hist: DataFrame, threshold: float, group: list[str] | None = None) -> DataFrame:
    """Counts and rates of the rule `score >= threshold`, per group; a rate without cases is NULL."""
    flagged = F.col("score") >= F.lit(threshold)
    sums = hist.groupBy(*(group or [])).agg(
        F.coalesce(F.sum(F.when(flagged, F.col("pos"))), F.lit(0)).alias("tp"),
        F.coalesce(F.sum(F.when(flagged, F.col("neg"))), F.lit(0)).alias("fp"),
        F.sum("pos").alias("pos"),
        F.sum("neg").alias("neg"),
    )
    tp, fp, pos, neg = (F.col(c) for c in ("tp", "fp", "pos", "neg"))
    zero = F.lit(0)
    precision = tp / F.nullif(tp + fp, zero)
    recall = tp / F.nullif(pos, zero)
    f1 = F.when(precision.isNotNull() & recall.isNotNull() & (precision + recall > 0),
                2 * precision * recall / (precision + recall))
    return sums.select(
        *(group or []), "tp", "fp", "pos", "neg",
        precision.alias("precision"), recall.alias("recall"), f1.alias("f1"),
        (fp / F.nullif(neg, zero)).alias("fpr"), (1 - recall).alias("fnr"),
    )


def _error_share(bins: DataFrame) -> DataFrame:
    gap = F.abs(F.col("predicted") - F.col("observed")) * F.col("rows")
    return bins.agg((F.sum(gap) / F.sum("rows")).alias("ece"))


def equal_mass_bins(
    rows: DataFrame, tie: list[str], at: str = "t", bins: int = ECE_BINS, split: Split | None = None
) -> DataFrame:
    """Mean score and fraud rate in bins of equal row counts; ties keep (at, tie) order."""
    indexed = value_index(rows.select("score", "is_fraud", at, *tie), "score", at, tie, split)
    total = rows.groupBy().agg(F.count("*").alias("n")).withColumn("__k", F.lit(0))
    placed = indexed.withColumn("__k", F.lit(0)).join(F.broadcast(total), "__k")
    # The first n % bins bins hold one row more than the rest.
    bin_of = F.expr(
        f"CASE WHEN row_index < (n % {bins}) * (n div {bins} + 1)"
        f" THEN row_index div (n div {bins} + 1)"
        f" ELSE n % {bins} + (row_index - (n % {bins}) * (n div {bins} + 1)) div greatest(n div {bins}, 1) END"
    )
    return _binned(placed.withColumn("bin", bin_of))


def equal_width_bins(rows: DataFrame, bins: int = ECE_BINS) -> DataFrame:
    i = F.floor(F.col("score") * F.lit(bins))
    return _binned(rows.withColumn("bin", F.when(i > bins - 1, bins - 1).otherwise(i)))


def _binned(rows: DataFrame) -> DataFrame:
    return rows.groupBy("bin").agg(
        F.count("*").alias("rows"),
        F.avg("score").alias("predicted"),
        F.avg(F.col("is_fraud").cast("double")).alias("observed"),
    )


def calibration_error(bins: DataFrame) -> DataFrame:
    return _error_share(bins)


def brier(rows: DataFrame) -> DataFrame:
    gap = F.col("score") - F.col("is_fraud").cast("double")
    return rows.agg(F.avg(gap * gap).alias("brier"))


def roc_points(hist: DataFrame) -> DataFrame:
    """(threshold, tpr, fpr) at every distinct score, flagging scores at or above it."""
    above = prefix_sums(hist, "score", {"tp": "pos", "fp": "neg"}, descending=True)
    rows = _with_totals(above, [])
    return rows.select(
        F.col("score").alias("threshold"),
        ((F.col("tp") + F.col("pos")) / F.col("P")).alias("tpr"),
        ((F.col("fp") + F.col("neg")) / F.col("N")).alias("fpr"),
    )


def gate_table(metrics: DataFrame) -> DataFrame:
    """Metric rows (metric, value) judged against the gates; a missing value fails."""
    spark = metrics.sparkSession
    specs = spark.createDataFrame(
        [(g, m, float(t), a) for g, m, t, a in GATES],
        "gate string, metric string, threshold double, at_least boolean",
    )
    v, t = F.col("value"), F.col("threshold")
    passes = F.when(v.isNull() | F.isnan(v), False).when(F.col("at_least"), v >= t).otherwise(v < t)
    return F.broadcast(specs).join(metrics, "metric", "left").select(
        "gate", "metric", "value", "threshold", "at_least", passes.alias("passed")
    )


def by_variant(
    rows: DataFrame, variant: str, fpr: float = FPR_BUDGET
) -> DataFrame:
    """Each fraud shape against the same legitimate rows at one threshold."""
    point = budget_point(histogram(rows), fpr).select("threshold", F.lit(0).alias("__k"))
    fraud = rows.filter("is_fraud").withColumn("__k", F.lit(0)).join(F.broadcast(point), "__k")
    counted = fraud.groupBy(variant).agg(
        F.count("*").alias("fraud"),
        F.sum((F.col("score") > F.col("threshold")).cast("long")).alias("detected"),
        F.max("threshold").alias("threshold"),
    )
    low, high = stats.wilson(F.col("detected"), F.col("fraud"))
    return counted.select(
        variant, "fraud", "detected", "threshold",
        (F.col("detected") / F.col("fraud")).alias("recall"),
        low.alias("recall_low"), high.alias("recall_high"),
    )


# ---- stability ----------------------------------------------------------------------------------


def psi(
    expected: DataFrame, actual: DataFrame, value: str, group: list[str] | None = None,
    bins: int = PSI_BINS, few_groups: bool = False,
) -> DataFrame:
    """Population stability of ``actual`` against equal-mass bins of ``expected``."""
    group = group or []
    keys = group or ["__k"]

    def counted(df: DataFrame) -> DataFrame:
        df = df if group else df.withColumn("__k", F.lit(0))
        return df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("c"))

    base, other = counted(expected), counted(actual)
    small = F.broadcast if few_groups else (lambda d: d)
    if few_groups:  # both histograms are read several times
        base, other = stored(base, "expected"), stored(other, "actual")
    below = prefix_sums(base, value, {"below": "c"}, group, few_groups=few_groups)
    sizes = base.groupBy(*keys).agg(F.sum("c").alias("n"))
    i = F.explode(F.sequence(F.lit(1), F.lit(bins - 1))).alias("i")
    # Edge i is the value at position floor(i * n / bins) of the sorted expected values.
    wanted = sizes.select(*keys, "n", i).withColumn("pos", F.expr(f"least(n - 1, (i * n) div {bins})"))
    wanted = wanted.groupBy(*keys).agg(F.collect_list("pos").alias("positions"))
    edges = (
        below.join(small(wanted), keys)
        .withColumn(
            "hits",
            F.size(
                F.filter(
                    "positions",
                    lambda p: (F.col("below") <= p) & (p < F.col("below") + F.col("c")),
                )
            ),
        )
        .filter("hits > 0")
        .groupBy(*keys)
        .agg(F.flatten(F.collect_list(F.array_repeat(value, F.col("hits")))).alias("edges"))
    )

    def shares(df: DataFrame, name: str) -> DataFrame:
        binned = df.join(small(edges), keys).withColumn(
            "bin", F.size(F.filter("edges", lambda e: F.col(value) > e))
        )
        return binned.groupBy(*keys, "bin").agg(F.sum("c").alias(name))

    # Bins nobody fell into still count, at the floor.
    grid = sizes.select(*keys, F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    totals = sizes.withColumnRenamed("n", "en").join(
        other.groupBy(*keys).agg(F.sum("c").alias("an")), keys
    )
    table = (
        grid.join(shares(base, "ec"), [*keys, "bin"], "left")
        .join(shares(other, "ac"), [*keys, "bin"], "left")
        .join(totals, keys)
    )

    def share(c: str, n: str) -> Column:
        s = F.coalesce(F.col(c), F.lit(0)) / F.col(n)
        return F.when(s < PSI_FLOOR, PSI_FLOOR).otherwise(s)

    e, a = share("ec", "en"), share("ac", "an")
    return table.groupBy(*keys).agg(F.sum((a - e) * F.ln(a / e)).alias("psi")).select(*group, "psi")


def shadow_gate(
    scores: DataFrame, labels: DataFrame, started_us: int, now_us: int,
    min_scored: int = SHADOW_MIN_SCORED,
) -> DataFrame:
    """One row: whether a shadow model may be promoted, and every reason why not.

    ``scores`` holds (tx_id, production, shadow); ``labels`` (tx_id, is_fraud) known by now.
    """
    joined = scores.join(labels.select("tx_id", "is_fraud"), "tx_id", "left")
    counts = joined.agg(
        F.count("*").alias("scored"),
        (F.count("is_fraud") / F.nullif(F.count("*"), F.lit(0))).alias("coverage"),
        F.avg(F.abs(F.col("production") - F.col("shadow"))).alias("mean_abs_diff"),
    )
    labelled = joined.filter(F.col("is_fraud").isNotNull())
    shadow = auc(histogram(labelled, "shadow")).select(F.col("auc").alias("shadow_auc"))
    live = auc(histogram(labelled, "production")).select(F.col("auc").alias("production_auc"))
    stability = psi(
        scores.select(F.col("production").alias("s")), scores.select(F.col("shadow").alias("s")), "s"
    )
    k = F.lit(0).alias("__k")
    row = counts.select("*", k)
    for part in (shadow, live, stability):  # one row each
        row = row.join(F.broadcast(part.select("*", k)), "__k", "left")
    delta = F.col("shadow_auc") - F.col("production_auc")
    hours = (now_us - started_us) / 3.6e9
    covered = F.col("coverage") >= SHADOW_MIN_COVERAGE
    reasons = F.array_compact(
        F.array(
            F.when(F.lit(hours < SHADOW_MIN_HOURS), F.lit("duration")),
            F.when(F.col("scored") < min_scored, F.lit("scored")),
            F.when(~covered, F.lit("coverage")),
            F.when(covered & delta.isNull(), F.lit("one_class")),
            F.when(covered & delta.isNotNull() & ((delta < SHADOW_MIN_AUC_DELTA) | F.isnan(delta)),
                   F.lit("auc_delta")),
            F.when(F.col("psi") >= SHADOW_MAX_PSI, F.lit("psi")),
        )
    )
    return row.select(
        "scored", F.col("coverage").alias("label_coverage"), "mean_abs_diff",
        F.when(covered, delta).alias("auc_delta"), "psi", reasons.alias("reasons"),
        (F.size(reasons) == 0).alias("promote"),
    )


# ---- two classifiers, and resampling ----------------------------------------------------------------


@F.pandas_udf(T.DoubleType())
def _two_sided_p(z: pd.Series) -> pd.Series:
    return z.map(lambda v: None if v is None or math.isnan(v) else math.erfc(abs(v) / math.sqrt(2)))


def delong(rows: DataFrame, first: str, second: str, label: str = "is_fraud") -> DataFrame:
    """DeLong's test for two correlated AUCs on the same rows: one row with both, z and p.

    Every row's structural component depends only on its own pair of scores, so the rows are
    first counted per (first, second, label).
    """
    cells = rows.groupBy(first, second, F.col(label).alias("y")).agg(F.count("*").alias("w"))
    parts = cells
    for name in (first, second):
        hist = cells.groupBy(name).agg(
            F.sum(F.when(F.col("y"), F.col("w")).otherwise(0)).alias("pos"),
            F.sum(F.when(~F.col("y"), F.col("w")).otherwise(0)).alias("neg"),
        )
        low = prefix_sums(hist, name, {"pb": "pos", "nb": "neg"})
        beaten = F.when(F.lit(True), F.col("nb") + F.col("neg") / 2)
        parts = parts.join(
            low.select(
                name,
                beaten.alias(f"__neg_{name}"),
                (F.col("pb") + F.col("pos") / 2).alias(f"__pos_{name}"),
            ),
            name,
        )
    sizes = cells.agg(
        F.sum(F.when(F.col("y"), F.col("w"))).alias("m"),
        F.sum(F.when(~F.col("y"), F.col("w"))).alias("n"),
    ).withColumn("__k", F.lit(0))
    parts = parts.withColumn("__k", F.lit(0)).join(F.broadcast(sizes), "__k")
    a = F.when(F.col("y"), F.col(f"__neg_{first}") / F.col("n")).otherwise(
        1 - F.col(f"__pos_{first}") / F.col("m")
    )
    b = F.when(F.col("y"), F.col(f"__neg_{second}") / F.col("n")).otherwise(
        1 - F.col(f"__pos_{second}") / F.col("m")
    )
    w = F.col("w")
    moments = parts.select("y", "w", a.alias("a"), b.alias("b"), "m", "n").groupBy("y").agg(
        F.sum("w").alias("c"), F.sum(w * F.col("a")).alias("sa"), F.sum(w * F.col("b")).alias("sb"),
        F.sum(w * (F.col("a") - F.col("b")) * (F.col("a") - F.col("b"))).alias("sdd"),
        F.sum(w * (F.col("a") - F.col("b"))).alias("sd"),
    )
    # Var(A - B) per class: the variance of the difference of the components.
    part = (F.col("sdd") - F.col("sd") * F.col("sd") / F.col("c")) / (F.col("c") - 1) / F.col("c")
    out = moments.agg(
        F.max(F.when(F.col("y"), F.col("sa") / F.col("c"))).alias("auc_first"),
        F.max(F.when(F.col("y"), F.col("sb") / F.col("c"))).alias("auc_second"),
        F.sum(part).alias("variance"),
    )
    z = (F.col("auc_first") - F.col("auc_second")) / F.sqrt(F.col("variance"))
    return out.withColumn("z", F.when(F.col("variance") > 0, z)).withColumn(
        "p",
        F.coalesce(
            _two_sided_p("z"),
            F.when(F.col("auc_first") == F.col("auc_second"), 1.0).otherwise(0.0),
        ),
    )


def bootstrap(
    hist: DataFrame, resamples: int = 1000, seed: int = 7, buckets: int = 64,
    flag: float = FLAG, block: float = BLOCK, fpr: float = FPR_BUDGET,
) -> DataFrame:
    """95% percentile intervals of rank and threshold metrics, resampled within each class.

    Resampling rows with replacement is drawing multinomial counts over histogram cells. The draw
    is made in two steps with the same law: totals per value bucket first, then cells within each
    bucket, so a task holds one bucket of cells and never all of them.
    """
    cuts = hist.groupBy().agg(
        F.percentile_approx("score", [i / buckets for i in range(1, buckets)], 10 * buckets).alias("q")
    )
    keyed = hist.withColumn("__k", F.lit(0)).join(
        F.broadcast(cuts.withColumn("__k", F.lit(0))), "__k"
    )
    cells = keyed.select(
        F.size(F.filter("q", lambda c: c < F.col("score"))).alias("b"), "score", "pos", "neg"
    )
    sums = sorted(
        (r["b"], r["p"], r["n"])
        for r in cells.groupBy("b").agg(F.sum("pos").alias("p"), F.sum("neg").alias("n")).collect()
    )  # at most one row per bucket
    slot = {b: i for i, (b, _, _) in enumerate(sums)}
    p, n = np.array([s[1] for s in sums], float), np.array([s[2] for s in sums], float)
    rng = np.random.default_rng(seed)
    draw_p = rng.multinomial(int(p.sum()), p / p.sum(), resamples)
    draw_n = rng.multinomial(int(n.sum()), n / n.sum(), resamples)
    total_p, total_n = int(p.sum()), int(n.sum())
    at = min(total_n - 1, max(0, int(total_n * fpr) - 1))

    def resample(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("score")
        i = slot[int(pdf["b"].iloc[0])]
        gen = np.random.default_rng([seed, i])
        s = pdf["score"].to_numpy()
        wp, wn = pdf["pos"].to_numpy(float), pdf["neg"].to_numpy(float)
        out = []
        for r in range(resamples):
            dp = gen.multinomial(draw_p[r, i], wp / wp.sum()) if draw_p[r, i] else np.zeros(len(s))
            dn = gen.multinomial(draw_n[r, i], wn / wn.sum()) if draw_n[r, i] else np.zeros(len(s))
            lower = np.cumsum(dn) - dn + draw_n[r, :i].sum()
            wins = float((dp * (lower + dn / 2)).sum())
            fp_above = draw_n[r, i + 1 :].sum() + dn.sum() - np.cumsum(dn)
            hit = np.flatnonzero((fp_above <= at) & (at < fp_above + dn))
            caught = None
            if len(hit):
                caught = float(draw_p[r, i + 1 :].sum() + dp[hit[0] + 1 :].sum())
            out.append(
                (r, wins, caught, float(dp[s >= flag].sum()), float(dn[s >= flag].sum()),
                 float(dp[s >= block].sum()), float(dn[s >= block].sum()))
            )
        return pd.DataFrame(out, columns=["r", "wins", "caught", "ftp", "ffp", "btp", "bfp"])

    drawn = cells.groupBy("b").applyInPandas(
        resample, "r int, wins double, caught double, ftp double, ffp double, btp double, bfp double"
    )
    reps = drawn.groupBy("r").agg(
        (F.sum("wins") / F.lit(float(total_p * total_n))).alias("auc"),
        (F.max("caught") / F.lit(float(total_p))).alias("recall_at_1pct_fpr"),
        (F.sum("ftp") / F.lit(float(total_p))).alias("recall_at_flag"),
        (F.sum("ffp") / F.lit(float(total_n))).alias("fpr_at_flag"),
        (F.sum("bfp") / F.lit(float(total_n))).alias("fpr_at_block"),
        (F.sum("ftp") / F.nullif(F.sum("ftp") + F.sum("ffp"), F.lit(0.0))).alias("precision_at_flag"),
    )
    names = [c for c in reps.columns if c != "r"]
    long = reps.select(
        F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("v")) for m in names])).alias("x")
    ).select("x.*")
    return long.groupBy("metric").agg(
        F.percentile("v", F.lit(0.025)).alias("low"), F.percentile("v", F.lit(0.975)).alias("high"),
        F.count("v").alias("defined"),
    )
