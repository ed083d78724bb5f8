"""Temporal split and leakage-safe target encoding."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.keys import fold_of
from tidewatch.operators.hotkeys import HOUR, HotKeys, Split
from tidewatch.operators.order import global_running
from tidewatch.operators.running import Agg, running

PRIOR_WEIGHT = 50.0


@dataclass(frozen=True)
class Boundaries:
    """Split points in epoch microseconds; calibration is the tail of validation."""

    validation: int
    calibration: int
    embargo: int
    test: int

    def __post_init__(self):
        if not self.validation < self.calibration < self.embargo < self.test:
            raise ValueError("split boundaries must be in order")

    def segment(self, t: Column) -> Column:
        return (
            F.when(t < self.validation, "train")
            .when(t < self.embargo, "validation")
            .when(t < self.test, "embargo")
            .otherwise("test")
        )

    def segments(self, t: Column) -> Column:
        """Every set a row belongs to: calibration rows are validation rows too."""
        in_calibration = (t >= self.calibration) & (t < self.embargo)
        return F.array_compact(
            F.array(self.segment(t), F.when(in_calibration, F.lit("calibration")))
        )


def segment_counts(rows: DataFrame, plan: Boundaries) -> DataFrame:
    """Rows, fraud rate and span per segment; segments overlap, so rows are exploded."""
    return (
        rows.select("t", "is_fraud", F.explode(plan.segments(F.col("t"))).alias("segment"))
        .groupBy("segment")
        .agg(
            F.count("*").alias("rows"),
            F.avg(F.col("is_fraud").cast("double")).alias("fraud_rate"),
            ((F.max("t") - F.min("t")) / F.lit(86_400_000_000.0)).alias("span_days"),
        )
    )


def shared_rows(a: DataFrame, b: DataFrame, key: str = "tx_id") -> DataFrame:
    """Rows two fitted sets have in common; the split is sound only if there are none."""
    return a.select(key).intersect(b.select(key))


def category_rates(train: DataFrame, category: str, weight: float = PRIOR_WEIGHT) -> DataFrame:
    """Smoothed fraud rate per category against the overall rate of the same rows."""
    y = F.col("is_fraud").cast("long")
    k = F.lit(0).alias("__k")
    cells = train.groupBy(category).agg(F.sum(y).alias("fraud"), F.count("*").alias("n"))
    base = train.agg((F.sum(y) / F.count("*")).alias("base")).select("*", k)
    rate = (F.col("fraud") + F.lit(weight) * F.col("base")) / (F.col("n") + F.lit(weight))
    return cells.select("*", k).join(F.broadcast(base), "__k").select(
        category, "fraud", "n", rate.alias("rate")
    )


def out_of_fold(
    rows: DataFrame, category: str, folds: int = 5, weight: float = PRIOR_WEIGHT
) -> DataFrame:
    """Fraud rate of a row's category over the other folds; a fold is whole accounts.

    Other folds are "everything minus this fold", so two small aggregates suffice.
    """
    y = F.col("is_fraud").cast("long")
    marked = rows.withColumn("fold", fold_of(F.col("account"), folds))
    cells = marked.groupBy(category, "fold").agg(F.sum(y).alias("cf"), F.count("*").alias("cn"))
    by_category = cells.groupBy(category).agg(F.sum("cf").alias("f"), F.sum("cn").alias("n"))
    by_fold = cells.groupBy("fold").agg(F.sum("cf").alias("ff"), F.sum("cn").alias("fn"))
    k = F.lit(0).alias("__k")
    total = by_fold.agg(F.sum("ff").alias("F"), F.sum("fn").alias("N")).select("*", k)
    base = by_fold.select("*", k).join(F.broadcast(total), "__k").select(
        "fold", ((F.col("F") - F.col("ff")) / F.nullif(F.col("N") - F.col("fn"), F.lit(0))).alias("base")
    )
    # Every (category, fold) that occurs, so the join back finds each row exactly once.
    rates = (
        cells.join(by_category, category)
        .join(F.broadcast(base), "fold")
        .select(
            category,
            "fold",
            (
                (F.col("f") - F.col("cf") + F.lit(weight) * F.col("base"))
                / (F.col("n") - F.col("cn") + F.lit(weight))
            ).alias("encoded"),
        )
    )
    return marked.join(rates, [category, "fold"])


def expanding(
    rows: DataFrame, category: str, train: Column, hot: HotKeys | None = None,
    weight: float = PRIOR_WEIGHT, grain: int = HOUR,
) -> DataFrame:
    """``encoded``: training rows from earlier rows of other accounts, the rest from the full fit.

    "Other accounts" is everything earlier minus the own account's earlier rows, so four running
    sums replace any look at other rows: all, by category, by account, by both. All rows and
    categories are few, large groups and always cut in time.
    """
    y = F.col("is_fraud").cast("long")
    one = F.lit(1).cast("long")
    marked = rows.withColumn("__train", train)
    fit = category_rates(marked.filter("__train"), category, weight)
    base = marked.filter("__train").agg((F.sum(y) / F.count("*")).alias("__base"))
    tie = [F.col("tx_id")]
    earlier = global_running(
        marked.filter("__train"), "t", ["tx_id"], {"__af": y, "__an": one}, grain
    )
    split = Split("__c", ("0",), grain)
    earlier = running(
        earlier.withColumn("__c", F.lit(0)), [category, "__c"], "t",
        {"__cf": Agg("sum", y), "__cn": Agg("sum", one)}, split, tie=tie,
    ).drop("__c")
    own = hot.split("account") if hot else None
    for keys, name in ((["account"], "o"), (["account", category], "oc")):
        earlier = running(
            earlier, keys, "t", {f"__{name}f": Agg("sum", y), f"__{name}n": Agg("sum", one)}, own, tie=tie
        )

    def v(c: str) -> Column:
        return F.coalesce(F.col(c), F.lit(0))

    others = v("__an") - v("__on")
    rate = F.when(others > 0, (v("__af") - v("__of")) / others).otherwise(0.0)
    encoded = (v("__cf") - v("__ocf") + F.lit(weight) * rate) / (
        v("__cn") - v("__ocn") + F.lit(weight)
    )
    trained = earlier.select("tx_id", encoded.alias("encoded"))
    k = F.lit(0).alias("__k")
    rest = (
        marked.filter(~F.col("__train"))
        .select("tx_id", category, k)
        .join(fit.select(category, "rate"), category, "left")
        .join(F.broadcast(base.select("*", k)), "__k")
        .select("tx_id", F.coalesce(F.col("rate"), F.col("__base")).alias("encoded"))
    )
    return trained.unionByName(rest)
