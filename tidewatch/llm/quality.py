"""Quality rules: a decision list learned by sequential covering, applied as one Spark expression.

Statistics come from whole texts with built-in functions. The learner sees labelled documents as
counts: every statistic is turned into the number of its fixed cut points that it reaches, and equal
rows are counted. A rule grows one threshold at a time by information gain over the growing part,
and loses its last conditions again as long as that helps over the pruning part. Both parts are all
labelled rows; each step is one aggregate whose result has at most a row for each cut point.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.shared import pin, stored

SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"

#: Derived shares and the cut points a condition may use. Fixed values.
CUTS: dict[str, tuple[float, ...]] = {
    "n_words": (20, 35, 50, 75, 100, 150, 200, 400, 800, 1600, 3200, 6400, 12800),
    "mean_word": (2, 2.5, 3, 3.5, 4, 4.5, 5, 5.5, 6, 6.5, 7, 7.5, 8, 9, 10, 12),
    "symbol_share": (0.002, 0.005, 0.01, 0.02, 0.03, 0.05, 0.08, 0.1, 0.15, 0.2, 0.25, 0.3, 0.4),
    "dup_line_share": (0.02, 0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9),
    "repeat_share": (0.02, 0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9),
    "upper_share": (0.02, 0.04, 0.06, 0.08, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8),
    "punct_share": (0.02, 0.04, 0.06, 0.08, 0.1, 0.12, 0.15, 0.2, 0.25, 0.3, 0.4, 0.5),
}


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the counts of every whole text; a null text has none of anything.

    Adds n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_upper, n_punct. A
    column of docs with one of these names is replaced. Any other column stays.

    n_repeat_words sorts 64-bit keys of three-word windows whose low bits hold the place, so equal
    windows become neighbours: n log n for a text of any length.
    """
    body = "_body"
    own = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper", "n_punct"]
    rows = docs.drop(*own).withColumn(body, F.coalesce(F.col(f"`{text}`"), F.lit("")))
    rows = pin(rows, _words=F.array_remove(F.split(body, SPACES), ""), _lines=F.split(body, "\n"))
    bare = lambda pattern: F.length(body) - F.length(F.regexp_replace(body, pattern, ""))
    rows = pin(
        rows,
        n_words=F.size("_words").cast("long"),
        word_chars=F.length(F.array_join("_words", "")).cast("long"),
        _hashes=F.transform("_words", lambda w: F.xxhash64(w)),
        _bits=F.length(F.bin(F.size("_words").cast("long"))),
        _filled=F.filter("_lines", lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
    )
    rows = pin(
        rows.drop("_words", "_lines"),
        n_lines=F.size("_filled").cast("long"),
        n_dup_lines=(F.size("_filled") - F.size(F.array_distinct("_filled"))).cast("long"),
        n_symbols=bare(SYMBOLS).cast("long"),
        n_upper=bare("[A-Z]").cast("long"),
        n_punct=bare(r"[!-/:-@\[-`{-~]").cast("long"),
        _keys=F.expr(
            "sort_array(transform(slice(_hashes, 1, greatest(cast(n_words - 2 as int), 0)), (x, i) ->"
            " shiftleft(xxhash64(x, get(_hashes, i + 1), get(_hashes, i + 2)), _bits) | cast(i as bigint)))"
        ),
    )
    rows = pin(
        rows.drop("_hashes", "_filled", body),
        _again=F.expr(
            "filter(_keys, (x, i) ->"
            " coalesce(shiftrightunsigned(x, _bits) = shiftrightunsigned(get(_keys, i + 1), _bits), false)"
            " or coalesce(shiftrightunsigned(x, _bits) = shiftrightunsigned(get(_keys, i - 1), _bits), false))"
        ),
    )
    rows = rows.withColumn(
        "n_repeat_words",
        F.expr(
            "cast(size(array_distinct(flatten(transform(_again, x -> transform(sequence(0, 2), k ->"
            " (x & (shiftleft(1L, _bits) - 1L)) + k))))) as bigint)"
        ),
    )
    return rows.drop("_keys", "_again", "_bits")


def shares() -> dict[str, Column]:
    """What conditions look at, as columns over statistics()."""
    per = lambda a, b: F.coalesce(F.col(a) / F.greatest(F.col(b), F.lit(1)), F.lit(0.0))
    return {
        "n_words": F.col("n_words").cast("double"),
        "mean_word": per("word_chars", "n_words"),
        "symbol_share": per("n_symbols", "word_chars"),
        "dup_line_share": per("n_dup_lines", "n_lines"),
        "repeat_share": per("n_repeat_words", "n_words"),
        "upper_share": per("n_upper", "word_chars"),
        "punct_share": per("n_punct", "word_chars"),
    }


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    """share >= cut if upward, else share < cut; level is the place of the cut, counted from 1."""

    share: str
    level: int
    upward: bool

    def on_levels(self) -> Column:
        return F.col(self.share) >= self.level if self.upward else F.col(self.share) < self.level

    def on_shares(self) -> Column:
        cut = float(CUTS[self.share][self.level - 1])
        return shares()[self.share] >= cut if self.upward else shares()[self.share] < cut


@dataclass(frozen=True)
class Rule:
    """A conjunction that rejects, with its rows and bad rows in the pruning part."""

    conditions: tuple[Condition, ...]
    rows: int
    bad: int

    def holds(self) -> Column:
        out = F.lit(True)
        for c in self.conditions:
            out = out & c.on_shares()
        return out


def _all(conditions: tuple[Condition, ...] | list[Condition]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c.on_levels()
    return out


def labelled_counts(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(part, bad, a level for each share, n): labelled rows, equal ones counted.

    A document is bad if any of its labels has quality 0. Labels without id or quality, and rows of
    stats without id, are left out.
    """
    marks = labels.select(F.col("doc_id").alias("_id"), F.col("quality").alias("_q")).dropna()
    marks = marks.groupBy("_id").agg((F.min("_q") == 0).alias("bad"))
    levels = {n: sum((c >= float(x)).cast("int") for x in CUTS[n]).cast("int").alias(n) for n, c in shares().items()}
    rows = stats.select(F.col(f"`{id_col}`").alias("_id"), *levels.values()).join(marks, "_id")
    part = (F.pmod(F.xxhash64("_id"), F.lit(3)) == 0).alias("pruning")
    return rows.groupBy(part, "bad", *CUTS).agg(F.count("*").alias("n"))


def _gain(p0: float, n0: float, p: float, n: float) -> float:
    """Information gain of a condition that leaves p of p0 bad and n of n0 good rows."""
    if p <= 0 or p0 <= 0:
        return 0.0
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0)))


def grow(cells: DataFrame, min_rows: int) -> list[Condition]:
    """Add the condition of most gain until no good row is left or none gains.

    A condition that gains leaves fewer rows, so this ends.
    """
    found: list[Condition] = []
    while True:
        names = ", ".join(f"'{n}', `{n}`" for n in CUTS)
        held = cells.filter(~F.col("pruning") & _all(found))
        bins = held.select("bad", "n", F.expr(f"stack({len(CUTS)}, {names}) as (share, level)"))
        counts = {
            (r["share"], r["level"]): (r["p"], r["q"])
            for r in bins.groupBy("share", "level").agg(
                F.sum(F.when(F.col("bad"), F.col("n")).otherwise(0)).alias("p"),
                F.sum(F.when(F.col("bad"), 0).otherwise(F.col("n"))).alias("q"),
            ).collect()
        }
        share = next(iter(CUTS))
        p0 = sum(v[0] for (s, _), v in counts.items() if s == share)
        n0 = sum(v[1] for (s, _), v in counts.items() if s == share)
        if n0 == 0 or p0 == 0:
            break
        best, most = None, 1e-9
        for name, cuts in CUTS.items():
            for level in range(1, len(cuts) + 1):
                up = [counts.get((name, b), (0, 0)) for b in range(level, len(cuts) + 1)]
                p, n = sum(x[0] for x in up), sum(x[1] for x in up)
                for upward, pp, nn in ((True, p, n), (False, p0 - p, n0 - n)):
                    if pp >= min_rows and (g := _gain(p0, n0, pp, nn)) > most:
                        best, most = Condition(name, level, upward), g
        if best is None:
            break
        found.append(best)
    return found


def prune(cells: DataFrame, grown: list[Condition]) -> Rule | None:
    """The beginning of the conjunction that is best over the pruning part: (bad - good) / rows."""
    if not grown:
        return None
    sums = []
    for k in range(1, len(grown) + 1):
        fits = _all(grown[:k])
        sums += [
            F.sum(F.when(fits & F.col("bad"), F.col("n")).otherwise(0)).alias(f"p{k}"),
            F.sum(F.when(fits & ~F.col("bad"), F.col("n")).otherwise(0)).alias(f"q{k}"),
        ]
    row = cells.filter("pruning").agg(*sums).first()
    best = None
    for k in range(1, len(grown) + 1):
        p, q = row[f"p{k}"] or 0, row[f"q{k}"] or 0
        worth = (p - q) / (p + q) if p + q else -1.0
        if best is None or worth > best[0]:
            best = (worth, Rule(tuple(grown[:k]), p + q, p))
    return best[1]


def learn(counts: DataFrame, min_rows: int = 3, min_precision: float = 0.95) -> list[Rule]:
    """Rules in order; each was learned from the rows that no earlier one covers, as many as it takes.

    Learning ends with the first rule that has fewer than min_rows bad rows, or a smaller share of
    them than min_precision, in the pruning part. Without labels or bad rows there is no rule.
    """
    cells, rules = counts, []
    while True:
        rule = prune(cells, grow(cells, min_rows))
        if rule is None or rule.bad < min_rows or rule.bad < min_precision * rule.rows:
            break
        rules.append(rule)
        cells = cells.filter(~_all(rule.conditions))
    return rules


def decision(rules: list[Rule]) -> Column:
    """The decision list: the number of the first rule that holds, or null for none."""
    if not rules:
        return F.lit(None).cast("int")
    out = F.when(rules[0].holds(), 1)
    for k, rule in enumerate(rules[1:], 2):
        out = out.when(rule.holds(), k)
    return out.cast("int")


def judged(stats: DataFrame, rules: list[Rule]) -> DataFrame:
    """stats with base_failed, rule (the first that rejects, or null) and kept."""
    return stats.withColumn("base_failed", base_failed()).withColumn("rule", decision(rules)).withColumn(
        "kept", ~F.col("base_failed") & F.col("rule").isNull()
    )


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text") -> tuple[DataFrame, list[Rule]]:
    """(stored statistics by id, rules). Every document is measured, every labelled one learned from.

    Empty tables give no rule, repeated rows count as often as they occur, and columns other than
    the two named are not read.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias(id_col), F.col(f"`{text}`").alias("text"))
    stats = stored(statistics(rows).drop("text"), "quality")
    counts = stored(labelled_counts(stats, labels, id_col), "quality-counts")
    return stats, learn(counts)
