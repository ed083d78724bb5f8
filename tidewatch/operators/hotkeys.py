"""Finding the keys that hold too many rows for one task, and cutting them into time buckets.

Hotness only decides how work is laid out, never what is computed: every operator gives the same
answer for a split and an unsplit key. So the search may read a hash sample, and a key it misses
is merely slower.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOUR = 3_600_000_000

#: Above this many rows a key is split: well within what one task sorts, or slides over in Python.
MIN_ROWS = 1_000_000
#: The search looks at one row in this many.
ONE_IN = 64
#: At most this many keys are listed, the largest ones. One that is not among them stays whole, in one
#: task, and holds less than one part in MAX_KEYS of all rows.
MAX_KEYS = 5_000


@dataclass(frozen=True)
class Split:
    """Rows of the listed key values are laid out in time buckets of ``grain`` microseconds."""

    column: str
    values: tuple[str, ...]
    grain: int = HOUR

    def hot(self) -> Column:
        return F.coalesce(F.col(self.column).cast("string").isin(list(self.values)), F.lit(False))

    def bucket(self, at: Column) -> Column:
        return F.when(self.hot(), F.floor(at / F.lit(self.grain))).otherwise(F.lit(0)).cast("long")


class HotKeys:
    """The hot values of each column, found once and handed to the operators."""

    def __init__(self, found: dict[str, tuple[str, ...]] | None = None, grain: int = HOUR):
        self.found = found or {}
        self.grain = grain

    def split(self, column: str) -> Split | None:
        values = self.found.get(column, ())
        return Split(column, values, self.grain) if values else None

    def __bool__(self) -> bool:
        return any(self.found.values())


def find_hot_keys(
    df: DataFrame,
    columns: list[str],
    sample_by: str,
    *,
    min_rows: int = MIN_ROWS,
    one_in: int = ONE_IN,
    grain: int = HOUR,
) -> HotKeys:
    """One narrow pass over all columns; the answer is at most MAX_KEYS values by construction."""
    pairs = F.explode(
        F.array(
            *[F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v")) for c in columns]
        )
    ).alias("p")
    rows = (
        df.filter(F.pmod(F.xxhash64(F.col(sample_by)), F.lit(one_in)) == 0)
        .select(pairs)
        .filter(F.col("p.v").isNotNull())
        .groupBy("p.c", "p.v")
        .count()
        .filter(F.col("count") * one_in >= min_rows)
        .orderBy(F.desc("count"))
        .limit(MAX_KEYS)
        .collect()
    )
    found: dict[str, list[str]] = {}
    for row in rows:
        found.setdefault(row["c"], []).append(row["v"])
    return HotKeys({c: tuple(sorted(v)) for c, v in found.items()}, grain)
