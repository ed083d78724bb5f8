"""Checking an audit log: hash chains per writer, and the Merkle root of a day's rows."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.operators.hotkeys import Split
from tidewatch.operators.running import Agg, running

GENESIS = "0" * 64

# What a chain check can report.
GAP = "missing row: sequence gap"
WRONG_LINK = "prev_hash does not match the previous row"
WRONG_CONTENT = "row content does not match row_hash"
HEAD_AHEAD = "missing row: chain head is ahead of stored rows"

#: Leaves folded per task; a power of two, so every full block is a complete subtree.
BLOCK = 1024


def chained_hash() -> Column:
    """The hash a row should carry: over the previous row's hash and its own content."""
    return F.sha2(F.concat_ws("|", "prev_hash", "content"), 256)


def verify_chains(
    rows: DataFrame, heads: DataFrame | None = None, recomputed: Column | None = None,
    span: int = 1_000_000,
) -> DataFrame:
    """(writer, checked, first_bad_seq, problem): the first break of each writer's chain, if any.

    A row needs only its predecessor: the running maximum of (seq, hash) before it. The writers are
    few and long, so each is cut into spans of sequence numbers.
    """
    writers = F.lit(0)
    split = Split("__w", ("0",), span)
    told = recomputed if recomputed is not None else chained_hash()
    marked = rows.withColumn("__w", writers).withColumn("__told", told)
    before = running(
        marked, ["writer", "__w"], "seq", {"__before": Agg("max", F.struct("seq", "row_hash"))}, split
    )
    last_seq = F.coalesce(F.col("__before.seq"), F.lit(0))
    last_hash = F.coalesce(F.col("__before.row_hash"), F.lit(GENESIS))
    problem = (
        F.when(F.col("seq") != last_seq + 1, GAP)
        .when(~F.col("prev_hash").eqNullSafe(last_hash), WRONG_LINK)
        .when(F.col("row_hash") != F.col("__told"), WRONG_CONTENT)
    )
    at = F.when(F.col("seq") != last_seq + 1, last_seq + 1).otherwise(F.col("seq"))
    judged = before.select("writer", "seq", problem.alias("problem"), at.alias("at"))
    bad = F.min(F.when(F.col("problem").isNotNull(), F.struct("seq", "at", "problem")))
    out = judged.groupBy("writer").agg(
        F.count("*").alias("rows"), F.max("seq").alias("last"), bad.alias("bad")
    )
    if heads is not None:
        out = out.join(heads.select("writer", "last_seq"), "writer", "full_outer")
        ahead = F.col("bad").isNull() & (F.col("last_seq") > F.coalesce(F.col("last"), F.lit(0)))
    else:
        ahead = F.lit(False)
    checked = F.when(F.col("bad").isNull(), F.coalesce(F.col("rows"), F.lit(0)))
    # Rows before the first bad one are consecutive, or an earlier one would have been bad.
    good = judged.join(out.select("writer", F.col("bad.seq").alias("__bad")), "writer").filter(
        F.col("seq") < F.col("__bad")
    )
    counts = good.groupBy("writer").agg(F.count("*").alias("good"))
    return out.join(counts, "writer", "left").select(
        "writer",
        F.coalesce(checked, F.col("good"), F.lit(0)).alias("checked"),
        F.when(ahead, F.coalesce(F.col("last"), F.lit(0)) + 1).otherwise(F.col("bad.at")).alias("first_bad_seq"),
        F.when(ahead, HEAD_AHEAD).otherwise(F.col("bad.problem")).alias("problem"),
    )


def _node(left: bytes, right: bytes) -> bytes:
    return hashlib.sha256(b"\x01" + left + right).digest()


def _fold(pdf: pd.DataFrame) -> pd.DataFrame:
    level = pdf.sort_values("i")["h"].tolist()
    while len(level) > 1:
        paired = [_node(level[j], level[j + 1]) for j in range(0, len(level) - 1, 2)]
        level = paired + ([level[-1]] if len(level) % 2 else [])
    first = pdf.iloc[0]
    return pd.DataFrame({"day": [first["day"]], "i": [int(first["block"])], "h": [level[0]]})


def merkle_roots(leaves: DataFrame, max_rows: int) -> DataFrame:
    """(day, root) over (day, i, row_hash) with i = 0, 1, ... in order within the day.

    Pairing neighbours level by level, an odd last node moving up as it is, gives the same tree as
    splitting at the largest power of two. Blocks of 1024 aligned leaves are folded at a time, so
    n leaves take log(n) / 10 small shuffles.
    """
    zero = F.lit(bytearray(b"\x00"))
    level = leaves.select(
        "day", F.col("i").cast("long").alias("i"),
        F.unhex(F.sha2(F.concat(zero, F.unhex("row_hash")), 256)).alias("h"),
    )
    schema = f"day {leaves.schema['day'].dataType.simpleString()}, i long, h binary"
    size = max_rows
    while size > 1:
        level = level.withColumn("block", F.expr(f"i div {BLOCK}")).groupBy("day", "block").applyInPandas(
            _fold, schema
        )
        size = -(-size // BLOCK)
    return level.select("day", F.lower(F.hex("h")).alias("root"))
