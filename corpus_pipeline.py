"""The corpus pipeline: from raw documents to packed training sequences.

Each stage takes the documents that the one before kept, as it left them, and returns documents; the
last returns the pieces of packed sequences. Stages fit what they need, such as rules, counts and
components, on their own input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import decontam, lines, neardup, packing, quality
from tidewatch.llm.shared import arrow_rows, maybe_broadcast, stored, table

#: Texts that a worker is handed at once for packing.
PACKED_ROWS = 2_000

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base limits nor the learned decision list reject."""
    _, rules = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.judged(quality.statistics(docs), rules).filter("kept").select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their source's boilerplate lines and copied passages; n_chars counts what is left."""
    return lines.drop_lines(docs, long_words=lines.LONG_WORDS).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, the one with the smallest id; without an id it comes last.

    Rows are told apart by a number of their own, so repeated rows and rows without an id are
    documents like any other. Each row is numbered by its place in the files of the stage before.
    """
    rows = docs.withColumn("_row", F.monotonically_increasing_id())
    out = neardup.near_duplicates(rows, id_col="_row", width=5, percent=80).filter("n_shingles > 0").select(
        F.col("doc_id").alias("_row"), "component_id")
    others = stored(out.filter("_row <> component_id"), "others")  # all but the first row of each group
    heads = others.select(F.col("component_id").alias("_row"), "component_id").distinct()
    groups = stored(others.unionByName(heads), "groups")
    placed = groups.join(rows.select("_row", "doc_id"), "_row").select("_row", "component_id", F.struct(F.col("doc_id").isNull(), "doc_id", "_row").alias("place"))
    stay = stored(placed.groupBy("component_id").agg(F.min("place")["_row"].alias("_row")).select("_row"), "stay")
    # By row and not by group, so that a large group is no task's alone.
    copies = groups.select("_row").join(maybe_broadcast(stay), "_row", "left_anti")
    return rows.join(maybe_broadcast(stored(copies, "copies")), "_row", "left_anti").select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark window occurs."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of sequences of at most 2048 tokens, written while batches of texts are small.

    Beside the heap that earlier stages have grown, an executor has no room for texts by the ten thousand,
    which Arrow would hold on both sides of each worker.
    """
    with arrow_rows(spark, PACKED_ROWS):
        return stored(packing.pack(docs), "packing")


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("near dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packed),
]

#: Learned rules and tokenization have no SQL; a brute-force version tests every stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each stage's rows written to the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs, name.replace(" ", "-"))
    return docs
