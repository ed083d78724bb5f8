"""The registered queries of this subpackage, over whole tables and with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import decontam, idstore, licenses, lines, neardup, packing, pii, prefixtrie, quality, simhash, tokenalign, urls, wordpiece
from tidewatch.llm.oracles import CONVERSATION_TRIE, DECONTAMINATION, LINE_DEDUP, NEAR_DEDUP, URL_FILTERS
from tidewatch.llm.shared import scratch, stored, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

RULES = [
    ("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"), ("block", "net", "/fr/"),
]


def _query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn

    return add


@_query("op1_line_dedup", LINE_DEDUP)
def line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that its source repeats; a passage stays on its source's first page."""
    out = lines.drop_lines(table(spark, sf_dir, "documents"), long_words=lines.LONG_WORDS)
    return out.select("doc_id", "text", "n_lines", "n_dropped")


@_query("op1_passage_dedup")
def passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same under the name it had when op1_line_dedup left passages where they were."""
    return line_dedup(spark, sf_dir)


@_query("op2_minhash_near_dedup", NEAR_DEDUP)
def minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), width=2, percent=80)


@_query("op3_url_filters", URL_FILTERS)
def url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"), RULES)


@_query("op4_token_counts")
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordpiece.token_counts(table(spark, sf_dir, "documents"))


@_query("op5_quality_rules")
def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats, rules = quality.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    base = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule"]
    return quality.judged(stats, rules).select("doc_id", *base)


@_query("op6_benchmark_decontamination", DECONTAMINATION)
def benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@_query("op7_token_id_output")
def token_id_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents, written to a store in the shared folder and read back from it."""
    path = scratch(spark, "id-store")
    idstore.write_ids(table(spark, sf_dir, "documents"), path, end_id=0)
    return idstore.read_ids(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@_query("op8_license_scans")
def license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as files below their source and language."""
    path = F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string"))
    return licenses.scan(table(spark, sf_dir, "documents").withColumn("path", path))


@_query("op9_pii")
def personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(table(spark, sf_dir, "documents"))


@_query("op10_packing")
def packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


@_query("op11_conversation_prefix_trie", CONVERSATION_TRIE)
def conversation_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixtrie.conversation_trie(table(spark, sf_dir, "conversations"))


@_query("op12_document_fingerprints")
def document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints beside those of the edited and the next text; n_near for every twentieth document, against all."""
    prints = stored(simhash.compared_with_next(table(spark, sf_dir, "documents")), "simhash-prints")
    return simhash.near_documents(prints)


@_query("op13_tokenizer_alignment")
def tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenalign.align_tokenizers(table(spark, sf_dir, "documents"))


@_query("pipeline")
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpus_pipeline import run  # that module imports this package

    return run(spark, sf_dir)
