"""Token ids on disk: one zstandard frame a document, a shared dictionary, an offset index.

A store is a folder with two Parquet tables. `dictionary` has one row: the zstandard dictionary, its
SHA-256 and the bytes an id takes. `blocks` has a row for some thousand documents in ascending id
order: `data` is their frames back to back, `offsets` where each begins and the last ends, `doc_ids`
and `lengths` (ids) name them, `first_id` and `last_id` let a reader skip blocks, and `dictionary`
repeats the hash, which a reader compares before it decodes. A document is read alone by its offset.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.llm.shared import arrow_rows, maybe_broadcast
from tidewatch.llm.tokens import encoder

#: The dictionary learns from about so many documents, chosen by a hash of the id, and so many bytes of each.
SAMPLE_DOCS, SAMPLE_BYTES, DICTIONARY_BYTES = 1_000, 8_192, 64 * 1024
BLOCK_DOCS, BLOCK_BYTES = 512, 1 << 20
LEVEL = 3
#: Documents that go to a Python worker at once.
BATCH_ROWS = 1_000

BLOCK_SCHEMA = (
    "shard bigint, first_id bigint, last_id bigint, start bigint, n_tokens bigint, doc_ids array<bigint>,"
    " lengths array<bigint>, offsets array<bigint>, dictionary string, data binary"
)


def train(samples: list[bytes]) -> bytes:
    """A dictionary from serialized id arrays; with too few of them their own bytes, with none an empty one."""
    joined = b"".join(samples)
    if len(joined) < 16 * 1024:
        return joined
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, len(joined) // 4), samples).as_bytes()
    except zstandard.ZstdError:  # the samples are too much alike to train on
        return joined[-DICTIONARY_BYTES:]


def _codec(dictionary: bytes) -> dict:
    return {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}


def sample(docs: DataFrame, dtype: str, tokenizer: str | None) -> list[bytes]:
    """Serialized ids of the sampled documents (doc_id, text): a bounded number of bounded length."""
    share = max(1, docs.count() // SAMPLE_DOCS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [x.astype(dtype).tobytes()[:SAMPLE_BYTES] for x in encoder(tokenizer).encode(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary())], names=["ids"])

    chosen = docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(share)) == 0)
    return [bytes(r[0]) for r in chosen.mapInArrow(run, "ids binary").limit(2 * SAMPLE_DOCS).collect() if r[0]]


def write_ids(
    docs: DataFrame, path: str, id_col: str = "doc_id", text: str = "text", end_id: int | None = 0, tokenizer: str | None = None
) -> None:
    """Encode every text, append end_id, and write the store to a new folder in ascending id order.

    A null text is empty. Null ids come first; rows that share an id stay rows of their own, ordered
    by text. Other columns are not read. An empty table gives a store without blocks.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    dtype = "<u2" if encoder(tokenizer).tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
    dictionary = train(sample(rows, dtype, tokenizer))
    digest = hashlib.sha256(dictionary).hexdigest()
    spark.createDataFrame([(digest, dtype, bytearray(dictionary))], "dictionary string, dtype string, data binary").coalesce(1).write.parquet(
        f"{path}/dictionary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=LEVEL, **_codec(dictionary))
        shard, start = TaskContext.get().partitionId(), 0
        names, lengths, frames, size = [], [], [], 0

        def block() -> pa.RecordBatch:
            offsets = np.concatenate(([0], np.cumsum([len(f) for f in frames]))).tolist()
            known = [n for n in names if n is not None]
            row = {
                "shard": shard, "first_id": min(known, default=None), "last_id": max(known, default=None), "start": start,
                "n_tokens": sum(lengths), "doc_ids": names, "lengths": lengths, "offsets": offsets, "dictionary": digest,
                "data": b"".join(frames),
            }
            longs = pa.list_(pa.int64())
            types = [pa.int64()] * 5 + [longs] * 3 + [pa.string(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row.values(), types, strict=True)], names=list(row))

        for batch in batches:
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encoder(tokenizer).encode(batch.column("text")), strict=True):
                ids = ids if end_id is None else np.append(ids, np.uint32(end_id))
                names.append(doc_id)
                lengths.append(len(ids))
                frames.append(packer.compress(ids.astype(dtype).tobytes()))
                size += len(frames[-1])
                if size >= BLOCK_BYTES or len(names) >= BLOCK_DOCS:
                    yield block()
                    start += sum(lengths)
                    names, lengths, frames, size = [], [], [], 0
        if names:
            yield block()

    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    with arrow_rows(spark, BATCH_ROWS):
        ordered.mapInArrow(run, BLOCK_SCHEMA).write.option("compression", "uncompressed").parquet(f"{path}/blocks")


def read_ids(spark: SparkSession, path: str, only: DataFrame | None = None) -> DataFrame:
    """doc_id, start, n_tokens, ids (packed little-endian unsigned 32-bit) of every document of a store.

    start is the number of ids of all documents before it. With `only` (doc_id) a document is
    decoded only if its id is there; the others' frames are passed over by the offset index.
    """
    found = spark.read.parquet(f"{path}/dictionary").first()
    digest, dtype, dictionary = found["dictionary"], found["dtype"], bytes(found["data"])
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(f"{path}/blocks")
    totals = blocks.groupBy("shard").agg(F.sum("n_tokens").alias("own"))
    before = F.sum("own").over(Window.orderBy("shard")) - F.col("own")  # a row for each range partition
    blocks = blocks.join(totals.select("shard", before.alias("before")), "shard").withColumn("start", F.col("start") + F.col("before"))
    if only is None:
        chosen = blocks.withColumn("wanted", F.lit(None).cast("array<bigint>"))
    else:
        ids = only.select(F.col("doc_id").cast("long").alias("_id")).distinct()
        met = blocks.select("shard", "start", "first_id", "last_id", F.explode("doc_ids").alias("_id")).join(maybe_broadcast(ids), "_id", "left_semi")
        wanted = met.groupBy("shard", "start").agg(F.collect_set("_id").alias("wanted"))
        chosen = blocks.join(wanted, ["shard", "start"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpacker = zstandard.ZstdDecompressor(**_codec(dictionary))
        for batch in batches:
            for block in batch.to_pylist():
                if block["dictionary"] != digest:
                    raise ValueError(f"block of shard {block['shard']} was written with another dictionary")
                names, offsets, data = block["doc_ids"], block["offsets"], block["data"]
                starts = block["start"] + np.concatenate(([0], np.cumsum(block["lengths"])))
                wanted = None if block["wanted"] is None else set(block["wanted"])
                places = [k for k in range(len(names)) if wanted is None or names[k] in wanted]
                ids = [np.frombuffer(unpacker.decompress(data[offsets[k] : offsets[k + 1]]), dtype=dtype).astype("<u4").tobytes() for k in places]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([names[k] for k in places], pa.int64()), pa.array([int(starts[k]) for k in places], pa.int64()),
                     pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())],
                    names=["doc_id", "start", "n_tokens", "ids"],
                )

    columns = ["shard", "start", "doc_ids", "lengths", "offsets", "dictionary", "data", "wanted"]
    return chosen.select(*columns).mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids binary")
