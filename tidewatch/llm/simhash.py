"""SimHash fingerprints of documents, and a search within a Hamming radius by permuted block tables.

A text's terms are its words and its pairs of neighbouring words. Each distinct term is hashed, and
each bit of the hash votes for or against that bit of the fingerprint, with the weight of its kind
times the root of its count. Weights are whole numbers, so equal texts have equal fingerprints.

The search cuts fingerprints into radius + g blocks. Two of them within the radius differ in at most
radius blocks, so they agree on g: a table for each choice of g blocks, permuted to the front as its
key, finds every such pair. g is the least with which a key has as many bits as the rows need.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.shared import fresh, maybe_broadcast, stored
from tidewatch.llm.textops import blocks, mix, word_hashes

BITS, RADIUS = 256, 8
#: Weight of a term by its words, in units of 1/256.
WEIGHTS = {1: 128, 2: 256}
#: Fingerprints of one key that meet in one task; a larger bucket is dealt over several.
BUCKET = 2_000
#: Bits that a key may have fewer than the number of rows has.
SLACK_BITS = 4
#: Bytes of text whose fingerprints are made at once.
BLOCK_BYTES = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)
_SIGNS = (((np.arange(256)[:, None] >> np.arange(8)) & 1) * 2 - 1).astype(np.float64)
_BIT_COUNT = np.array([bin(k).count("1") for k in range(256)])
WORDS = BITS // 64
_SEEDS = _BASE * np.arange(1, WORDS + 1, dtype=np.uint64)


def _terms(words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, hash, weight) of each distinct term of a block of documents."""
    of = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    found = []
    for width, weight in WEIGHTS.items():
        full = max(0, len(words) - width + 1)
        term, doc = words[:full], of[:full]
        for k in range(1, width):
            term = mix(term * _BASE + words[k : full + k])
        inside = doc == of[width - 1 :] if full else np.zeros(0, dtype=bool)
        term, doc = mix(term[inside] + np.uint64(width)), doc[inside]
        order = np.lexsort((term, doc))
        term, doc = term[order], doc[order]
        head = np.ones(len(term), dtype=bool)
        head[1:] = (term[1:] != term[:-1]) | (doc[1:] != doc[:-1])
        first = np.flatnonzero(head)
        count = np.diff(np.append(first, len(term)))
        found.append((doc[first], term[first], np.rint(weight * np.sqrt(count))))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def fingerprints(texts: pa.Array) -> np.ndarray:
    """A row of BITS / 8 bytes for each text; all zero without words. A null is an empty text."""
    out = [np.zeros((0, BITS // 8), dtype=np.uint8)]
    for _, data, offsets in blocks(texts):
        n = len(offsets) - 1
        doc, term, weight = _terms(*word_hashes(data, offsets))
        bits = []
        for word in range(WORDS):
            hashed = mix(term + _SEEDS[word]).astype("<u8").view(np.uint8).reshape(-1, 8)
            for place in range(8):
                # Votes by the value of one byte of the hash, then by its bits.
                by_value = np.bincount(doc * 256 + hashed[:, place], weights=weight, minlength=n * 256).reshape(n, 256)
                bits.append(by_value @ _SIGNS > 0)
        out.append(np.packbits(np.concatenate(bits, axis=1), axis=1))
    return np.concatenate(out)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The share of equal bits."""
    return 1 - _BIT_COUNT[a ^ b].sum(axis=1) / BITS


def edited(text: str, following: str) -> str:
    """The last half of the code points replaced by as many of the next text's first."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


SCHEMA = (
    "edge string, part int, doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string,"
    " near_edited double, near_next double, text string"
)
_NAMES = [c.split()[0] for c in SCHEMA.split(", ")]
_TYPES = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.string()]


def _hex(prints: np.ndarray) -> list[str]:
    return [p.tobytes().hex() for p in prints]


def _large(texts: list[str]) -> pa.Array:
    return pa.array(texts, pa.large_string())


def _compared(ids: list, texts: list[str], prints: np.ndarray, following: list[str], next_prints: np.ndarray) -> pa.RecordBatch:
    """Finished rows of SCHEMA."""
    changed = [edited(t, f) for t, f in zip(texts, following, strict=True)]
    changed_prints = fingerprints(_large(changed))
    columns = [
        [None] * len(ids), [None] * len(ids), ids, [len(t) for t in texts], [hashlib.sha256(c.encode()).hexdigest() for c in changed],
        _hex(prints), _hex(changed_prints), likeness(prints, changed_prints), likeness(prints, next_prints), [None] * len(ids),
    ]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True)], names=_NAMES)


def _edge(kind: str, part: int, doc_id: int | None, text: str) -> pa.RecordBatch:
    row = [kind, part, doc_id, None, None, None, None, None, None, text]
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, _TYPES, strict=True)], names=_NAMES)


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[list, list[str]]]:
    """(ids, texts) of some neighbouring rows at a time."""
    ids, texts, size = [], [], 0
    for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
        text = text.as_py()
        ids.append(doc_id)
        texts.append(text)
        size += len(text)
        if size >= BLOCK_BYTES:
            yield ids, texts
            ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one range partition: all but the last are finished; both ends go out with their texts."""
    part = TaskContext.get().partitionId()
    held: tuple | None = None  # the last row so far, its text and fingerprint
    for batch in batches:
        for ids, texts in _runs(batch):
            prints = fingerprints(_large(texts))
            if held is None:
                yield _edge("first", part, ids[0], texts[0])
            else:
                ids, texts, prints = [held[0], *ids], [held[1], *texts], np.concatenate((held[2], prints))
            held = (ids[-1], texts[-1], prints[-1:])
            if len(ids) > 1:
                yield _compared(ids[:-1], texts[:-1], prints[:-1], texts[1:], prints[1:])
    if held is not None:
        yield _edge("last", part, held[0], held[1])


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, following = batch.column("text").to_pylist(), batch.column("following").to_pylist()
        yield _compared(batch.column("doc_id").to_pylist(), texts, fingerprints(_large(texts)), following, fingerprints(_large(following)))


def compared_with_next(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    Rows are ordered by id, null ids first, and by text where ids are equal; the first follows the
    last. The texts are shuffled once, into ranges of ids; a range's last row meets the first of the
    next range in a join of one row a range. A null text is empty. Other columns are not read. An
    empty table gives no row.
    """
    rows = fresh(docs, {id_col: "doc_id", text: "text"}).select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    found = stored(ordered.mapInArrow(_in_order, SCHEMA), "simhash-rows")
    first = found.filter("edge = 'first'").select("part", F.col("text").alias("following"))
    last = found.filter("edge = 'last'").select("part", "doc_id", "text")
    order = Window.orderBy("part")  # one number for each range partition
    parts = first.select("part").withColumn("next", F.lead("part").over(order))
    parts = parts.withColumn("next", F.coalesce("next", F.min("part").over(Window.partitionBy())))
    ends = last.join(parts, "part").drop("part").join(first, F.col("next") == F.col("part")).select("doc_id", "text", "following")
    done = found.filter("edge IS NULL").unionByName(ends.mapInArrow(_joined, SCHEMA))
    return done.drop("edge", "part", "text")


# ---- search -------------------------------------------------------------------------------------------


def block_tables(rows: int, radius: int = RADIUS) -> list[list[tuple[int, int]]]:
    """For each table the blocks (first bit, end) of its key.

    Larger tables get longer keys; with any g every pair within the radius shares a key of some table.
    """
    need = max(1.0, math.log2(max(rows, 2)) - SLACK_BITS)
    g = 1
    while g * BITS / (radius + g) < need and radius + g < BITS:
        g += 1
    edges = [BITS * k // (radius + g) for k in range(radius + g + 1)]
    return [[(edges[b], edges[b + 1]) for b in chosen] for chosen in combinations(range(radius + g), g)]


def _keys(tables: list[list[tuple[int, int]]]):
    """A column function: the key of a hex fingerprint in each table, as 64-bit hashes of the permuted blocks."""

    @F.pandas_udf("array<bigint>")
    def keys(prints: pd.Series) -> pd.Series:
        raw = np.frombuffer(bytes.fromhex("".join(prints)), dtype=np.uint8).reshape(len(prints), BITS // 8)
        bits = np.unpackbits(raw, axis=1)
        out = np.empty((len(prints), len(tables)), dtype=np.int64)
        for k, chosen in enumerate(tables):
            front = np.concatenate([bits[:, a:b] for a, b in chosen], axis=1)
            front = np.packbits(front, axis=1)
            front = np.pad(front, ((0, 0), (0, -front.shape[1] % 8)))
            key = np.zeros(len(prints), dtype=np.uint64)
            for word in np.ascontiguousarray(front).view("<u8").T:
                key = mix(key * _BASE + word)
            out[:, k] = key.view(np.int64)
        return pd.Series(list(out))

    return keys


def _words(print_col: str) -> list[Column]:
    """A hex fingerprint's 64-bit words."""
    part = [F.conv(F.substring(print_col, 16 * k + 1, 8), 16, 10).cast("long") for k in range(WORDS)]
    rest = [F.conv(F.substring(print_col, 16 * k + 9, 8), 16, 10).cast("long") for k in range(WORDS)]
    return [F.shiftleft(a, 32).bitwiseOR(b) for a, b in zip(part, rest, strict=True)]


def within_radius(prints: DataFrame, queries: Column, radius: int = RADIUS) -> DataFrame:
    """For each fingerprint of a query row, n_near: the rows of all of `prints` (fingerprint, ...) within the radius.

    Equal fingerprints are one entry with its number of rows. A bucket of more than BUCKET entries is
    dealt over several tasks, and the queries of its key go to each of them, so no task meets all
    pairs of a group; a pair counts in the first table in which it agrees.
    """
    entries = stored(
        prints.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n"), F.max(F.coalesce(queries, F.lit(False))).alias("asked")), "simhash-entries")
    tables = block_tables(entries.count(), radius)
    wide = entries.select("n", "asked", "fingerprint", F.array(*_words("fingerprint")).alias("words"), _keys(tables)("fingerprint").alias("keys"))
    wide = stored(wide, "simhash-keys")
    dealt = wide.select("*", F.posexplode("keys").alias("table", "key"))
    large = stored(
        dealt.groupBy("table", "key").count().filter(F.col("count") > BUCKET)
        .select("table", "key", F.ceil(F.col("count") / BUCKET).cast("int").alias("deals")), "simhash-large")
    dealt = dealt.join(maybe_broadcast(large), ["table", "key"], "left").withColumn("deals", F.coalesce("deals", F.lit(1)))
    records = dealt.select("table", "key", "n", F.col("words").alias("r_words"), F.col("keys").alias("r_keys"), F.expr("pmod(xxhash64(words), deals)").cast("int").alias("deal"))
    asked = dealt.filter("asked").select("table", "key", "fingerprint", "words", "keys", F.explode(F.expr("sequence(0, deals - 1)")).alias("deal"))
    met = asked.join(records, ["table", "key", "deal"])
    differ = sum((F.bit_count(F.col("words")[k].bitwiseXOR(F.col("r_words")[k])) for k in range(1, WORDS)),
                 F.bit_count(F.col("words")[0].bitwiseXOR(F.col("r_words")[0])))
    first = F.expr("NOT exists(zip_with(slice(keys, 1, table), slice(r_keys, 1, table), (a, b) -> a = b), same -> same)")
    return met.filter(differ <= radius).filter(first).groupBy("fingerprint").agg(F.sum("n").alias("n_near"))


def near_documents(prints: DataFrame, radius: int = RADIUS, every: int = 20) -> DataFrame:
    """`prints` (doc_id, fingerprint, ...) with n_near: other rows within the radius, for ids divisible by `every`, else null."""
    asked = F.pmod(F.col("doc_id"), F.lit(every)) == 0
    found = stored(within_radius(prints, asked, radius), "simhash-near")
    joined = prints.join(maybe_broadcast(found), "fingerprint", "left")
    return joined.withColumn("n_near", F.when(asked, F.col("n_near") - 1))
