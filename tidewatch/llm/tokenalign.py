"""Alignment of two tokenizers over the same bytes, by as-of merges keyed by document.

A's tokens and B's tokens both cover the bytes of a space and the text. In a batch the starts of all
tokens are one ascending column, keyed by document. An as-of merge gives each token start the token
of the other side that covers it; the union of both directions is the pairs that overlap, and where
tokens of both sides end at one byte a group ends.

How often a pair of ids is linked is counted over the corpus. The most frequent pairs, a fixed number
of them, are broadcast to the documents' pairs; all others meet their counts in a shuffle.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.shared import fresh, stored, worker_cache
from tidewatch.llm.tokens import SPELLING

A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Bytes of text that are aligned at once; a longer text is a block of its own.
BLOCK_BYTES = 1 << 20
#: Pairs of ids that are broadcast with their counts, the most frequent ones.
FREQUENT = 400_000
SPACE = "▁"

SCHEMA = (
    "row bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string,"
    " pairs array<bigint>, times array<bigint>"
)


class Sides:
    """Both tokenizers of a Python worker, and the bytes of every id.

    A's vocabulary is read from its JSON file, where an id is also the rank of its merge, as the
    byte-level encoder needs it; without special tokens, so that their strings are text.
    """

    def __init__(self, a_path: str, b_path: str):
        byte_of = {c: b for b, c in SPELLING.items()}
        with open(a_path, encoding="utf-8") as file:
            state = json.load(file)
        special = {t["content"] for t in state["added_tokens"] if t["special"]}
        ranks = {bytes(byte_of[c] for c in t): k for t, k in state["model"]["vocab"].items() if t not in special}
        self.a = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a_bytes = [b""] * (max(ranks.values()) + 1)
        for token, k in ranks.items():
            self.a_bytes[k] = token
        self.b_bytes = [
            bytes([int(p[1:-1], 16)]) if self.b.is_byte(k) else p.replace(SPACE, " ").encode()
            for k, p in ((k, self.b.id_to_piece(k)) for k in range(self.b.vocab_size()))
        ]
        #: No piece joins two words, so words are encoded one by one.
        self.splits = not any(SPACE in p[1:] and p.strip(SPACE) for p in map(self.b.id_to_piece, range(self.b.vocab_size())))
        self.a_size = np.array([len(t) for t in self.a_bytes], dtype=np.int64)
        self.b_size = np.array([len(t) for t in self.b_bytes], dtype=np.int64)
        top = max(len(self.a_bytes), len(self.b_bytes))
        #: The decimal of id k with a mark behind it stands at k, k + top and k + 2 * top.
        self.top, self.names = top, [f"{k}{mark}" for mark in ",|;" for k in range(top)]

    def _checked(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """B's ids of all texts in a row and how many each has: 0 where they do not give it back byte by byte."""
        found = self.b.encode(texts, num_threads=1)
        flat = list(chain.from_iterable(found))
        if b"".join(map(self.b_bytes.__getitem__, flat)) != "".join([" " + t for t in texts]).encode():
            for k, text in enumerate(texts):
                if b"".join(map(self.b_bytes.__getitem__, found[k])) != b" " + text.encode():
                    found[k] = []
            flat = list(chain.from_iterable(found))
        return np.array(flat, dtype=np.int64), np.fromiter(map(len, found), dtype=np.int64, count=len(found))

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        flat, size = self._checked(texts)
        end = np.cumsum(size)
        return [flat[i:j] for i, j in zip(end - size, end, strict=True)]

    def _by_words(self, texts: list[str]) -> list[np.ndarray]:
        """The same for texts with single spaces between words only: each distinct word of them is encoded once."""
        cut = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        coded = cut.flatten().dictionary_encode()
        flat, size = self._checked(coded.dictionary.to_pylist())
        start = np.cumsum(size) - size
        word = np.asarray(coded.indices)
        length = size[word]
        end = np.concatenate(([0], np.cumsum(length)))
        ids = flat[np.repeat(start[word] - end[:-1], length) + np.arange(end[-1])]
        bounds = np.asarray(cut.offsets)
        lost = np.add.reduceat(length == 0, bounds[:-1]) > 0
        return [ids[end[i] : end[j]] if ok else ids[:0] for i, j, ok in zip(bounds[:-1], bounds[1:], ~lost, strict=True)]

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of each text by A and B, none for a text that either side does not give back byte by byte.

        A's tokens are pieces of the text's own bytes, so as many bytes are the same bytes.
        """
        none = np.zeros(0, dtype=np.int64)
        a_ids = [self.a.encode_to_numpy(" " + t).astype(np.int64) if t else none for t in texts]
        simple = [k for k, t in enumerate(texts) if self.splits and t and t[0] != " " and t[-1] != " " and "  " not in t and SPACE not in t]
        odd = sorted(set(range(len(texts))) - set(simple))
        b_ids = [none] * len(texts)
        for chosen, encoded in ((simple, self._by_words), (odd, self._whole)):
            if chosen:
                for k, ids in zip(chosen, encoded([texts[k] for k in chosen]), strict=True):
                    b_ids[k] = ids
        for k, text in enumerate(texts):
            if not len(b_ids[k]) or self.a_size[a_ids[k]].sum() != len(text.encode()) + 1:
                a_ids[k] = b_ids[k] = none
        return a_ids, b_ids


def sides(a_path: str | None, b_path: str | None) -> Sides:
    """One pair of tokenizers a Python process and paths."""
    paths = (a_path or public_tokenizers.path(A_FILE), b_path or public_tokenizers.path(B_FILE))
    known = worker_cache("sides")
    if paths not in known:
        known[paths] = Sides(*paths)
    return known[paths]


def _tokens(ids: list[np.ndarray], size: np.ndarray) -> pd.DataFrame:
    """A row a token: doc, id, and its bytes [at, end) where all documents of the batch lie back to back."""
    flat = np.concatenate(ids)
    length = size[flat]
    end = np.cumsum(length)
    return pd.DataFrame({"at": end - length, "doc": np.repeat(np.arange(len(ids)), [len(x) for x in ids]), "id": flat, "end": end})


def overlaps(a: pd.DataFrame, b: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(rows of a, rows of b) of every pair of tokens that overlap: each start with the token that covers it."""
    right_a = a[["at", "doc"]].assign(row=np.arange(len(a)))
    right_b = b[["at", "doc"]].assign(row=np.arange(len(b)))
    over_a = pd.merge_asof(a[["at", "doc"]], right_b, on="at", by="doc")["row"].to_numpy()
    over_b = pd.merge_asof(b[["at", "doc"]], right_a, on="at", by="doc")["row"].to_numpy()
    new = np.flatnonzero(a["at"].to_numpy()[over_b] != b["at"].to_numpy())  # equal starts were found from the other side
    return np.concatenate((np.arange(len(a)), over_b[new])), np.concatenate((over_a, new))


def _spelled(a: pd.DataFrame, b: pd.DataFrame, last_a: np.ndarray, last_b: np.ndarray, docs: int, both: Sides) -> list[str]:
    """Each document's groups as `a1,a2|b1;a3|b2,b3`; last_a, last_b: the rows that end a group.

    A's and B's ids of a group are placed one behind the other.
    """
    ends_a, ends_b = np.zeros(len(a), dtype=np.int64), np.zeros(len(b), dtype=np.int64)
    ends_a[last_a] = ends_b[last_b] = 1
    group_a, group_b = np.cumsum(ends_a) - ends_a, np.cumsum(ends_b) - ends_b
    code = np.empty(len(a) + len(b), dtype=np.int64)
    before_b = np.concatenate(([0], last_b + 1))[group_a]
    code[np.arange(len(a)) + before_b] = a["id"].to_numpy() + both.top * ends_a
    code[np.arange(len(b)) + (last_a + 1)[group_b]] = b["id"].to_numpy() + 2 * both.top * ends_b
    per_doc = np.bincount(a["doc"], minlength=docs) + np.bincount(b["doc"], minlength=docs)
    edges = np.concatenate(([0], np.cumsum(per_doc)))
    names = both.names
    return ["".join([names[c] for c in code[i:j].tolist()])[:-1] for i, j in zip(edges[:-1], edges[1:], strict=True)]


def align(texts: list[str], both: Sides) -> dict[str, list]:
    """Columns of SCHEMA from n_a on, for a block of texts."""
    n = len(texts)
    a_ids, b_ids = both.encode(texts)
    a, b = _tokens(a_ids, both.a_size), _tokens(b_ids, both.b_size)
    _, last_a, last_b = np.intersect1d(a["end"], b["end"], assume_unique=True, return_indices=True)
    link_a, link_b = overlaps(a, b)
    link_doc = a["doc"].to_numpy()[link_a]
    pair = a["id"].to_numpy()[link_a] * len(both.b_bytes) + b["id"].to_numpy()[link_b]
    # One number of the document and the pair, so that one sort puts equal links side by side.
    bits = (len(both.a_bytes) * len(both.b_bytes)).bit_length()
    cells, times = np.unique(link_doc << bits | pair, return_counts=True)
    edges = np.concatenate(([0], np.cumsum(np.bincount(cells >> bits, minlength=n))))
    longs = pa.int64()
    spelled = _spelled(a, b, last_a, last_b, n, both)
    return {
        "n_a": pa.array([len(x) for x in a_ids], longs), "n_b": pa.array([len(x) for x in b_ids], longs),
        "n_groups": pa.array(np.bincount(a["doc"].to_numpy()[last_a], minlength=n), longs),
        "n_links": pa.array(np.bincount(link_doc, minlength=n), longs),
        "groups_sha256": pa.array([hashlib.sha256(s.encode()).hexdigest() if s else "" for s in spelled]),
        "pairs": pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(cells & ((1 << bits) - 1), longs)),
        "times": pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(times, longs)),
    }


def aligned(docs: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """SCHEMA for every row (doc_id, text); row is unique, pairs are a * (size of B's vocabulary) + b, once each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, row = sides(a_path, b_path), TaskContext.get().partitionId() << 40
        for batch in batches:
            texts, ids = batch.column("text").fill_null(""), batch.column("doc_id")
            ends = np.cumsum(np.asarray(pc.binary_length(texts)), dtype=np.int64)
            first = 0
            while first < len(texts):
                before = ends[first - 1] if first else 0
                last = max(first + 1, int(np.searchsorted(ends, before + BLOCK_BYTES, side="right")))
                found = align(texts.slice(first, last - first).to_pylist(), both)
                found = {"row": pa.array(np.arange(row, row + last - first)), "doc_id": ids.slice(first, last - first)} | found
                yield pa.RecordBatch.from_arrays(list(found.values()), names=list(found))
                row, first = row + last - first, last

    return docs.mapInArrow(run, SCHEMA)


def pair_counts(cells: DataFrame, b_size: int) -> DataFrame:
    """(pair, count, best): links of each pair over the corpus; best: no pair of its B id has more.

    There are no more pairs than A has ids times B has, and a B id has no more than A has ids.
    """
    counts = stored(cells.groupBy("pair").agg(F.sum("times").alias("count")), "align-counts")
    most = counts.groupBy((F.col("pair") % b_size).alias("b")).agg(F.max("count").alias("most"))
    joined = counts.withColumn("b", F.col("pair") % b_size).join(most, "b")
    return joined.select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def align_tokenizers(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", a_path: str | None = None, b_path: str | None = None, frequent: int = FREQUENT
) -> DataFrame:
    """Per row: doc_id, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum.

    A null or empty text, or one that a tokenizer does not give back byte by byte, has no tokens:
    zeros, and an empty groups_sha256. Rows that share an id, or have none, are rows of their own.
    Other columns are not read. An empty table gives no row.
    """
    rows = fresh(docs, {id_col: "doc_id", text: "text"}).withColumn("doc_id", F.col("doc_id").cast("long"))
    found = stored(aligned(rows, a_path, b_path), "align-docs")
    cells = found.select("row", F.inline(F.arrays_zip(F.col("pairs").alias("pair"), F.col("times").alias("times"))))
    b_size = sentencepiece.SentencePieceProcessor(model_file=b_path or public_tokenizers.path(B_FILE)).vocab_size()
    counts = stored(pair_counts(cells, b_size), "align-best")
    gain = [F.sum(F.col("times") * F.col("count")).alias("count_sum"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best")]
    if counts.count() <= frequent:
        sums = cells.join(F.broadcast(counts), "pair").groupBy("row").agg(*gain)
    else:
        common = stored(counts.orderBy(F.desc("count"), "pair").limit(frequent), "align-frequent")
        rare = counts.join(F.broadcast(common.select("pair")), "pair", "left_anti")
        often = cells.join(F.broadcast(common), "pair").groupBy("row").agg(*gain)
        seldom = cells.join(F.broadcast(common.select("pair")), "pair", "left_anti").join(rare, "pair").groupBy("row").agg(*gain)
        sums = often.unionByName(seldom).groupBy("row").agg(F.sum("count_sum").alias("count_sum"), F.sum("n_best").alias("n_best"))
    joined = found.drop("pairs", "times").join(sums, "row", "left")
    zero = F.lit(0).cast("long")
    return joined.select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256",
        F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"),
    )
