"""Order-preserving packing of token streams by dynamic programming.

Documents in id order are one stream of tokens; a window is at most `size` of them. Windows are cut
at ends of documents, ends of sentences and, in sentences longer than MAX_GAP, every MAX_GAP tokens.
The cuts minimise padding plus a penalty for each cut that does not end a document:

    best[j] = size - place[j] + penalty[j] + min(best[i] + place[i]),  place[j] - place[i] <= size

The minimum over the sliding range of i is the head of a monotone queue, so a cut point costs
constant time. Range partitions of the ids are packed on their own and in order, and a partition is
solved SEGMENT tokens at a time: all windows but the last REDONE of a segment are then fixed, so the
cost is least within a segment, and next to least over several.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.tokens import encoder

SIZE = 2048
#: What a cut inside a document costs, in tokens of padding: after a sentence, and within a long one.
SENTENCE_PENALTY, INNER_PENALTY = 8, 64
#: Tokens without a sentence end after which a window may be cut all the same.
MAX_GAP = 256
#: Tokens that are solved at once, and windows at their end that are solved again with what follows.
SEGMENT, REDONE = 1 << 20, 8

SCHEMA = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


def cut_points(sentence_ends: np.ndarray, doc_ends: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, penalties) in ascending order; both inputs are ascending, doc_ends ends with the stream."""
    gap = min(MAX_GAP, size)
    natural = np.union1d(sentence_ends, doc_ends)
    before = np.concatenate(([0], natural[:-1]))
    extra = np.maximum(0, (natural - before - 1) // gap)
    step = np.arange(extra.sum()) - np.repeat(np.cumsum(extra) - extra, extra) + 1
    inner = np.repeat(before, extra) + step * gap
    places = np.concatenate((natural, inner))
    costs = np.concatenate((np.where(np.isin(natural, doc_ends), 0, SENTENCE_PENALTY), np.full(len(inner), INNER_PENALTY)))
    order = np.argsort(places, kind="stable")
    return places[order], costs[order]


def best_cuts(places: np.ndarray, penalties: np.ndarray, size: int) -> list[int]:
    """The places at which windows end, the last place included, at least cost."""
    at = [0, *places.tolist()]
    costs = [0, *penalties.tolist()]
    reach, back = [0] * len(at), [0] * len(at)
    queue = deque([0])
    for j in range(1, len(at)):
        place = at[j]
        while place - at[queue[0]] > size:
            queue.popleft()
        back[j] = queue[0]
        reach[j] = value = reach[queue[0]] + size + costs[j]
        while queue and reach[queue[-1]] > value:
            queue.pop()
        queue.append(j)
    out, j = [], len(at) - 1
    while j:
        out.append(at[j])
        j = back[j]
    return out[::-1]


class Packer:
    """Takes documents one by one and gives the rows of finished windows."""

    def __init__(self, sentence_end: np.ndarray, size: int, first_sequence: int):
        self.sentence_end, self.size, self.sequence = sentence_end, size, first_sequence
        self.docs: list[tuple[int | None, np.ndarray, int]] = []  # id, ids, tokens that are already out
        self.waiting = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> list[tuple]:
        self.docs.append((doc_id, ids, 0))
        self.waiting += len(ids)
        return self.solve(last=False) if self.waiting >= SEGMENT else []

    def solve(self, last: bool) -> list[tuple]:
        """Rows of the best windows; unless it is the last call, some windows stay for the next."""
        if not self.docs:
            return []
        parts = [ids[done:] for _, ids, done in self.docs]
        flat = np.concatenate(parts)
        doc_ends = np.cumsum([len(p) for p in parts])
        cuts = best_cuts(*cut_points(np.flatnonzero(self.sentence_end[flat]) + 1, doc_ends, self.size), self.size)
        if not last:
            cuts = cuts[:-REDONE]
        rows, begin, d = [], 0, 0
        starts = doc_ends - [len(p) for p in parts]
        for end in cuts:
            at = begin
            while at < end:
                doc_id, ids, done = self.docs[d]
                upto = min(end, int(doc_ends[d]))
                first, length = done + at - int(starts[d]), upto - at
                crc = zlib.crc32(flat[at:upto].astype("<u4").tobytes())
                rows.append((doc_id, first, length, crc, len(ids), self.sequence, at - begin))
                at = upto
                d += upto == doc_ends[d]
            begin = end
            self.sequence += 1
        left = self.docs[d:]
        if left:
            doc_id, ids, done = left[0]
            left[0] = (doc_id, ids, done + begin - int(starts[d]))
        self.docs, self.waiting = left, len(flat) - begin
        return rows


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    columns = zip(*rows, strict=True) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)


def pack(docs: DataFrame, id_col: str = "doc_id", text: str = "text", size: int = SIZE, end_id: int = 1, tokenizer: str | None = None) -> DataFrame:
    """A row for each piece of a document in a window, as in SCHEMA.

    Every document's ids, and end_id behind them, lie in pieces in order; offset is a piece's place
    in its window. A null or empty text is its end_id alone. Null ids come first; rows that share an
    id are documents of their own, ordered by text. A window is shorter than size by little, save the
    last one of a partition. Other columns are not read. An empty table gives no row.
    """
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer)
        ends = np.array([t[-1:] in ".!?" or "Ċ" in t for t in coder.names()])
        packer = Packer(ends, size, TaskContext.get().partitionId() << 40)
        for batch in batches:
            out = []
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), coder.encode(batch.column("text")), strict=True):
                out += packer.add(doc_id, np.append(ids, np.uint32(end_id)))
            yield _batch(out)
        yield _batch(packer.solve(last=True))

    return rows.mapInArrow(run, SCHEMA)
