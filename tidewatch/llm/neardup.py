"""Near-duplicate components by circulant MinHash, banding and exact Jaccard verification.

A document is the set of its word shingles. One permutation sigma scatters the shingles over the
32-bit integers; a second one, pi, gives every signature coordinate: coordinate k is the least
pi(sigma(x) + k * stride), pi being shifted round the circle by k steps. Coordinates are cut into
bands; documents that agree in a whole band are candidates. Equal sets are one class from the start.

Candidates of a band value are not expanded into pairs. First every value's leader, the member that
meets most others, is tested against all of them, and linked ones merge; that settles the copies of
one text, however many. A value whose members are then in several components is laid out in blocks
of bounded size, and every pair of blocks is tested in one task, the members outside the largest
component against all others. So each candidate pair is tested or connected already.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm import textops
from tidewatch.llm.shared import maybe_broadcast, stored

#: 32 bands of 5: a pair at similarity 0.8 escapes all bands with probability 3e-6.
BANDS, ROWS = 32, 5
_STRIDE = 0x9E3779B1
_CHUNK = 1024
#: Documents and shingles of a block of candidates that are tested together, and shingles compared at once.
BLOCK_DOCS, BLOCK_SHINGLES = 1024, 1 << 18
_TOKENS = 2048


def _scatter(x: np.ndarray, c: int) -> np.ndarray:
    """A permutation of the 32-bit integers."""
    x = x ^ (x >> np.uint32(16))
    x = x * np.uint32(c)
    x = x ^ (x >> np.uint32(13))
    x = x * np.uint32(0xC2B2AE35)
    return x ^ (x >> np.uint32(16))


def signature(shingles: np.ndarray, size: int = BANDS * ROWS) -> np.ndarray:
    """The circulant MinHash of one set of 64-bit shingles."""
    start = _scatter((shingles ^ (shingles >> np.uint64(32))).astype(np.uint32), 0x85EBCA6B)
    shifts = (np.arange(1, size + 1, dtype=np.uint64) * np.uint64(_STRIDE)).astype(np.uint32)[:, None]
    least = np.full(size, 0xFFFFFFFF, dtype=np.uint32)
    for a in range(0, len(start), _CHUNK):
        y = start[None, a : a + _CHUNK] + shifts
        t = y >> np.uint32(16)
        np.bitwise_xor(y, t, out=y)
        np.multiply(y, np.uint32(0x21F0AAAD), out=y)
        np.right_shift(y, np.uint32(15), out=t)
        np.bitwise_xor(y, t, out=y)
        np.multiply(y, np.uint32(0x735A2D97), out=y)
        np.right_shift(y, np.uint32(15), out=t)
        np.bitwise_xor(y, t, out=y)
        np.minimum(least, y.min(axis=1), out=least)
    return least


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key for each band, with the band's number in it."""
    key = np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    for part in sig.reshape(bands, rows).T:
        key = textops.mix(key + part.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return key.astype(np.int64)


def sketches(docs: DataFrame, width: int, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """docs (doc_id, text) as doc_id, n, set_a, set_b (a digest of the set) and bands (keys)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text")
            for first, data, offsets in textops.blocks(texts):
                words, bounds = textops.word_hashes(data, offsets)
                n, a, b, keys = [], [], [], []
                for own in textops.shingle_sets(words, bounds, width):
                    n.append(len(own))
                    digest = np.frombuffer(hashlib.blake2b(own.tobytes(), digest_size=16).digest(), dtype=np.int64)
                    a.append(int(digest[0]))
                    b.append(int(digest[1]))
                    keys.append(band_keys(signature(own, bands * rows), bands, rows) if len(own) else None)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(first, len(n)), pa.array(n, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()),
                     pa.array(keys, pa.list_(pa.int64()))],
                    names=["doc_id", "n", "set_a", "set_b", "bands"],
                )

    return docs.mapInArrow(run, "doc_id bigint, n bigint, set_a bigint, set_b bigint, bands array<bigint>")


def shingle_arrays(docs: DataFrame, width: int) -> DataFrame:
    """docs (doc_id, text) as doc_id and its whole set of shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, offsets in textops.blocks(batch.column("text")):
                words, bounds = textops.word_hashes(data, offsets)
                sets = list(textops.shingle_sets(words, bounds, width))
                ends = np.concatenate(([0], np.cumsum([len(x) for x in sets]))).astype(np.int32)
                flat = np.concatenate(sets).astype(np.int64) if sets else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(first, len(sets)), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))],
                    names=["doc_id", "shingles"],
                )

    return docs.mapInArrow(run, "doc_id bigint, shingles array<bigint>")


def _state(edges: DataFrame) -> tuple:
    digest = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    return tuple(edges.agg(F.count("*"), digest).first())


def least_reachable(edges: DataFrame) -> DataFrame:
    """(v, component) for every node of the edges (u, v): the smallest node reachable from it.

    Every node hangs its larger neighbours, then all its neighbours, under the smallest one, until
    no edge moves: logarithmically many rounds. Neighbours are never gathered, only their minimum.
    """
    ordered = edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now = stored(ordered, "edges")
    seen = _state(now)
    while seen[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        hung = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        roots = hung.groupBy("u").agg(F.min("v").alias("m"))
        moved = hung.join(roots, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        now = stored(moved.unionByName(roots.select("u", F.col("m").alias("v"))).select(
            F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
        state = _state(now)
        if state == seen:
            break
        seen = state
    roots = now.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "v")
    return roots.unionByName(roots.select(F.col("component").alias("v"), "component").distinct())


def linked_pairs(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("_x"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("_y"))
    both = F.size(F.array_intersect("_x", "_y"))
    fits = 100 * both >= percent * (F.size("_x") + F.size("_y") - both)
    return pairs.join(left, "a").join(right, "b").filter(fits).select("a", "b")


def _block_links(shingles: list[np.ndarray], components: np.ndarray, blocks: np.ndarray, percent: int) -> Iterator[tuple[int, int]]:
    """Linked pairs (places) of one pair of blocks: of each member and other component one link at most.

    blocks tells the two apart; of two blocks only pairs across are tested, of one all its own.
    """
    names, component = np.unique(components, return_inverse=True)
    outside = np.flatnonzero(component != np.bincount(component).argmax())
    if len(outside) == 0:
        return
    sizes = np.array([len(x) for x in shingles])
    owner = np.repeat(np.arange(len(shingles)), sizes)
    tokens, place = np.unique(np.concatenate(shingles), return_inverse=True)
    seen = np.bincount(place, minlength=len(tokens)) > 1
    column = np.cumsum(seen) - 1
    held = seen[place]
    owner, place = owner[held], column[place[held]]
    common = np.zeros((len(outside), len(shingles)), dtype=np.float32)
    order = np.argsort(place, kind="stable")
    owner, place = owner[order], place[order]
    for first in range(0, int(seen.sum()), _TOKENS):
        a, b = np.searchsorted(place, [first, first + _TOKENS])
        part = np.zeros((len(shingles), _TOKENS), dtype=np.float32)
        part[owner[a:b], place[a:b] - first] = 1
        common += part[outside] @ part.T
    both = common.astype(np.int64)
    linked = 100 * both >= percent * (sizes[outside][:, None] + sizes[None, :] - both)
    linked &= component[outside][:, None] != component[None, :]
    if len(np.unique(blocks)) > 1:
        linked &= blocks[outside][:, None] != blocks[None, :]
    for r, c in zip(*np.nonzero(linked), strict=True):
        yield int(outside[r]), int(c)


def _tested_in_blocks(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(u, v): links between different components of the members (key, doc_id, n, component) of each key.

    A key's members are dealt over blocks by a hash, so many that a block has about BLOCK_DOCS
    documents and BLOCK_SHINGLES shingles at most; each pair of blocks is one group.
    """
    size = F.greatest(F.ceil(F.sum("n") / BLOCK_SHINGLES), F.ceil(F.count("*") / BLOCK_DOCS)).cast("int")
    dealt = members.join(members.groupBy("key").agg(size.alias("parts")), "key")
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select("key", "doc_id", "component", "own", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))

    def run(table: pa.Table) -> pa.Table:
        ids = table.column("doc_id").to_numpy()
        flat = table.column("shingles").combine_chunks()
        offsets = np.asarray(flat.offsets)
        values = np.asarray(flat.values)
        own = [values[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        links = {}
        components = table.column("component").to_numpy()
        for r, c in _block_links(own, components, table.column("own").to_numpy(), percent):
            links.setdefault((r, components[c]), c)
        pairs = [(ids[r], ids[c]) for (r, _), c in links.items()]
        return pa.table({"u": pa.array([p[0] for p in pairs], pa.int64()), "v": pa.array([p[1] for p in pairs], pa.int64())})

    return dealt.join(sets, "doc_id").groupBy("key", "low", "high").applyInArrow(run, "u bigint, v bigint")


def _components(members: DataFrame, sets: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """(v, component) of the members (key, doc_id, n) that have links; known has links (u, v) from the start."""
    busy = members.groupBy("key").agg(F.count("*").alias("c"))
    weight = members.join(busy, "key").groupBy("doc_id").agg(F.sum("c").alias("weight"))
    active = stored(members.join(weight, "doc_id"), "active")
    top = F.max(F.struct("weight", (-F.col("doc_id")).alias("low"), "doc_id", "n")).alias("t")
    leaders = active.groupBy("key").agg(top).select("key", F.col("t.doc_id").alias("leader"), F.col("t.n").alias("leader_n"))
    met = active.join(leaders, "key").filter(
        (F.col("doc_id") != F.col("leader")) & (100 * F.least("n", "leader_n") >= percent * F.greatest("n", "leader_n")))
    pairs = met.select(F.least("leader", "doc_id").alias("a"), F.greatest("leader", "doc_id").alias("b")).distinct()
    links = linked_pairs(pairs, sets, percent).select(F.col("a").alias("u"), F.col("b").alias("v"))
    found = stored(least_reachable(links.unionByName(known)), "components")
    placed = members.join(found.withColumnRenamed("v", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    placed = stored(placed, "placed")
    several = placed.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x < y").select("key")
    more = stored(_tested_in_blocks(placed.join(several, "key", "left_semi"), sets, percent), "more-links")
    if more.isEmpty():
        return found
    return least_reachable(found.select(F.col("v").alias("u"), F.col("component").alias("v")).unionByName(more))


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80,
    bands: int = BANDS, rows: int = ROWS,
) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs.

    Rows are linked if 100 * intersection >= percent * union of their sets of width-word shingles;
    component_id is the smallest id reachable over links, kept marks the row that bears it. A text
    with fewer words than width has its whole sequence as one shingle; an empty or null text has an
    empty set and is linked with nothing. A null id is linked with nothing either: its component_id
    is null and it is kept. Rows that share an id are one document, linked if any of its texts is.
    Other columns are not read.
    """
    given = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    sk = stored(sketches(given, width, bands, rows), "sketches")
    classes = stored(
        sk.filter("doc_id is not null and n > 0").groupBy("set_a", "set_b").agg(
            F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands")
        ), "classes")
    members = classes.select(F.col("rep").alias("doc_id"), "n", F.explode("bands").alias("key")).distinct()
    shared_keys = members.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1").select("key")
    members = stored(members.join(shared_keys, "key", "left_semi"), "members")
    needed = maybe_broadcast(stored(members.select("doc_id").distinct(), "needed"))
    sets = shingle_arrays(given.join(needed, "doc_id", "left_semi"), width)
    rows_of = sk.filter("doc_id is not null and n > 0").select("doc_id", "set_a", "set_b")
    repeated = stored(rows_of.groupBy("doc_id").agg(F.count("*").alias("c")).filter("c > 1").select("doc_id"), "repeated")
    named = classes.select("set_a", "set_b", F.col("rep").alias("v"))
    same = rows_of.join(repeated, "doc_id", "left_semi").join(named, ["set_a", "set_b"]).select(F.col("doc_id").alias("u"), "v")
    if not repeated.isEmpty():
        sets = sets.distinct()
    found = _components(members, stored(sets, "sets"), same, percent)
    named = named.join(found, "v", "left")
    named = named.select("set_a", "set_b", F.coalesce("component", "v").alias("_component"))
    out = sk.select("doc_id", "n", "set_a", "set_b").join(named, ["set_a", "set_b"], "left")
    component = F.when(F.col("n") == 0, F.col("doc_id")).when(F.col("doc_id").isNotNull(), F.col("_component"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
