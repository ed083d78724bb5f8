"""Prefix trie of conversations by a splitter skeleton.

A conversation is the path of its turns' digests. Paths, with the conversation's id behind them, are
cut into range partitions (shards) at splitters taken from a sample. A node whose members lie on both
sides of a splitter is a prefix of that splitter, so the trie of the splitters' prefixes, the
skeleton, is known before any node is counted. It is broadcast. Every other node lies in one shard
and is finished there in one pass over sorted paths; of a skeleton node a shard gives a partial
aggregate, and these are reduced. Equal paths are parted by the ids, so copies of one conversation
spread over shards as well.

A splitter is cut one turn behind what it shares with its neighbour in the sample, which bounds the
skeleton by the number of shards and not by the length of conversations.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.shared import fresh, maybe_broadcast, stored

#: Bytes of a turn's digest (of its SHA-256) in a path.
DIGEST = 16
#: Conversations of a shard where more shards than shuffle partitions are needed, and sampled paths a shard.
SHARD_ROWS, SAMPLE = 100_000, 100
_LEAST = -(2**63)

SCHEMA = (
    "skeleton binary, parent binary, shard int, conv_id bigint, depth int, parent_conv_id bigint, n_convs bigint, n_children bigint,"
    " n_leaves bigint, saved_tokens bigint, size bigint, ends string"
)
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def conversation_paths(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): the (digest as hex, bytes of text) of each conversation's turns in order.

    Turns are ordered by turn, null first, and by digest where turns are equal.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    rows = conversations.filter("conv_id IS NOT NULL").select(
        "conv_id", (F.col("conv_id") - F.col("conv_id") % 5).alias("base"),
        F.struct("turn", digest.substr(1, 2 * DIGEST).alias("digest"), F.octet_length(text).cast("long").alias("size")).alias("turn"),
    )
    turns = F.sort_array(F.collect_list("turn"))
    # One shuffle by base serves the grouping and the window that reads the base conversation.
    grouped = rows.repartition("base").groupBy("base", "conv_id").agg(turns.alias("turns"))
    return grouped.select("base", "conv_id", F.transform("turns", lambda t: F.struct(t["digest"].alias("digest"), t["size"].alias("size"))).alias("turns"))


def rebuilt(paths: DataFrame) -> DataFrame:
    """Each conversation c opens with the first crc32(c) % 9 turns of conversation c - c % 5 in place of its own."""
    h = (F.crc32(F.col("conv_id").cast("string")) % 9).cast("int")
    first = F.max(F.when(F.col("conv_id") == F.col("base"), F.slice("turns", 1, 8))).over(Window.partitionBy("base"))
    paths = paths.withColumn("first", first).withColumn("h", h)
    opening = F.coalesce(F.slice("first", F.lit(1), F.col("h")), F.slice("turns", 1, 0))
    own = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0)))
    return paths.select("conv_id", F.concat(opening, own).alias("turns"))


def keyed(paths: DataFrame) -> DataFrame:
    """(conv_id, path, sizes): digests back to back, so that byte order is the order of paths, a prefix first."""
    return paths.select(
        "conv_id", F.unhex(F.array_join(F.col("turns.digest"), "")).alias("path"), F.col("turns.size").alias("sizes"))


def _shared(a: bytes, b: bytes) -> int:
    """The number of turns that two paths share from the root on."""
    if a == b:
        return len(a) // DIGEST
    at, most = 0, min(len(a), len(b))
    while at < most and a[at : at + DIGEST] == b[at : at + DIGEST]:
        at += DIGEST
    return at // DIGEST


def splitters(rows: DataFrame, total: int, shards: int) -> list[tuple[bytes, int]]:
    """Where shards begin, ascending: at most one (path, id) a shard comes to the driver.

    Only the balance of the shards depends on the sample.
    """
    share = max(1, total // (shards * SAMPLE))
    chosen = rows.select("path", "conv_id").filter(F.pmod(F.xxhash64("conv_id"), F.lit(share)) == 0)
    order = Window.orderBy("path", "conv_id")  # over the sample, some hundred rows a shard
    ranked = chosen.select(
        "path", "conv_id", F.lag("path").over(order).alias("before"), F.row_number().over(order).alias("place"),
        F.count(F.lit(1)).over(Window.partitionBy()).alias("n"),
    )
    slot = ((F.col("place") - 1) * shards / F.col("n")).cast("long")
    previous = ((F.col("place") - 2) * shards / F.col("n")).cast("long")
    found = set()
    for r in ranked.filter((slot > previous) & (F.col("place") > 1)).select("path", "conv_id", "before").collect():
        path, before = bytes(r["path"]), bytes(r["before"])
        if path == before:
            found.add((path, r["conv_id"]))
        else:
            found.add((path[: DIGEST * (_shared(path, before) + 1)], _LEAST))
    return sorted(found)


def skeleton_of(cuts: list[tuple[bytes, int]]) -> set[bytes]:
    """The prefixes of splitters that can have members on both sides; always the root."""
    nodes = {b""}
    for path, conv_id in cuts:
        upto = len(path) if conv_id != _LEAST else len(path) - DIGEST
        nodes.update(path[:k] for k in range(0, upto + 1, DIGEST))
    return nodes


class _Node:
    __slots__ = ("skeleton", "size", "n", "low", "children", "leaves", "saved", "ends", "held")

    def __init__(self, skeleton: bool, size: int):
        self.skeleton, self.size = skeleton, size
        self.n = self.children = self.leaves = self.saved = 0
        self.low: int | None = None
        self.ends = [] if skeleton else hashlib.sha256()
        self.held: list[list] = []


class Shard:
    """Takes one shard's (path, sizes, conv_id) in order and gives rows as in SCHEMA.

    The open nodes are the last path's. A finished node waits for its parent's smallest member only
    where the parent is no skeleton node, so what waits is never more than one shard's own.
    """

    def __init__(self, number: int, skeleton: set[bytes]):
        self.number, self.skeleton = number, skeleton
        self.path, self.open = b"", [_Node(True, 0)]
        self.out: list[list] = []

    def add(self, path: bytes, sizes: list[int], conv_id: int) -> None:
        depth = _shared(self.path, path)
        self._close(depth)
        for d in range(depth, len(path) // DIGEST):
            self.open.append(_Node(self.open[-1].skeleton and path[: DIGEST * (d + 1)] in self.skeleton, sizes[d]))
        self.path = path
        node = self.open[-1]
        node.n += 1
        node.low = conv_id if node.low is None else min(node.low, conv_id)
        if node.skeleton:
            node.ends.append(str(conv_id))
        else:
            node.ends.update((b"," if node.n > 1 else b"") + str(conv_id).encode())

    def _close(self, depth: int) -> None:
        while len(self.open) - 1 > depth:
            d = len(self.open) - 1
            node, above = self.open.pop(), self.open[-1]
            if not node.skeleton:
                node.leaves += node.children == 0
                node.saved += (node.n - 1) * node.size
                above.children += 1
            above.n += node.n
            above.low = node.low if above.low is None else min(above.low, node.low)
            above.leaves += node.leaves
            above.saved += node.saved
            for row in node.held:
                row[5] = node.low
                self.out.append(row)
            self._give(node, d, above)

    def _give(self, node: _Node, depth: int, above: _Node | None) -> None:
        key = self.path[: DIGEST * depth]
        if node.skeleton:
            self.out.append([key, None, self.number, node.low, depth, None, node.n, node.children, node.leaves, node.saved, node.size, ",".join(node.ends)])
            return
        row = [None, key[:-DIGEST] if above.skeleton else None, None, node.low, depth, None, node.n, node.children, node.leaves, node.saved, None,
               node.ends.hexdigest()]
        (self.out if above.skeleton else above.held).append(row)

    def close(self) -> None:
        """All open nodes end, the root as a partial of the skeleton."""
        self._close(0)
        if self.open[0].n:
            self._give(self.open[0], 0, None)
        self.path, self.open = b"", [_Node(True, 0)]

    def taken(self) -> list[list]:
        rows, self.out = self.out, []
        return rows


_TYPES = [pa.binary(), pa.binary(), pa.int32(), pa.int64(), pa.int32(), *[pa.int64()] * 6, pa.string()]
_NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


def _batch(rows: list[list]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in _NAMES]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True)], names=_NAMES)


def _joined_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of each key's ids, whose pieces follow one another in order; a piece at a time."""
    key, digest = None, None
    for batch in batches:
        keys, digests = [], []
        for k, ends in zip(batch.column("skeleton").to_pylist(), batch.column("ends").to_pylist(), strict=True):
            if k != key:
                if key is not None:
                    keys.append(key)
                    digests.append(digest.hexdigest())
                key, digest = k, hashlib.sha256(ends.encode())
            else:
                digest.update(b"," + ends.encode())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(digests, pa.string())], names=["skeleton", "ends_sha256"])
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([digest.hexdigest()])], names=["skeleton", "ends_sha256"])


def reduced(partials: DataFrame) -> DataFrame:
    """The skeleton's nodes (skeleton, and COLUMNS): partials summed, then what nodes owe their ancestors.

    All tables here have a row for each skeleton node and shard that it spans, at most.
    """
    above = F.expr(f"substring(skeleton, 1, length(skeleton) - {DIGEST})")
    nodes = stored(partials.groupBy("skeleton").agg(
        F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.sum("n_convs").alias("n_convs"), F.sum("n_children").alias("n_children"),
        F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"), F.max("size").alias("size"),
    ), "trie-skeleton")
    kids = nodes.filter("depth > 0").groupBy(above.alias("skeleton")).agg(F.count(F.lit(1)).alias("kids"))
    nodes = nodes.join(kids, "skeleton", "left").withColumn("n_children", F.col("n_children") + F.coalesce("kids", F.lit(0)))
    owed = nodes.select(
        F.explode(F.expr(f"transform(sequence(0, depth), d -> substring(skeleton, 1, d * {DIGEST}))")).alias("skeleton"),
        (F.col("n_children") == 0).cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col("size")).alias("saving"),
    ).groupBy("skeleton").agg(F.sum("leaf").alias("leaf"), F.sum("saving").alias("saving"))
    pieces = partials.filter("ends <> ''").select("skeleton", "shard", "ends").repartition("skeleton").sortWithinPartitions("skeleton", "shard")
    ends = pieces.mapInArrow(_joined_ends, "skeleton binary, ends_sha256 string")
    parents = nodes.select(F.col("skeleton").alias("above"), F.col("conv_id").alias("parent_conv_id"))
    return (
        nodes.join(owed, "skeleton").join(ends, "skeleton", "left")
        .withColumn("above", F.when(F.col("depth") > 0, above)).join(parents, "above", "left")
        .select(
            "skeleton", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", (F.col("n_leaves") + F.col("leaf")).alias("n_leaves"),
            (F.col("saved_tokens") + F.col("saving")).alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
        )
    )


def prefix_trie(paths: DataFrame, shards: int | None = None) -> DataFrame:
    """A row of COLUMNS for each distinct prefix of the paths (conv_id, turns: array of (digest, size)).

    conv_id is a node's smallest member, n_leaves and saved_tokens are over its subtree, saved_tokens adds
    up each node's (members - 1) times its last turn's size, ends_sha256 is over the ids that end in it.
    A path without turns ends in the root. Without paths there is no node. Ids must not repeat.
    """
    spark = paths.sparkSession
    rows = stored(keyed(paths), "trie-paths")
    total = rows.count()
    shards = shards or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // SHARD_ROWS))
    cuts = splitters(rows, total, shards)
    shared = spark.sparkContext.broadcast((cuts, skeleton_of(cuts)))

    @F.pandas_udf("int")
    def shard_of(path: pd.Series, conv_id: pd.Series) -> pd.Series:
        found = shared.value[0]
        return pd.Series([bisect_right(found, (p, c)) for p, c in zip(path, conv_id, strict=True)], dtype="int32")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = None
        for batch in batches:
            for number, path, sizes, conv_id in zip(*(batch.column(c).to_pylist() for c in ("shard", "path", "sizes", "conv_id")), strict=True):
                if shard is None or shard.number != number:
                    if shard is not None:
                        shard.close()
                        yield _batch(shard.taken())
                    shard = Shard(number, shared.value[1])
                shard.add(path, sizes, conv_id)
            if shard is not None:
                yield _batch(shard.taken())
        if shard is not None:
            shard.close()
            yield _batch(shard.taken())

    dealt = rows.withColumn("shard", shard_of("path", "conv_id")).repartitionById(len(cuts) + 1, F.col("shard"))
    counted = stored(dealt.sortWithinPartitions("shard", "path", "conv_id").mapInArrow(run, SCHEMA), "trie-nodes")
    skeleton = stored(reduced(counted.filter("skeleton IS NOT NULL")), "trie-reduced")
    done = counted.filter("skeleton IS NULL").withColumnRenamed("ends", "ends_sha256")
    above = maybe_broadcast(skeleton.select(F.col("skeleton").alias("parent"), F.col("conv_id").alias("above")))
    inner = done.join(above, "parent", "left").withColumn("parent_conv_id", F.coalesce("above", "parent_conv_id"))
    return inner.select(*COLUMNS).unionByName(skeleton.select(*COLUMNS)).withColumn("depth", F.col("depth").cast("long"))


def conversation_trie(conversations: DataFrame, shards: int | None = None) -> DataFrame:
    """The trie of the rebuilt conversations (conv_id, turn, role, text), as prefix_trie gives it.

    A null role or text is empty. Rows without a conv_id belong to no conversation. Repeated turns
    are turns of their own. A conversation's digests, 16 bytes a turn and no text, are one row. Other
    columns are not read. An empty table gives no node.
    """
    rows = fresh(conversations, {"conv_id": "conv_id", "turn": "turn", "role": "role", "text": "text"})
    return prefix_trie(rebuilt(conversation_paths(rows.withColumn("conv_id", F.col("conv_id").cast("long")))), shards)
