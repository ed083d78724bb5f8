"""The trie of rebuilt conversations against a plain version, with hot prefixes, copies and few or many shards."""

import hashlib
import random
import zlib

import pytest

from tidewatch.llm import prefixtrie

SCHEMA = "conv_id long, turn long, role string, text string"


def plain(rows):
    original = {}
    for c, turn, role, text in rows:
        if c is not None:
            original.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))

    def digest(role, text):
        return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()

    for turns in original.values():
        turns.sort(key=lambda t: (t[0], t[1], digest(t[2], t[3])))
    paths = {}
    for c, own in original.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c > 0 else -1)
        paths[c] = [t[2:] for t in original.get(base, [])[:h] + own[h:]]
    nodes = {}
    for c, path in paths.items():
        for d in range(len(path) + 1):
            nodes.setdefault(tuple(path[:d]), []).append(c)
    out = []
    for key, members in nodes.items():
        below = [k for k in nodes if k[: len(key)] == key]
        ends = ",".join(map(str, sorted(c for c in members if len(paths[c]) == len(key))))
        out.append((
            min(members), len(key), min(nodes[key[:-1]]) if key else None, len(members),
            sum(len(k) == len(key) + 1 for k in below),
            sum(not any(m[:-1] == k for m in nodes if m) for k in below),
            sum((len(nodes[k]) - 1) * len(k[-1][1].encode()) for k in below if k),
            hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return sorted(out, key=str)


def conversations(seed, n):
    r = random.Random(seed)
    rows = []
    for c in r.sample(range(-40, 4 * n), n):
        kind = r.random()
        for t in range(1 if kind < 0.2 else r.choice([1, 2, 3, 5, 11, 14])):
            text = "hello" if kind < 0.4 else r.choice(["a", "b", "é\n", "", None])
            rows.append((c, t if kind < 0.9 else r.choice([None, 1]), r.choice(["user", "user", "", None]) if kind > 0.6 else "user", text))
    rows += [(None, 0, "user", "no conversation"), (None, None, None, None)]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("shards", [1, 7, 40])
def test_equals_a_plain_trie(spark, shards):
    rows = conversations(shards, 70)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = sorted([tuple(r) for r in prefixtrie.conversation_trie(df, shards).select(*prefixtrie.COLUMNS).collect()], key=str)
    assert got == plain(rows)


def test_copies_of_one_conversation_spread_over_shards(spark):
    """A long conversation under many ids: its path is cut between ids, and its digest is still over all of them."""
    rows = [(5 * c, t, "user", f"turn {t}") for c in range(200) for t in range(9)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    paths = prefixtrie.keyed(prefixtrie.rebuilt(prefixtrie.conversation_paths(df)))
    cuts = prefixtrie.splitters(paths, 200, 8)
    assert len(cuts) == 7 and len({p for p, _ in cuts}) == 1
    got = sorted([tuple(r) for r in prefixtrie.conversation_trie(df, 8).select(*prefixtrie.COLUMNS).collect()], key=str)
    assert got == plain(rows) and len(got) == 10


def test_a_splitter_is_no_longer_than_it_must_be(spark):
    """Long conversations that part at the first turn make a skeleton of the root alone."""
    rows = [(5 * c, t, "user", f"{c} {t}") for c in range(60) for t in range(30)]
    paths = prefixtrie.keyed(prefixtrie.rebuilt(prefixtrie.conversation_paths(spark.createDataFrame(rows, SCHEMA))))
    cuts = prefixtrie.splitters(paths, 60, 10)
    assert {len(p) for p, _ in cuts} == {prefixtrie.DIGEST}
    assert prefixtrie.skeleton_of(cuts) == {b""}


def test_empty_and_other_columns(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert prefixtrie.conversation_trie(empty).count() == 0
    rows = [(2, 0, "user", "x")]
    # Conversation 0 is missing and opens nothing; crc32("2") % 9 turns of its own go: it may be turnless.
    clash = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS path", "2 AS shard", "3 AS skeleton", "4 AS depth", "5 AS base", "6 AS turns")
    got = [tuple(r) for r in prefixtrie.conversation_trie(clash).select(*prefixtrie.COLUMNS).collect()]
    assert sorted(got, key=str) == plain(rows)
