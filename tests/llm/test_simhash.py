"""Fingerprints against a plain vote, edited texts, and the search against all pairs."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tidewatch.llm import simhash
from tidewatch.llm.textops import mix, word_hashes


def plain_print(text):
    """One term and one bit after the other."""
    data = np.frombuffer((text or "").encode(), dtype=np.uint8)
    words, _ = word_hashes(data, np.array([0, len(data)]))
    base = np.uint64(0x9E3779B97F4A7C15)
    votes = [0] * simhash.BITS
    with np.errstate(over="ignore"):
        pairs = [mix(np.array([a * base + b]))[0] for a, b in zip(words[:-1], words[1:], strict=True)]
        for width, terms, weight in ((1, list(words), 128), (2, pairs, 256)):
            for term, n in Counter(terms).items():
                term = mix(np.array([term + np.uint64(width)]))[0]
                w = int(np.rint(weight * math.sqrt(n)))
                for k in range(simhash.WORDS):
                    h = int(mix(np.array([term + base * np.uint64(k + 1)]))[0])
                    for bit in range(64):
                        votes[64 * k + bit] += w if h >> bit & 1 else -w
    return np.packbits([v > 0 for v in votes]).tobytes().hex()


TEXTS = ["", None, "one", "one two", "one two three one two", "ünï cödé wörds " * 9, "A a A", "x\ny\tz  ", "🤷 emoji 🤷🏽", "w " * 500]


def test_prints_are_the_votes():
    got = [p.tobytes().hex() for p in simhash.fingerprints(pa.array(TEXTS))]
    assert got == [plain_print(t) for t in TEXTS]


def plain_rows(rows):
    rows = sorted(((d, t or "") for d, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    out = []
    for k, (doc_id, text) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        half = len(text) // 2
        changed = text[: len(text) - half] + following[:half]
        prints = [plain_print(t) for t in (text, changed, following)]
        bits = [int(p, 16) for p in prints]
        near = [1 - bin(bits[0] ^ b).count("1") / simhash.BITS for b in bits[1:]]
        out.append((doc_id, len(text), hashlib.sha256(changed.encode()).hexdigest(), prints[0], prints[1], *near))
    return sorted(out, key=str)


@pytest.mark.parametrize("parts", [1, 3, 8])
def test_every_row_meets_the_next(spark, docs_of, parts):
    rows = [(3 * k, t) for k, t in enumerate(TEXTS)] + [(None, "null id"), (6, "twice"), (6, "twice"), (7, None)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        clash = docs_of(rows).selectExpr("*", "1 AS part", "2 AS edge", "3 AS fingerprint")
        got = sorted([tuple(r) for r in simhash.compared_with_next(clash).collect()], key=str)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert got == plain_rows(rows)


def test_one_row_follows_itself_and_no_row_gives_none(docs_of):
    got = [tuple(r) for r in simhash.compared_with_next(docs_of([(4, "the only text here")])).collect()]
    assert got == plain_rows([(4, "the only text here")]) and got[0][-1] == 1.0
    assert simhash.compared_with_next(docs_of([])).count() == 0


def prints_with_neighbours(seed, n):
    r = random.Random(seed)
    rows = []
    while len(rows) < n:
        value = r.getrandbits(simhash.BITS)
        rows.append(value)
        for _ in range(r.choice([0, 0, 3, 12])):
            near = value
            for bit in r.sample(range(simhash.BITS), r.choice([0, 1, 7, 8, 9, 20])):
                near ^= 1 << bit
            rows.append(near)
    return [(k, f"{v:064x}") for k, v in enumerate(rows)]


@pytest.mark.parametrize("radius,bucket", [(0, 2_000), (8, 2_000), (8, 3), (20, 50)])
def test_search_finds_all_pairs(spark, monkeypatch, radius, bucket):
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    rows = prints_with_neighbours(radius + bucket, 300) + [(None, "f" * 64), (1000, "f" * 64), (1001, "0" * 64)]
    df = spark.createDataFrame(rows, "doc_id long, fingerprint string").repartition(4)
    got = {r.doc_id: r.n_near for r in simhash.near_documents(df, radius, every=2).collect() if r.doc_id is not None}
    values = [int(f, 16) for _, f in rows]
    for (doc_id, _), value in zip(rows, values, strict=True):
        if doc_id is not None:
            want = None if doc_id % 2 else sum(bin(value ^ v).count("1") <= radius for v in values) - 1
            assert got[doc_id] == want


def test_longer_keys_for_more_rows():
    """Whatever the number of rows, each choice of differing blocks leaves a table that agrees."""
    small, large = simhash.block_tables(1 << 20), simhash.block_tables(1 << 40)
    assert len(small) == 9 and len(large) == 45
    assert min(sum(b - a for a, b in t) for t in large) >= 36
    assert len(simhash.block_tables(1 << 40, radius=16)) == math.comb(19, 3)
