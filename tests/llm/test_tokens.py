"""Ids against the tokenizer itself; the store's round trip; packing's exactness and optimality."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tidewatch.llm import idstore, packing
from tidewatch.llm.shared import scratch
from tidewatch.llm.tokens import encoder

PARTS = ["a", "b", "The", " ", "  ", "\n", " \n", "\n\n", "\t", "é", "1", "12", "'s", "'", "!", ".", ",", "\x01", "​", "\x1c", "\x85",
         "中", "<|endoftext|>", "🙂", "\r\n", "﻿", "᠎", "٣", "ª", "ǅ", "ſ", "Zé,", "be.", "ß", "\xad", " "]


def ids_of(text, end=()):
    return [*encoder().tokenizer.encode(text or "", add_special_tokens=False).ids, *end]


def texts(seed, n):
    r = random.Random(seed)
    return ["".join(r.choices(PARTS, k=r.randint(0, 14))) for _ in range(n)]


def test_ids_equal_the_tokenizers():
    given = texts(15, 4000)
    assert all(got.tolist() == ids_of(t) for t, got in zip(given, encoder().encode(pa.array(given)), strict=True))


def test_words_are_forgotten_in_time(monkeypatch):
    monkeypatch.setattr("tidewatch.llm.tokens.PIECES", 10)
    monkeypatch.setattr("tidewatch.llm.tokens.BLOCK_BYTES", 200)
    given = texts(16, 300) + [None]
    assert all(got.tolist() == ids_of(t) for t, got in zip(given, encoder().encode(pa.array(given)), strict=True))


@pytest.fixture(scope="module")
def rows(spark, sf):
    own = [(k, t) for k, t in enumerate(texts(17, 150))]
    table = [(1000 + r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").limit(60).collect()]
    out = own + table + [(2000, None), (2001, ""), (-5, "first"), (3, "again"), (3, "again"), (None, "no id"), (2002, "word " * 30000)]
    random.Random(18).shuffle(out)
    return out


def in_order(rows):
    """Null ids first, then by id, then by text."""
    return sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, (x[1] or "").encode()))


def test_store_round_trip(docs_of, spark, rows, monkeypatch):
    monkeypatch.setattr(idstore, "BLOCK_DOCS", 7)
    path = scratch(spark, "store-test")
    idstore.write_ids(docs_of(rows), path, end_id=0)
    got = sorted(idstore.read_ids(spark, path).collect(), key=lambda r: r.start)
    at = 0
    for (doc, text), r in zip(in_order(rows), got, strict=True):
        want = ids_of(text, [0])
        assert (r.doc_id, r.start, r.n_tokens) == (doc, at, len(want))
        assert np.frombuffer(r.ids, "<u4").tolist() == want
        at += len(want)
    only = spark.createDataFrame([(3,), (2001,), (99999,)], "doc_id long")
    few = idstore.read_ids(spark, path, only).collect()
    starts = {(r.doc_id, r.start) for r in got if r.doc_id in (3, 2001)}
    assert {(r.doc_id, r.start) for r in few} == starts and len(few) == 4
    stored = spark.read.parquet(f"{path}/dictionary").first()
    assert {b.dictionary for b in spark.read.parquet(f"{path}/blocks").collect()} == {stored.dictionary}


def test_store_refuses_another_dictionary(docs_of, spark):
    path, other = scratch(spark, "store-test"), scratch(spark, "store-test")
    idstore.write_ids(docs_of([(1, "a b c")]), path)
    spark.read.parquet(f"{path}/dictionary").selectExpr("'other' as dictionary", "dtype", "data").write.parquet(f"{other}/dictionary")
    spark.read.parquet(f"{path}/blocks").write.parquet(f"{other}/blocks")
    with pytest.raises(Exception, match="another dictionary"):
        idstore.read_ids(spark, other).collect()


def test_empty_store(docs_of, spark):
    path = scratch(spark, "store-test")
    idstore.write_ids(docs_of([]).limit(0), path)
    assert idstore.read_ids(spark, path).count() == 0


def test_packing_is_exact(docs_of, rows, monkeypatch):
    monkeypatch.setattr(packing, "SEGMENT", 5000)
    pieces = packing.pack(docs_of(rows)).collect()
    streams = defaultdict(list)
    for p in pieces:
        streams[p.sequence_id].append(p)
    for own in streams.values():
        own.sort(key=lambda p: p.offset)
        assert [p.offset for p in own] == np.cumsum([0, *[p.length for p in own[:-1]]]).tolist()
        assert sum(p.length for p in own) <= 2048 and min(p.length for p in own) > 0
    ordered = [p for s in sorted(streams) for p in streams[s]]
    k = 0
    for doc, text in in_order(rows):
        want, at = np.array(ids_of(text, [1]), "<u4"), 0
        while at < len(want):
            p = ordered[k]
            assert (p.doc_id, p.start, p.doc_tokens) == (doc, at, len(want))
            assert p.ids_crc32 == zlib.crc32(want[at : at + p.length].tobytes())
            at, k = at + p.length, k + 1
    assert k == len(ordered)


def test_empty_packing(docs_of):
    assert packing.pack(docs_of([]).limit(0)).count() == 0


def test_cuts_are_the_best():
    """The monotone queue against trying every predecessor."""
    r = random.Random(19)
    for _ in range(60):
        total = r.randint(1, 400)
        docs = np.array(sorted({*r.choices(range(1, total + 1), k=r.randint(0, 9)), total}))
        ends = np.array(sorted(set(r.choices(range(1, total + 1), k=r.randint(0, 30)))), dtype=np.int64)
        size = r.choice([16, 64, 300])
        places, costs = packing.cut_points(ends, docs, size)
        assert places[-1] == total and np.all(np.diff(np.concatenate(([0], places))) <= size) and set(docs) <= set(places)
        at, pen = [0, *places.tolist()], [0, *costs.tolist()]
        best = [0] + [None] * (len(at) - 1)
        for j in range(1, len(at)):
            best[j] = min(best[i] + size - (at[j] - at[i]) + pen[j] for i in range(j) if at[j] - at[i] <= size)
        cuts = packing.best_cuts(places, costs, size)
        price = dict(zip(places.tolist(), costs.tolist(), strict=True))
        spent = sum(size - (b - a) + price[b] for a, b in zip([0, *cuts], cuts, strict=False))
        assert cuts[-1] == total and spent == best[-1]
