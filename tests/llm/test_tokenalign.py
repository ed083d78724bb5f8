"""Alignment of tokenizers against a plain walk over all pairs of tokens."""

import hashlib
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidewatch.llm import tokenalign
from tidewatch.llm.tokens import SPELLING

BYTE = {c: b for b, c in SPELLING.items()}
TEXTS = [
    "The quick brown fox, jumped over 13 lazy dogs.", "", None, " ", "\n", "a  b   c\t d\r\n", "<|endoftext|> and <s> </s> <unk> <0x41>",
    "naïve café ☕ 漢字かな交じり文 🤷🏽‍♀️", "▁ is a mark", "x y ﬁ é", "\x00\x01", "again again again", "again again again",
    "word" * 300, " leading and trailing ", "don't we'll I'M", "12345678901234567890",
]


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def tokens(text, libraries):
    """[(id, bytes)] of both sides, straight from the libraries."""
    if not text:
        return [], []
    one, two = libraries
    a = [(k, bytes(BYTE[c] for c in one.id_to_token(k))) for k in one.encode(" " + text, add_special_tokens=False).ids]
    b = []
    for k in two.encode(text):
        piece = two.id_to_piece(k)
        b.append((k, bytes([int(piece[3:5], 16)]) if piece.startswith("<0x") else piece.replace("▁", " ").encode()))
    whole = (" " + text).encode()
    if b"".join(t for _, t in a) != whole or b"".join(t for _, t in b) != whole:
        return [], []
    return a, b


def spans(side):
    out, at = [], 0
    for k, token in side:
        out.append((k, at, at + len(token)))
        at += len(token)
    return out


def plain(rows, libraries):
    found = []
    for doc_id, text in rows:
        a, b = (spans(s) for s in tokens(text, libraries))
        links = [(x[0], y[0]) for x in a for y in b if x[1] < y[2] and y[1] < x[2]]
        ends = sorted({x[2] for x in a} & {y[2] for y in b})
        groups = []
        for low, high in zip([0, *ends], ends, strict=False):
            groups.append("|".join(",".join(str(t[0]) for t in side if low < t[2] <= high) for side in (a, b)))
        found.append((doc_id, len(a), len(b), len(ends), links, ";".join(groups)))
    count = Counter(p for f in found for p in f[4])
    best = {}
    for (_, b), n in count.items():
        best[b] = max(best.get(b, 0), n)
    return sorted(
        [(d, na, nb, g, len(p), hashlib.sha256(s.encode()).hexdigest() if s else "", sum(count[x] == best[x[1]] for x in p), sum(count[x] for x in p))
         for d, na, nb, g, p, s in found], key=str)


@pytest.mark.parametrize("frequent", [tokenalign.FREQUENT, 5])
def test_equals_all_pairs(spark, docs_of, libraries, frequent):
    rows = list(enumerate(TEXTS)) + [(None, "no id"), (3, "twice the id")]
    got = tokenalign.align_tokenizers(docs_of(rows).selectExpr("*", "1 AS row", "2 AS pairs", "3 AS count"), frequent=frequent)
    assert sorted([tuple(r) for r in got.collect()], key=str) == plain(rows, libraries)


def test_real_documents(spark, sf, libraries):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(40)
    rows = [(r.doc_id, r.text[:1500]) for r in docs.collect()]
    got = tokenalign.align_tokenizers(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert sorted([tuple(r) for r in got.collect()], key=str) == plain(rows, libraries)


def test_empty_table(docs_of):
    assert tokenalign.align_tokenizers(docs_of([])).count() == 0
    got = tokenalign.align_tokenizers(docs_of([(1, None), (2, "")])).collect()
    assert sorted(tuple(r) for r in got) == [(1, 0, 0, 0, 0, "", 0, 0), (2, 0, 0, 0, 0, "", 0, 0)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=40), min_size=1, max_size=4))
def test_ids_are_the_libraries(libraries, texts):
    a, b = tokenalign.sides(None, None).encode(texts)
    for text, x, y in zip(texts, a, b, strict=True):
        want = tokens(text, libraries)
        assert (x.tolist(), y.tolist()) == ([k for k, _ in want[0]], [k for k, _ in want[1]])
