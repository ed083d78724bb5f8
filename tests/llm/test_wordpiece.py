"""The automaton against greedy matching."""

import random
import re

import public_tokenizers

from tidewatch.llm.tokens import BYTE_BPE
from tidewatch.llm.wordpiece import Automaton, token_counts, vocabulary


def greedy(word, pieces):
    left, n = b" " + word, 0
    while left:
        for k in range(len(left), 0, -1):
            if left[:k] in pieces:
                left, n = left[k:], n + 1
                break
        else:
            return -1
    return n


def test_small_vocabularies():
    r = random.Random(8)
    for _ in range(200):
        pieces = {bytes(r.choices(b"ab", k=r.randint(1, 5))) for _ in range(r.randint(1, 9))}
        pieces |= {b" " + bytes(r.choices(b"ab", k=r.randint(0, 4))) for _ in range(r.randint(1, 4))}
        walk = Automaton(pieces)
        for _ in range(40):
            word = bytes(r.choices(b"abc", weights=(5, 5, 1), k=r.randint(1, 14)))
            assert walk.count(word) == greedy(word, pieces), (pieces, word)


def test_documents(docs_of, spark, sf):
    pieces = set(vocabulary(public_tokenizers.path(BYTE_BPE)))
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").limit(25).collect()]
    texts += [None, "", " \n\t", "Zürich, 東京 🙂", "z" * 3000, "a\x1cb\xa0c"]
    out = {r.doc_id: r for r in token_counts(docs_of(list(enumerate(texts)) + [(None, "a")])).collect()}
    assert len(out) == len(texts) + 1
    for k, text in enumerate(texts):
        counts = [greedy(w.encode(), pieces) for w in re.findall("[^\x20\x09-\x0D]+", text or "")]
        assert (out[k].n_words, out[k].n_tokens, out[k].n_unknown) == (len(counts), sum(map(abs, counts)), sum(c < 0 for c in counts))


def test_empty_table(docs_of):
    assert token_counts(docs_of([]).limit(0)).count() == 0
