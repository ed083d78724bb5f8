"""Near duplicates against all pairs, and the signature's law."""

import random
import re

import numpy as np
import pyarrow as pa

from tidewatch.llm import neardup, textops


def shingles(text, width):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall("[^\x20\x09-\x0D]+", text)
    if len(w) < width:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}


def brute(rows, width, percent):
    sets = [(d, shingles(t, width)) for d, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (di, a) in enumerate(sets):
        for j, (dj, b) in enumerate(sets[:i]):
            if di is None or dj is None or not a or not b:
                continue
            if di == dj or 100 * len(a & b) >= percent * len(a | b):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, a) in enumerate(sets):
        if d is not None and a:
            least[root(i)] = min(least.get(root(i), d), d)
    return sorted(
        [(d, len(a), None if d is None else d if not a else least[root(i)]) for i, (d, a) in enumerate(sets)], key=str)


def texts(seed, n):
    r = random.Random(seed)
    vocabulary = ["w%d" % k for k in range(400)]
    out = []
    while len(out) < n:
        base = r.choices(vocabulary, k=r.choice([1, 3, 30, 60, 120]))
        out.append(" ".join(base))
        for _ in range(r.choice([0, 0, 1, 5, 12])):
            copy = list(base)
            for _ in range(r.choice([0, 1, 2, 4])):
                copy[r.randrange(len(copy))] = r.choice(vocabulary)
            out.append(r.choice([" ", "\t\n "]).join(w.upper() if r.random() < 0.1 else w for w in copy))
    return out


def rows_of(df):
    return sorted([(r.doc_id, r.n_shingles, r.component_id) for r in df.collect()], key=str)


def test_equals_all_pairs(docs_of):
    rows = list(enumerate(texts(3, 260)))
    random.Random(4).shuffle(rows)
    rows += [(1000, None), (1001, ""), (1002, " \n"), (None, rows[0][1]), (5, rows[7][1]), rows[9], rows[9]]
    for width in (2, 5):
        out = neardup.near_duplicates(docs_of(rows), width=width)
        assert rows_of(out) == brute(rows, width, 80)
        assert all(r.kept == (r.component_id is None or r.doc_id == r.component_id) for r in out.collect())


def test_copies_that_meet_only_in_their_source(docs_of):
    """No two copies are linked with each other; all are linked with the text they were made from."""
    r = random.Random(5)
    base = ["b%d" % k for k in range(60)]
    rows = [(900, " ".join(base))]
    for k in range(40):
        copy = list(base)
        for p in r.sample(range(1, 59), 3):
            copy[p] = f"n{k}{p}"
        rows.append((k, " ".join(copy)))
    assert rows_of(neardup.near_duplicates(docs_of(rows), width=2)) == brute(rows, 2, 80)
    assert len({c for _, _, c in brute(rows, 2, 80)}) == 1


def test_candidates_in_many_blocks(docs_of, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK_DOCS", 7)
    monkeypatch.setattr(neardup, "_TOKENS", 16)
    rows = list(enumerate(texts(30, 160)))
    base = ["b%d" % k for k in range(50)]
    r = random.Random(31)
    for k in range(60):  # near the limit of 0.8 to each other, in chains
        base[r.randrange(50)] = f"n{k}"
        rows.append((500 + k, " ".join(base)))
    random.Random(32).shuffle(rows)
    assert rows_of(neardup.near_duplicates(docs_of(rows), width=2, bands=20, rows=2)) == brute(rows, 2, 80)


def test_empty_and_only_unlinked(docs_of):
    assert neardup.near_duplicates(docs_of([]).limit(0)).count() == 0
    assert rows_of(neardup.near_duplicates(docs_of([(1, "a b c"), (2, "d e f")]))) == [(1, 1, 1), (2, 1, 2)]


def test_signature_estimates_similarity():
    g = np.random.default_rng(6)
    errors = []
    for _ in range(150):
        n, k = 150, int(g.integers(0, 150))
        pool = g.integers(0, 2**63, 2 * n - k, dtype=np.uint64)
        same = neardup.signature(pool[:n]) == neardup.signature(pool[n - k :])
        errors.append(same.mean() - k / len(pool))
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.05


def test_word_hashes_are_one_to_one():
    given = ["Hello  World\n a\tb", None, "", "  x ", "One", "a b a b a", "É é A", "\x1c a\x85b", "q" * 3000] * 5
    seen = {}
    for first, data, offsets in textops.blocks(pa.array(given)):
        hashes, bounds = textops.word_hashes(data, offsets)
        for k in range(len(offsets) - 1):
            text = "".join(c.lower() if "A" <= c <= "Z" else c for c in given[first + k] or "")
            words = re.findall("[^\x20\x09-\x0D]+", text)
            own = hashes[bounds[k] : bounds[k + 1]].tolist()
            assert len(own) == len(words)
            assert all(seen.setdefault(w, h) == h for w, h in zip(words, own, strict=True))
    assert len(set(seen.values())) == len(seen)
