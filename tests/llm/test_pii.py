"""Base spans against Python's own expressions; the pattern graph against matrices; planted contexts."""

import hashlib
import random
import re

import numpy as np

from tidewatch.llm import pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        x = int(c) * (1 + k % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def sound(kind, found):
    digits = re.sub("[^0-9]", "", found)
    if kind == "ip":
        return all(int(x) <= 255 for x in found.split("."))
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 10 <= len(digits) <= 15


def brute(text):
    spans = []
    for order, (kind, form) in enumerate(PLAIN.items()):
        spans += [(m.start(), order, m.end(), kind) for m in re.finditer(form, text or "") if sound(kind, m[0])]
    spans.sort()
    listed = ",".join(f"{k}:{a}:{b}" for a, _, b, k in spans)
    return (*[sum(s[3] == k for s in spans) for k in PLAIN], hashlib.sha256(listed.encode()).hexdigest()), listed


def results(docs):
    out = {}
    for r in pii.find_pii(docs).collect():
        out.setdefault(r.doc_id, []).append(r)
    return out


def test_base_equals_python(docs_of):
    r = random.Random(20)
    parts = ["a", "b.c", "@", "x@y.z", "d-e", ".", "..", "1", "0", "255", "1.2.3.4", "256.1.1.1", "0001.2.3.4", "4111 1111 1111 1111", "-", " ", "  ",
             "+1 (017) 555-7713", "+", "(", ")", "é", "🙂", "\n", "%", "_", "4111111111111111", "m@n.o-p.q", "@@", "5500-0000-0000-0004", "9" * 25]
    texts = ["".join(r.choices(parts, k=r.randint(0, 14))) for _ in range(500)]
    texts += [None, "", "a@" + "b." * 20000 + "c", "1" * 30000, "1 " * 20000, "a" * 30000 + "@b", "a@b.c_d@e.f", "1.2.3.4.5.6.7.8", "+1" * 5000]
    rows = list(enumerate(texts)) + [(None, "q@r.st"), (3, texts[3]), (4, "other 1.2.3.4")]
    got = results(docs_of(rows).selectExpr("*", "'clash' as kind", "1 as body"))
    for doc, text in rows:
        want, listed = brute(text)
        assert any((r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) == want and (r.spans == listed or r.n_learned) for r in got[doc]), text
    assert len(got[3]) == 2 and len(got[4]) == 2


def test_contexts_find_unseen_identifiers(docs_of):
    """Numbers of no known form behind words that cards stood behind; the same numbers elsewhere stay out."""
    r = random.Random(21)

    def card():
        while True:
            digits = "".join(r.choices("0123456789", k=16))
            if luhn(digits):
                return digits

    filler = lambda: " ".join("".join(r.choices("abcdefgh", k=6)) for _ in range(8))
    rows = [(k, f"{filler()} card number {card()} {filler()}") for k in range(60)]
    rows += [(100, f"{filler()} card number A77-12345678. {filler()}"), (101, f"{filler()} room size 12345678 {filler()}"), (102, filler())]
    rows += [(103, f"{filler()} card number abc {filler()} card number 12 {filler()}")]
    got = results(docs_of(rows))
    text = dict(rows)[100]
    at = text.index("A77")
    assert got[100][0].spans == f"card:{at}:{at + 12}" and got[100][0].n_learned == 1 and got[100][0].n_card == 0
    assert [got[k][0].spans for k in (101, 102, 103)] == ["", "", ""]
    assert all(got[k][0].n_card == 1 and got[k][0].n_learned == 0 for k in range(60))


def test_contexts_of_identifiers_written_with_spaces(docs_of):
    """Phones of one country code and cards in groups are seeds; unseen spaced numbers behind the same words are added whole."""
    r = random.Random(24)
    digits = lambda k: "".join(r.choices("0123456789", k=k))

    def card():
        while True:
            d = digits(16)
            if luhn(d):
                return " ".join(d[k : k + 4] for k in range(0, 16, 4))

    filler = lambda: " ".join("".join(r.choices("abcdefgh", k=6)) for _ in range(8))
    gaps = [" ", "  "]
    rows = [(k, f"{filler()} reach me at +1{r.choice(gaps)}({digits(3)}) {digits(3)}-{digits(4)}, {filler()}") for k in range(40)]
    rows += [(k, f"{filler()} paid by card {card()} {filler()}") for k in range(40, 80)]
    new = {
        100: ("phone", "reach me at", "555 123 4567"), 101: ("phone", "reach me at", "(555) 123-4567"), 102: ("phone", "reach me at", "555 - 123 4567"),
        103: ("card", "paid by card", "1234 5678 9012"), 104: ("card", "paid by card", "1234567890123"),
    }
    rows += [(k, f"{filler()} {words} {number}. {filler()}") for k, (_, words, number) in new.items()]
    rows += [(110, f"{filler()} room size 555 123 4567 {filler()}"), (111, f"{filler()} reach me at " + " ".join(["123"] * 30)),
             (112, f"{filler()} paid by card 12 34. 567890 {filler()}")]
    got, text = results(docs_of(rows)), dict(rows)
    assert all((got[k][0].n_phone, got[k][0].n_card, got[k][0].n_learned) == (int(k < 40), int(k >= 40), 0) for k in range(80))
    for k, (kind, _, number) in new.items():
        at = text[k].index(number)
        assert (got[k][0].spans, got[k][0].n_learned) == (f"{kind}:{at}:{at + len(number)}", 1), text[k]
    assert [got[k][0].spans for k in (110, 111, 112)] == ["", "", ""]


def test_scores_equal_matrices(spark):
    r = random.Random(22)
    edges = {(f"x{r.randint(0, 30)}", f"p{r.randint(0, 12)}") for _ in range(150)}
    seeds = {(f"x{k}", "card" if k % 2 else "ip") for k in range(0, 12)}
    cores, patterns = sorted({c for c, _ in edges}), sorted({p for _, p in edges})
    m = np.array([[(c, p) in edges for c in cores] for p in patterns], dtype=float)
    out = pii.score_patterns(
        spark.createDataFrame(sorted(edges) * 2, "core string, pattern string"), spark.createDataFrame(sorted(seeds), "core string, kind string"), 3)
    got = {(x.pattern, x.kind): x.score for x in out.collect()}
    for kind in ("card", "ip"):
        known = np.array([(c, kind) in seeds for c in cores], dtype=float)
        w = known
        for _ in range(3):
            s = m @ w / (m.sum(1) + pii.SMOOTHING)
            w = np.maximum(known, np.minimum(m.T @ s / m.sum(0), 0.999))
        for p, want in zip(patterns, s, strict=True):
            assert abs(got.get((p, kind), 0.0) - want) < 1e-6


def test_empty_table(docs_of):
    assert pii.find_pii(docs_of([]).limit(0)).count() == 0
    assert results(docs_of([(1, None), (2, "plain text")]))[2][0].spans == ""
