"""Statistics against plain Python; the learner against its own definition on small counts; held-out accuracy."""

import itertools
import math
import random
import re
from collections import Counter

from tidewatch.llm import quality

WORD = "[^\x20\x09-\x0D]+"


def plain(text):
    text = text or ""
    w = re.findall(WORD, text)
    c = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {k for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search(WORD, x)]
    return (len(w), sum(map(len, w)), len(re.findall(quality.SYMBOLS, text)), len(lines), len(lines) - len(set(lines)), len(covered))


def test_statistics(docs_of):
    r = random.Random(9)
    texts = [" ".join(r.choices(["a", "b", "c#", "é", "\n", "\t", "D!"], k=r.randint(0, 60))) for _ in range(120)]
    texts += [None, "", " \n \n", "a", "a b", "a b c", "x y z " * 400, "\n\n a\n a\n", "\x1c a\x85", "🙂 " * 70]
    rows = list(enumerate(texts)) + [(None, "a b a b a b a b"), (3, texts[3])]
    from pyspark.sql import functions as F

    docs = docs_of(rows).withColumn("n_words", F.lit("clash")).withColumn("i", F.lit(1))
    names = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]
    out = quality.judged(quality.statistics(docs), [])
    got = sorted([(x.doc_id, *[x[n] for n in names]) for x in out.collect()], key=str)
    assert got == sorted([(d, *plain(t)) for d, t in rows], key=str)
    for x in out.collect():
        failed = x.n_words < 50 or 100 * x.n_repeat_words > 50 * x.n_words
        assert (x.base_failed, x.kept, x.rule) == (failed, not failed, None)


def brute_learn(cells, min_rows, min_precision):
    """cells: (pruning, bad, levels, n). The same list by looking at every row for every condition."""
    options = [(s, level, up) for s, cuts in quality.CUTS.items() for level in range(1, len(cuts) + 1) for up in (True, False)]
    fits = lambda levels, c: (levels[c[0]] >= c[1]) == c[2]
    out = []
    while True:
        grown, rows = [], [c for c in cells if not c[0]]
        while True:
            p0, n0 = (sum(c[3] for c in rows if c[1] == b) for b in (True, False))
            if not p0 or not n0:
                break
            best, most = None, 1e-9
            for o in options:
                p, n = (sum(c[3] for c in rows if c[1] == b and fits(c[2], o)) for b in (True, False))
                gain = p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p else 0.0
                if p >= min_rows and gain > most:
                    best, most = o, gain
            if best is None:
                break
            grown.append(best)
            rows = [c for c in rows if fits(c[2], best)]
        best = None
        for k in range(1, len(grown) + 1):
            held = [c for c in cells if c[0] and all(fits(c[2], o) for o in grown[:k])]
            p, n = (sum(c[3] for c in held if c[1] == b) for b in (True, False))
            worth = (p - n) / (p + n) if p + n else -1.0
            if best is None or worth > best[0]:
                best = (worth, grown[:k], p, n)
        if best is None or best[2] < min_rows or best[2] < min_precision * (best[2] + best[3]):
            break
        out.append((best[1], best[2] + best[3], best[2]))
        cells = [c for c in cells if not all(fits(c[2], o) for o in best[1])]
    return out


def made_cells(seed):
    r = random.Random(seed)
    cells = Counter()
    for _ in range(1500):
        levels = {s: r.randint(0, len(c)) for s, c in quality.CUTS.items()}
        bad = (levels["symbol_share"] >= 8 and levels["mean_word"] < 9) or levels["repeat_share"] >= 13 or r.random() < 0.02
        if levels["symbol_share"] >= 8 and r.random() < 0.03:
            bad = False
        cells[r.random() < 0.33, bad, tuple(sorted(levels.items()))] += r.randint(1, 3)
    return [(p, b, dict(v), n) for (p, b, v), n in cells.items()]


def test_learner_equals_brute_force(spark):
    names = list(quality.CUTS)
    for seed, precision in itertools.product((10, 11), (0.6, 0.95)):
        cells = made_cells(seed)
        schema = "pruning boolean, bad boolean, " + ", ".join(f"{n} int" for n in names) + ", n long"
        frame = spark.createDataFrame([(p, b, *[v[n] for n in names], k) for p, b, v, k in cells], schema).coalesce(2).cache()
        rules = quality.learn(frame, 3, precision)
        got = [([(c.share, c.level, c.upward) for c in r.conditions], r.rows, r.bad) for r in rules]
        assert got == brute_learn(cells, 3, precision)
        assert precision > 0.9 or got


def test_held_out_accuracy_and_order(docs_of, spark):
    r = random.Random(12)

    def text(kind):
        words = ["word%d" % r.randint(0, 3000) for _ in range(r.randint(60, 120))]
        if kind == "symbols":
            words = [w + r.choice(["###", "%%%", "$$$"]) for w in words]
        if kind == "shout":
            words = [w.upper() for w in words]
        return " ".join(words)

    kinds = [r.choice(["fine", "fine", "fine", "symbols", "shout"]) for _ in range(1200)]
    docs = docs_of([(k, text(kind)) for k, kind in enumerate(kinds)])
    labels = spark.createDataFrame(
        [(k, int(kind == "fine"), 0) for k, kind in enumerate(kinds[:700])] + [(None, 0, 0), (1, None, 0)], "doc_id long, quality int, toxic int")
    stats, rules = quality.fit(docs, labels)
    assert len(rules) >= 2
    out = {x.doc_id: x for x in quality.judged(stats, rules).collect()}
    held = range(700, 1200)
    assert sum(out[k].kept == (kinds[k] == "fine") for k in held) >= 0.98 * len(held)
    assert {x.rule for x in out.values()} == {None, *range(1, len(rules) + 1)}


def test_no_documents_or_labels(docs_of, spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    stats, rules = quality.fit(docs_of([]).limit(0), none)
    assert rules == [] and stats.count() == 0
    stats, rules = quality.fit(docs_of([(1, "a " * 60)]), none)
    assert rules == [] and quality.judged(stats, rules).first().kept is False
