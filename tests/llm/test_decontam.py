"""Decontamination against a search for every window at every place."""

import hashlib
import random
import re

from tidewatch.llm import decontam


def words(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", text)


def brute(rows, items, window):
    wins = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            wins.setdefault(tuple(w[i : i + window]), set()).add(item)
    out = []
    for doc, text in rows:
        w = words(text)
        hit, names = set(), set()
        for win, own in wins.items():
            for i in range(len(w) - len(win) + 1):
                if tuple(w[i : i + len(win)]) == win:
                    hit |= set(range(i, i + len(win)))
                    names |= {str(x) for x in own if x is not None}
        out.append((doc, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def case(seed):
    r = random.Random(seed)
    vocabulary = ["w%d" % k for k in range(25)] + ["É", "é", "the", "the"]
    items = [(k, " ".join(r.choices(vocabulary, k=r.choice([1, 2, 3, 4, 5, 9, 10, 11, 30])))) for k in range(25)]
    items += [(25, None), (26, " .,- "), (None, "q1 q2 q3 q4 q5"), (3, items[3][1]), (77, items[4][1].upper()), (10, "aa " * 14)]
    rows = []
    for k in range(150):
        w = r.choices(vocabulary, k=r.randint(0, 40))
        for _ in range(r.choice([0, 0, 1, 3])):
            src = words(r.choice(items)[1])
            a = r.randint(0, max(0, len(src) - 1))
            w[r.randint(0, len(w)) : 0] = src[a : a + r.randint(1, 25)]
        rows.append((k, r.choice([" ", ", ", "\n", "--"]).join(w)))
    return rows + [(150, None), (151, ""), (152, "aa " * 40), (None, items[0][1]), (7, "q1 q2 q3 q4 q5 q6"), (7, rows[7][1]), rows[8]], items


def test_equals_search_at_every_place(docs_of, spark):
    for seed, window in ((13, 10), (14, 3)):
        rows, items = case(seed)
        bench = spark.createDataFrame(items, "item_id long, text string")
        out = decontam.decontaminate(docs_of(rows), bench, window=window)
        names = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
        assert sorted([tuple(x[n] for n in names) for x in out.collect()], key=str) == brute(rows, items, window)
        left = decontam.drop_contaminated(docs_of(rows), bench, window=window)
        clean = sorted([x[0] for x in brute(rows, items, window) if not x[5]], key=str)
        assert sorted([x.doc_id for x in left.collect()], key=str) == clean
        assert left.columns == docs_of(rows).columns


def test_no_items_or_documents(docs_of, spark):
    none = spark.createDataFrame([], "item_id long, text string")
    out = decontam.decontaminate(docs_of([(1, "a b"), (2, None)]), none).collect()
    assert sorted((x.doc_id, x.n_words, x.contaminated) for x in out) == [(1, 2, False), (2, 0, False)]
    bench = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert decontam.decontaminate(docs_of([]).limit(0), bench).count() == 0
    assert decontam.drop_contaminated(docs_of([(1, "x")]), none).count() == 1
