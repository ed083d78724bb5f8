"""Line dedup against a dictionary version, and its edges."""

import random
import re

from tidewatch.llm.lines import SALTS, drop_lines
import tidewatch.llm.lines as lines


def brute(rows, ratio, least):
    pages, total = {}, {}
    for _, text, host in rows:
        if host is None:
            continue
        total[host] = total.get(host, 0) + 1
        for line in {x.strip(" ") for x in (text or "").split("\n")} - {""}:
            pages[host, line] = pages.get((host, line), 0) + 1
    out = []
    for doc, text, host in rows:
        if text is None:
            out.append((doc, None, 0, 0))
            continue
        own = text.split("\n")
        left = [x for x in own if not (host is not None and pages.get((host, x.strip(" ")), 0) >= least
                                       and pages[host, x.strip(" ")] > ratio * total[host])]
        out.append((doc, "\n".join(left), len(own), len(own) - len(left)))
    return sorted(out, key=str)


def rows_of(seed):
    r = random.Random(seed)
    words = ["menu", " menu ", "footer", "", "  ", "a b", "Ünï", "x" * 5000]
    rows = [(k, "\n".join(r.choice(words + [f"own {k} {j}"]) for j in range(r.randint(0, 6))), r.choice(["a", "b", None])) for k in range(80)]
    return rows + [(80, None, "a"), (81, "", "a"), (None, "menu\nrest", "a"), (3, "menu", "a"), (3, "menu", "a")]


def got(df):
    return sorted([tuple(x) for x in df.select("doc_id", "text", "n_lines", "n_dropped").collect()], key=str)


def test_equals_brute_force(docs_of):
    rows = rows_of(1)
    assert got(drop_lines(docs_of(rows), max_ratio=0.1, min_pages=3)) == brute(rows, 0.1, 3)


def test_without_broadcast_too(docs_of, monkeypatch):
    monkeypatch.setattr(lines, "BROADCAST_ROWS", -1)
    rows = rows_of(2)
    assert SALTS > 1
    assert got(drop_lines(docs_of(rows), max_ratio=0.1, min_pages=3)) == brute(rows, 0.1, 3)


def test_empty_table_and_clashing_names(docs_of):
    assert drop_lines(docs_of([]).limit(0)).count() == 0
    from pyspark.sql import functions as F

    docs = docs_of([(k, "same\nown %d" % k, "h") for k in range(9)]).withColumn("n_lines", F.lit("x")).withColumn("host", F.lit(1))
    out = drop_lines(docs)
    assert out.columns.count("n_lines") == 1 and {r.text for r in out.collect()} == {"own %d" % k for k in range(9)}
    assert {r.host for r in out.collect()} == {1}


def plain_passages(rows, least_words, share):
    """rows (id, text, host) of whole ids, short lines by the default rule, longer ones by copies."""
    is_long = lambda x: len(re.findall(r"[^\x20\x09-\x0D]+", x)) > least_words
    pages, total, first = {}, {}, {}
    for doc, text, host in rows:
        total[host] = total.get(host, 0) + 1
        for line in {x.strip(" ") for x in (text or "").split("\n")} - {""}:
            pages[host, line] = pages.get((host, line), 0) + 1
            first[host, line] = min(first.get((host, line), doc), doc)

    def bad(doc, host, line):
        n = pages.get((host, line), 0) if host is not None else 0
        if is_long(line):
            return n > 1 and n > share * total[host] and doc != first[host, line]
        return n >= lines.MIN_PAGES and n > lines.MAX_RATIO * total[host]

    out = []
    for doc, text, host in rows:
        own = (text or "").split("\n")
        left = [x for x in own if not bad(doc, host, x.strip(" "))]
        out.append((doc, "\n".join(left), len(own), len(own) - len(left)))
    return sorted(out, key=str)


def planted(seed):
    """Passages of 40 to 60 words, each on one to four of a host's 400 pages, or of a host's three."""
    r = random.Random(seed)
    passage = [" ".join(r.choices("abcdefgh", k=r.choice([40, 50, 51, 60]))) for _ in range(30)]
    rows = [[k, ["menu", f"own {k}"], f"host{k % 2}"] for k in range(800)] + [[k, [f"own {k}"], "small"] for k in range(800, 803)]
    for p in passage:
        for k in [*r.sample(range(800), r.randint(1, 8)), *r.sample(range(800, 803), r.randint(0, 3))]:
            rows[k][1].insert(r.randint(0, 2), r.choice([p, f" {p} "]))
    out = [(k, "\n".join(t), h) for k, t, h in rows]
    return [*out, (900, passage[0], None), (901, passage[0], None), (902, "", "small"), (2, out[2][1], "host1")]


def test_thin_passages_keep_one_copy(docs_of, monkeypatch):
    rows = planted(3)
    want = plain_passages(rows, 50, lines.LONG_RATIO)
    assert sum(x[3] for x in want) > 20 + sum(x[3] for x in brute(rows, lines.MAX_RATIO, lines.MIN_PAGES))
    assert got(drop_lines(docs_of(rows), long_words=50)) == want
    assert got(drop_lines(docs_of(rows), long_words=50, long_ratio=0.006)) == plain_passages(rows, 50, 0.006)
    monkeypatch.setattr(lines, "BROADCAST_ROWS", -1)
    monkeypatch.setattr(lines, "maybe_broadcast", lambda x: x)
    assert got(drop_lines(docs_of(rows), long_words=50)) == want
