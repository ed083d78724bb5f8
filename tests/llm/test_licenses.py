"""Units, cosines and inheritance against plain Python; whole license files and wrapped headers."""

import math
import random
import re
import site
from collections import Counter
from pathlib import Path

import pytest

from tidewatch.llm import licenses
from tidewatch.llm.license_texts import TEXTS


def words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", text.lower())


def units(lines, vocabulary):
    """(first, last, words) of the units of a file's lines, a list of words each."""
    telling, placed, k = vocabulary - set(licenses.COMMON), [], 0
    for at, w in enumerate(lines):
        n_own = sum(x in vocabulary for x in w)
        some = any(x in telling for x in w)
        if some and 2 * n_own >= len(w):
            placed.append((k, at, w))
        k += some or n_own < len(w)
    out, run = [(at, at, w) for _, at, w in placed], []
    for x in [*placed, (math.inf, 0, [])]:
        if run and x[0] != run[-1][0] + 1:
            if len(run) > 1:
                out.append((run[0][1], run[-1][1], sum((r[2] for r in run), [])))
            run = []
        run.append(x)
    if len(placed) > 1 and 2 * len(placed) >= len(lines):
        out.append((0, len(lines) - 1, sum(lines, [])))
    return out


def brute(rows, templates, min_cosine, share):
    wanted = [(name, Counter(words(text))) for name, text in templates]
    vocabulary = set().union(*(w for _, w in wanted))
    df = Counter(t for _, _, text in rows for t in set(words(text or "")))

    def vector(counts):
        v = {t: (1 + math.log(n)) * (math.log((1 + len(rows)) / (1 + df[t])) + 1) for t, n in counts.items()}
        length = math.sqrt(sum(x * x for x in v.values()))
        return {t: x / length for t, x in v.items()}

    wanted = [(name, vector(w)) for name, w in wanted]
    found = []
    for doc, path, text in rows:
        lines = [w for w in map(words, (text or "").split("\n")) if w]
        best, near = None, set()
        for first, last, unit in units(lines, vocabulary):
            v = vector(Counter(unit))
            hits = [(c, name) for name, w in wanted if (c := round(sum(x * w.get(t, 0) for t, x in v.items()), 6)) >= min_cosine]
            if hits:
                near |= set(range(first, last + 1))
                c, name = max(hits)
                best = max([(round(c * len(unit), 6), c, name), *([best] if best else [])])
        found.append((doc, path, len(lines), len(near), best))
    declared = {}
    for _, path, n, near, best in found:
        if path is not None and near and near >= share * n:
            d = path.rpartition("/")[0]
            declared.setdefault(d, {}).setdefault(best[2], 0)
            declared[d][best[2]] += 1
    out = []
    for doc, path, n, near, best in found:
        up = None
        if path is not None:
            d = path.rpartition("/")[0]
            while up is None:
                if d in declared:
                    up = max((k, name) for name, k in declared[d].items())[1]
                if d == "":
                    break
                d = d.rpartition("/")[0]
        own = best[2] if best else None
        out.append((doc, path, n, near, own, best and round(best[1], 5), up, own or up))
    return sorted(out, key=str)


NAMES = ["doc_id", "path", "n_lines", "n_license_lines", "own_license", "cosine", "inherited_license", "license"]


def got(files):
    return sorted([tuple(round(v, 5) if isinstance(v := x[n], float) else v for n in NAMES) for x in licenses.scan(files).collect()], key=str)


def wrapped(text, width, mark, r):
    """The text's words in lines of some width behind a comment mark, with blank lines here and there."""
    out, line = [], ""
    for w in text.split():
        if len(line) + len(w) > width:
            out.append(mark + line)
            if r.random() < 0.1:
                out.append(mark.strip())
            line = ""
        line += " " + w
    return "\n".join([*out, mark + line])


SCHEMA = "doc_id long, path string, text string"


def test_equals_plain_python(spark):
    r = random.Random(23)
    notices = [line for _, line in licenses.NOTICES]
    headers = [text for _, text in TEXTS if len(text.split()) < 120]
    other = ["plain words in a line of text", "the work is done", "licensed under", "", "  ", "all rights", "License version 2.0 and the public", "of the and in", "zq xw yv"]
    places = ["a/b/c/%d", "a/b/%d", "a/%d", "%d", "x/y/%d", "/root/%d", None]
    rows = []
    for k in range(110):
        own = [r.choice(notices + other * 8) for _ in range(r.randint(0, 6))]
        if r.random() < 0.3 and own:
            own[0] = "# " + own[0].upper()
        if r.random() < 0.3:
            own.insert(r.randint(0, len(own)), wrapped(r.choice(headers), r.choice([30, 60, 90]), r.choice(["# ", "// ", ""]), r))
        p = r.choice(places)
        rows.append((k, p and p % k, "\n".join(own)))
    rows += [(200, "a/200", None), (201, "a/201", ""), (None, "a/b/x", notices[0]), (3, rows[3][1], rows[3][2]), (202, None, notices[0]), (203, "z", "w " * 9000)]
    files = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'clash' as license", "0 as n_lines", "1 as unit", "2 as term")
    want = brute(rows, licenses.TEMPLATES, licenses.MIN_COSINE, licenses.FILE_SHARE)
    assert got(files) == want
    assert sum(x[4] is None and x[6] is not None for x in want) > 5


@pytest.fixture(scope="module")
def filler():
    r = random.Random(5)
    return lambda n: "\n".join(" ".join("".join(r.choices("bcdfgklmprstz", k=5)) for _ in range(9)) for _ in range(n))


def test_wrapped_headers_in_code_and_whole_files(spark, filler):
    r = random.Random(6)
    rows, want = [], {}
    for k, (name, text) in enumerate(TEXTS):
        rows.append((k, f"src/{k}/LICENSE", f"Copyright (c) 2021 Some Person\n\n{text}\n"))
        want[k] = name
        rows.append((1000 + k, f"src/{k}/deep/er/code", filler(4)))  # inherits from the license file above it
        if len(text.split()) < 120:
            rows.append((100 + k, f"other/{k}", filler(3) + "\n" + wrapped(text, 44, "# ", r) + "\n" + filler(5)))
            want[100 + k] = name
    rows += [(500 + k, f"plain/{k}", filler(6)) for k in range(40)]
    found = {x.doc_id: x for x in licenses.scan(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert {k: found[k].own_license for k in want} == want
    assert all(found[1000 + k].license == name and found[1000 + k].own_license is None for k, (name, _) in enumerate(TEXTS))
    assert all(found[500 + k].license is None for k in range(40))


def test_license_files_of_installed_packages(spark, filler):
    """Files that no template was taken from."""
    known = {"urllib3": "MIT", "pluggy": "MIT", "iniconfig": "MIT", "zstandard": "BSD-3-Clause", "requests": "Apache-2.0", "xxhash": "BSD-2-Clause", "psutil": "BSD-3-Clause"}
    rows, want = [], {}
    for folder in map(Path, site.getsitepackages()):
        for name, license in known.items():
            for path in folder.glob(f"{name}-*.dist-info/**/LICENSE*"):
                if path.is_file():
                    want[len(rows)] = (license, path.name)
                    rows.append((len(rows), f"{name}/{path.name}", path.read_text(encoding="utf-8", errors="replace")))
    if not rows:
        pytest.skip("no license files here")
    rows += [(500 + k, f"plain/{k}", filler(6)) for k in range(60)]
    found = {x.doc_id: x.own_license for x in licenses.scan(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert {k: found[k] for k in want} == {k: license for k, (license, _) in want.items()}


def test_notices_and_empty_table(spark):
    rows = [(k, f"f/{k}", f"some code\n// {line}.\nmore code") for k, (_, line) in enumerate(licenses.NOTICES)]
    files = spark.createDataFrame(rows, SCHEMA)
    found = {x.doc_id: x.own_license for x in licenses.scan(files).collect()}
    assert found == {k: name for k, (name, _) in enumerate(licenses.NOTICES)}
    assert licenses.scan(files.limit(0)).count() == 0
