"""Every stage of the pipeline on its own input, against the plain versions of its operator."""

import corpus_pipeline
from tidewatch.llm import lines, packing
from tidewatch.llm.shared import stored, table

from test_decontam import brute as plain_decontamination
from test_lines import plain_passages
from test_neardup import brute as plain_components
from test_quality import plain as plain_statistics


def read(df):
    return sorted([(r.doc_id, r.text, r.source) for r in df.collect()])


def test_stages_in_order():
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality rules", "line dedup", "near dedup", "decontamination", "packing"]


def test_each_stage_on_its_input(spark, sf):
    docs = table(spark, sf, "documents")
    steps = dict(corpus_pipeline.STAGES)
    items = [(r.item_id, r.text) for r in table(spark, sf, "benchmark").collect()]
    given = read(docs)

    kept = stored(steps["quality rules"](spark, docs, sf), "t")
    passing = []
    for d, t, s in given:
        n, _, _, _, _, repeated = plain_statistics(t)
        if not (n < 50 or 100 * repeated > 50 * n):
            passing.append((d, t, s))
    assert kept.columns == docs.columns and set(read(kept)) <= set(passing)
    assert len(read(kept)) >= 0.9 * len(passing)

    less = stored(steps["line dedup"](spark, kept, sf), "t")
    assert less.columns == docs.columns
    want = plain_passages(read(kept), lines.LONG_WORDS, lines.LONG_RATIO)
    assert sorted((d, t) for d, t, _ in read(less)) == sorted((d, t) for d, t, _, _ in want)
    assert all(r.n_chars == len(r.text) for r in less.collect())

    single = stored(steps["near dedup"](spark, less, sf), "t")
    component = {d: c for d, _, c in plain_components([(d, t) for d, t, _ in read(less)], 5, 80)}
    assert read(single) == [x for x in read(less) if component[x[0]] == x[0]]

    clean = stored(steps["decontamination"](spark, single, sf), "t")
    bad = {x[0] for x in plain_decontamination([(d, t) for d, t, _ in read(single)], items, 10) if x[5]}
    assert read(clean) == [x for x in read(single) if x[0] not in bad] and bad

    pieces = steps["packing"](spark, clean, sf).collect()
    assert {p.doc_id for p in pieces} == {d for d, _, _ in read(clean)}
    assert pieces and set(pieces[0].asDict()) == {c.split()[0] for c in packing.SCHEMA.split(", ")}
    whole = corpus_pipeline.run(spark, sf)
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    assert sorted(tuple(p[c] for c in columns) for p in whole.select(*columns).collect()) == sorted(tuple(p[c] for c in columns) for p in pieces)


def test_repeated_rows_and_rows_without_an_id_leave_one_document(spark, sf, docs_of, tmp_path):
    text = " ".join(f"w{k}" for k in range(60))
    rows = [(1, text), (1, text), (None, text), (None, text + " more"), (2, text), (3, "another " * 7), (None, "alone here " * 9), (4, ""), (5, ""), (4, None)]
    docs_of(rows).write.parquet(str(tmp_path / "docs"))
    out = corpus_pipeline.near_dedup(spark, spark.read.parquet(str(tmp_path / "docs")), sf)
    assert out.columns == corpus_pipeline.COLUMNS
    assert sorted((r.doc_id or 0, r.text or "") for r in out.collect()) == sorted([(1, text), (3, "another " * 7), (0, "alone here " * 9), (4, ""), (5, ""), (4, "")])


def test_stages_on_empty_tables(spark, sf, docs_of):
    docs = docs_of([]).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf).count() == 0
