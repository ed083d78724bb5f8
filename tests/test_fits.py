"""Studies fit beside each other and keep their order."""

import threading
from types import SimpleNamespace

import pytest

from tidewatch.operators import models


def test_fits_run_beside_each_other(spark, monkeypatch):
    matrix = spark.createDataFrame([(c, "test") for c in "abcdef"], "country string, segment string")
    meet = threading.Barrier(2, timeout=60)

    def fit(rows, names):
        meet.wait()  # one fit alone would wait in vain
        return SimpleNamespace(score=lambda rows: rows)

    monkeypatch.setattr(models, "evaluate_scores", lambda scored, keys: {**keys, "pos": 1, "neg": scored.count(), "auc": 0.5, "recall": 0.5})
    out = models.leave_one_out(matrix, "country", list("fbaecd"), ["x"], fit).collect()
    assert [(r.held_out, r.neg) for r in out] == [(c, 1) for c in "fbaecd"]
    out = models.ablations(matrix, {"g": ["x"], "h": ["y"]}, fit).collect()
    assert [(r.feature_group, r.kind) for r in out] == [("g", "without"), ("g", "alone"), ("h", "without"), ("h", "alone")]


def test_an_error_of_a_fit_ends_the_study(spark):
    def fit(rows, names):
        raise ValueError("no rows")

    with pytest.raises(ValueError, match="no rows"):
        models.leave_one_out(spark.createDataFrame([("a", "test")], "country string, segment string"), "country", list("abcdefgh"), ["x"], fit)


def test_boosted_fits_run_beside_each_other_on_rows_prepared_once(spark, monkeypatch):
    matrix = spark.createDataFrame([("test",)], "segment string")
    meet, made = threading.Barrier(2, timeout=60), []

    def boosted(rows, setting):
        rows.get()
        meet.wait()  # one fit alone would wait in vain
        return SimpleNamespace(score=lambda rows, name="score": rows)

    monkeypatch.setattr(models.Prepared, "_make", lambda self: made.append(1) or ([], [], matrix))
    monkeypatch.setattr(models, "_boosted", boosted)
    monkeypatch.setattr(models, "evaluate_scores", lambda scored, keys: {**keys, "pos": 1, "neg": scored.count(), "auc": 0.5, "recall": 0.5})
    out = models.seed_variance(matrix, ["x"], [4, 2, 3, 1]).collect()
    assert [r.seed for r in out] == ["4", "2", "3", "1"] and made == [1]
    out = models.size_grid(matrix, ["x"], [models.Boost(9, 2), models.Boost(3, 1)]).collect()
    assert [(r.iterations, r.depth) for r in out] == [("9", "2"), ("3", "1")] and made == [1, 1]



def test_each_row_goes_through_the_trees_once(spark):
    runs = spark.sparkContext.accumulator(0)
    names = ["x", "y"]
    rows = spark.range(400).selectExpr("id as tx_id", "cast(id % 37 as double) as x", "cast(id * 7 % 41 as double) as y")
    counted = rows.rdd.map(lambda r: (runs.add(1), r)[1]).toDF(rows.schema)
    forest = models.fit_isolation_forest(rows, names, trees=8)
    out = forest.score(counted)
    assert out.count() == 400 and out.filter("anomaly between 0 and 1").count() == 400
    assert runs.value == 400



def test_quantiles_and_drift_of_few_groups_are_the_same(spark):
    from tidewatch.operators.evaluate import psi
    from tidewatch.operators.order import quantiles

    rows = spark.range(3000).selectExpr("if(id % 3 = 0, 'a', 'b') as name", "cast(id * 31 % 997 as double) as value")
    plain, few = (sorted(map(tuple, quantiles(rows, "value", {"m": 0.5}, ["name"], few_groups=k).collect())) for k in (False, True))
    assert plain == few and len(few) == 2
    other = rows.filter("value > 200")
    plain, few = (sorted((r[0], round(r[1], 9)) for r in psi(rows, other, "value", ["name"], few_groups=k).collect()) for k in (False, True))
    assert plain == few and len(few) == 2


def test_baselines_share_their_rows_and_run_beside_each_other(spark, monkeypatch):
    matrix = spark.createDataFrame([("test", True)], "segment string, calibration boolean")
    meet, made = threading.Barrier(2, timeout=60), []

    def fit(rows, names, shared):
        assert shared == "shared"
        meet.wait()  # one fit alone would wait in vain
        return SimpleNamespace(score=lambda rows, name="score": rows.selectExpr("*", f"0.5D as {name}"))

    monkeypatch.setattr(models, "training_rows", lambda matrix, names: made.append(1) or "shared")
    for name in ("fit_logistic", "fit_random_forest"):
        monkeypatch.setattr(models, name, fit)
    monkeypatch.setattr(models, "fit_platt", lambda scored: (1.0, 0.0))
    monkeypatch.setattr(models, "evaluate_scores", lambda scored, keys: {**keys, "pos": 1, "neg": scored.count(), "auc": 0.5, "recall": 0.5})
    out = models.baselines(matrix, ["x"]).collect()
    assert [r.model for r in out] == ["logistic", "logistic, Platt", "random forest"] and made == [1]


def test_a_fit_on_shared_rows_is_the_same(spark):
    rows = spark.range(400).selectExpr(
        "id as tx_id", "'train' as segment", "hash(id) % 5 = 0 as is_fraud", "if(id % 9 = 0, null, cast(hash(id) % 5 + id % 7 as double)) as a", "cast(id % 11 as double) as b", "cast(null as double) as c")
    names = ["a", "b", "c"]
    shared = models.training_rows(rows, names)
    assert shared[0] == ["a", "b"]
    for fit in (models.fit_logistic, lambda m, n, **k: models.fit_random_forest(m, n, trees=5, **k)):
        alone, both = (sorted((r.tx_id, round(r.score, 9)) for r in m.score(rows).collect()) for m in (fit(rows, names), fit(rows, names, shared=shared)))
        assert alone == both and len({s for _, s in alone}) > 5


def _counted(spark):
    """A small matrix whose rows count how often they are made."""
    runs = spark.sparkContext.accumulator(0)
    rows = spark.range(600).selectExpr(
        "id as tx_id", "if(id % 4 = 0, 'test', 'train') as segment", "hash(id) % 5 = 0 as is_fraud",
        "element_at(array('A', 'B', 'C', null), cast(id % 7 % 4 as int) + 1) as country",
        "cast(hash(id) % 5 + id % 7 as double) as a", "if(id % 9 = 0, null, id % 11) as b",
        "if(id % 13 = 0, double('NaN'), double(hash(id * 3) % 8)) as c", "cast(null as double) as d", "id % 3 = 0 as e")
    return rows, rows.rdd.map(lambda r: (runs.add(1), r)[1]).toDF(rows.schema), runs


def test_leaving_one_out_makes_its_rows_once_for_all_fits(spark):
    rows, counted, runs = _counted(spark)
    out = models.leave_one_out(counted, "country", ["C", "A", "B"], list("abcde")).collect()
    assert runs.value <= 4 * rows.count()  # each fit alone reads them five times
    plain = models.leave_one_out(rows, "country", ["C", "A", "B"], list("abcde"), models.fit_logistic).collect()
    assert [(r.held_out, r.pos, r.neg, round(r.auc, 9), r.recall) for r in out] == [(r.held_out, r.pos, r.neg, round(r.auc, 9), r.recall) for r in plain]
    assert models.packed(rows, list("abcde"), ["tx_id"])[1] == ["a", "e"]


def test_ablations_make_their_rows_once_for_all_fits(spark):
    rows, counted, runs = _counted(spark)
    groups = {"x": ["b", "a"], "y": ["c", "d"], "z": ["e"]}
    out = models.ablations(counted, groups).collect()
    assert runs.value <= 8 * rows.count()  # six fits alone read them five times each
    plain = models.ablations(rows, groups, models.fit_logistic).collect()
    assert [(r.feature_group, r.kind, r.pos, r.neg, round(r.auc, 9), r.recall) for r in out] == [
        (r.feature_group, r.kind, r.pos, r.neg, round(r.auc, 9), r.recall) for r in plain]


def test_one_ranking_gives_both_rank_figures(spark):
    from tidewatch.operators import evaluate as ev

    rows = spark.range(3000).selectExpr(
        "if(id % 50 = 0, null, if(id % 51 = 0, double('NaN'), round(abs(hash(id)) % 1000 / 700D, 2))) as score",
        "if(id % 40 = 0, null, hash(id, 1) % 9 = 0) as is_fraud")
    for part in (rows, rows.filter("is_fraud"), rows.filter("not is_fraud"), rows.filter("is_fraud is null"), rows.limit(0)):
        hist = ev.histogram(part)
        ranked, point = ev.auc(hist).first(), ev.budget_point(hist).first()
        both = ev.rank_summary(hist).first()
        assert tuple(both) == (ranked.pos, ranked.neg, ranked.auc, point.recall if point else None)


def test_medians_are_exact_and_gather_few_values(spark):
    import statistics

    from tidewatch.operators import order

    columns = {"a": "double(abs(hash(id)) % 100000)", "b": "if(id % 3 = 0, null, id % 2)", "c": "if(id > 7, null, double(id) * id)", "d": "cast(null as int)", "e": "id = 5", "f": "-double(id)"}
    for size in (1, 2, 9, 12_000):
        rows = spark.range(size).selectExpr(*[f"{e} as {n}" for n, e in columns.items()])
        got, have = order.medians(rows, list(columns)), rows.collect()
        for n in columns:
            values = [float(r[n]) for r in have if r[n] is not None]
            assert got.get(n) == (statistics.median(values) if values else None), (n, size)


def test_only_values_near_the_median_meet_in_its_histogram(spark, monkeypatch):
    from tidewatch.operators import order

    sizes, plain = [], order.stored
    monkeypatch.setattr(order, "stored", lambda df, name: (lambda out: sizes.append(out.count()) or out)(plain(df, name)))
    rows = spark.range(20_000).selectExpr("id as tx_id", "double(hash(id)) as x", "double(hash(id, 1)) as y")
    models.fit_isolation_forest(rows, ["x", "y"], trees=4)
    assert sizes and max(sizes) < 1_000  # all values are 40,000


def test_a_block_walks_trees_as_a_row_does():
    import numpy as np
    import pandas as pd

    rng, names = np.random.default_rng(5), ["a", "b", "c"]
    for size in (1, 2, 40, 256):
        rows = pd.DataFrame(rng.normal(size=(size, 3)).round(1), columns=names).assign(tree=3, tx_id=range(size))
        tree = models._grow(names, 7, 8)(rows)[["feature", "cut", "l", "r", "path"]].to_numpy(float)
        x = rng.normal(size=(50, 3)).round(1)
        x[4, 1] = np.nan
        expected = []
        for values in x:
            at = 0
            while tree[at, 0] >= 0:
                at = int(tree[at, 2] if values[int(tree[at, 0])] <= tree[at, 1] else tree[at, 3])
            expected.append(tree[at, 4])
        assert models._depths([models._walked(tree)], x.T.ravel(), 50).tolist() == expected


def test_boosted_fits_read_prepared_rows_that_are_made_once(spark):
    rows, counted, runs = _counted(spark)
    part = "if(tx_id % 5 = 1, 'validation', segment) as segment"
    matrix = counted.selectExpr("tx_id", part, "is_fraud", "a", "b", "e", "tx_id % 10 = 1 as calibration")
    names = ["a", "b", "e"]
    out = models.size_grid(matrix, names, [models.Boost(2, 2), models.Boost(3, 1), models.Boost(2, 1)]).collect()
    assert [(r.iterations, r.depth) for r in out] == [("2", "2"), ("3", "1"), ("2", "1")]
    # Counted, looked at for values, medians and weights, made, and scored once a fit; each fit alone makes them four times more.
    assert runs.value <= 10 * rows.count()
