"""The model studies run every setting at full size; fitting itself is replaced, since it takes long."""

from types import SimpleNamespace

from tidewatch.operators import models
from tidewatch.queries import QUERIES, quality


def test_seed_study_and_size_grid_are_whole(spark, sf, monkeypatch):
    fitted = []

    def fit(matrix, names, setting):
        fitted.append((setting.iterations, setting.depth, setting.seed))
        assert names == quality.FEATURES and len(names) > 40
        return SimpleNamespace(score=lambda rows: rows)

    monkeypatch.setattr(quality, "model_matrix", lambda spark, sf: spark.range(1).selectExpr("'test' as segment"))
    monkeypatch.setattr(models, "fit_boosted", fit)
    monkeypatch.setattr(models, "evaluate_scores", lambda scored, keys: {**keys, "pos": 1, "neg": 1, "auc": 0.5, "recall": 0.5})
    runs = [r.run for r in QUERIES["e19_m09_seed_variance_and_size_grid"](spark, sf).collect()]
    seeds = [1, 2, 3, 4, 5]
    grid = [(50, 3), (100, 4), (200, 5), (400, 6), (800, 8)]
    assert fitted == [(200, 5, s) for s in seeds] + [(n, d, 7) for n, d in grid]
    assert sorted(runs) == sorted([f"seed {s}" for s in seeds] + [f"{n} x {d}" for n, d in grid])
