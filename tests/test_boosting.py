"""Boosted trees of all folds, grown together, against Spark's single fits."""

import numpy as np
import pytest

from tessera.operators import boosting as BT
from tessera.operators import model as MD

from test_logistic import table


def test_folds_grown_together_score_as_single_fits(spark, monkeypatch):
    df = table(spark).persist()
    pipe = MD.build_pipeline("gbt", ["x", "z", "v", "same"], {"max_depth": 2, "learning_rate": 0.3, "max_iter": BT.KEEP + 2}, "label", "weight")
    chains = []
    fit = MD.fit_pipeline
    monkeypatch.setattr(MD, "fit_pipeline", lambda *a: (chains.append(1), fit(*a))[1])
    metrics, oof = MD.cross_validate(pipe, df, "id")
    got = {r.id: r for r in oof.collect()}
    assert not chains and metrics.count() == 5  # no fold has a chain of jobs of its own
    monkeypatch.setattr(MD, "boosting_plan", lambda *a: None)
    want = {r.id: r for r in MD.cross_validate(pipe, df, "id")[1].collect()}
    assert len(chains) == 5 and got.keys() == want.keys() and len(want) == 900
    for k, r in want.items():
        assert got[k].score == pytest.approx(r.score, abs=1e-9)
        assert (got[k].prediction, got[k].fold, got[k].label) == (r.prediction, r.fold, r.label)
    spark.catalog.clearCache()


def test_other_boosters_are_left_to_spark():
    def plan(**p):
        return MD.boosting_plan(MD.build_pipeline("gbt", ["x"], p, "label"))
    assert plan(max_depth=3) and plan(max_depth=3).depth == 3
    assert not plan(subsamplingRate=0.5) and not plan(max_depth=12) and not plan(min_samples_leaf=5)
    assert MD.boosting_plan(MD.build_pipeline("random_forest", ["x"], {}, "label")) is None


def test_cuts_hold_about_equal_weight():
    v = np.arange(100.0)
    cuts = BT.thresholds(v, np.ones(100), 3)
    assert list(cuts) == [24.5, 49.5, 74.5]
    assert list(BT.thresholds(np.array([3.0, 1.0, 1.0]), np.ones(3), 31)) == [2.0]
    assert not len(BT.thresholds(np.zeros(5), np.ones(5), 31))
