"""The queries of learned results ask for the whole fit and the whole grid."""

from types import SimpleNamespace

from conftest import SMALL

from cohortlab.operators import learn
from cohortlab.plans import queries


def test_queries_ask_for_the_whole_job(spark, monkeypatch):
    asked = []

    def train(df, spec, **options):
        asked.append(options)
        return SimpleNamespace(grid=[{"maxIter": 1, "mae_log": 0.5, "is_best": True}])

    monkeypatch.setattr(queries, "train", train)
    monkeypatch.setattr(queries.bundles, "save", lambda *_: None)
    monkeypatch.setattr(queries, "_SAVED", {})
    queries.saved_model(spark, SMALL)
    assert queries.grid_search(spark, SMALL).count() == 1
    assert asked == [{"tune": False} | learn.UNTUNED, {"tune": True, "grid": learn.GRID, "folds": learn.FOLDS}]
