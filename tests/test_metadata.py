import json

import pytest

from cohortlab import CUSTOMERS
from cohortlab import GRADUATES as G
from cohortlab.operators import features
from cohortlab.sources import metadata

# The keys of such a document; its figures are made up.
DOCUMENT = {
    "feature_names": ["branch_IT", "cgpa", "college_tier"], "branch_categories": ["CSE", "IT"], "branch_reference": "CSE",
    "numerical_cols": ["cgpa"], "ordinal_cols": ["college_tier"], "binary_cols": [], "log_transform": True,
    "feature_importance": [{"feature": "cgpa", "importance": 0.75}, {"feature": "branch_IT", "importance": 0.25}],
    "metrics": {
        "r2": 0.5, "mae": 1.25, "rmse": 2.5, "mape": 12.0, "mean_actual_salary": 60.5, "mean_predicted_salary": 59.25,
        "n_test_samples": 77,
    },
    "something_else": {"kept": "out"},
}


def test_document_of_another_tool(spark, tmp_path):
    (tmp_path / "metadata.json").write_text(json.dumps(DOCUMENT, indent=2))
    docs = metadata.read_documents(spark, str(tmp_path / "metadata.json"), G)
    assert docs.count() == 1
    roles = {}
    for r in metadata.roles(docs, G).orderBy("part", "position").collect():
        roles.setdefault(r["part"], []).append(r["name"])
    assert roles == {
        "features": DOCUMENT["feature_names"], "categories": ["CSE", "IT"], "reference": ["CSE"], "numeric": ["cgpa"],
        "ordinal": ["college_tier"],
    }
    assert [tuple(r) for r in metadata.importance(docs, G).orderBy("rank").collect()] == [(1, "cgpa", 0.75), (2, "branch_IT", 0.25)]
    assert metadata.metrics(docs, G).first().asDict() == {
        "r2": 0.5, "mae": 1.25, "rmse": 2.5, "mape": 12.0, "mean_actual": 60.5, "mean_predicted": 59.25, "n": 77,
    }
    # Its scaler is elsewhere.
    assert metadata.scaler(docs, G).count() == 0


def test_round_trip_keeps_every_digit(spark, graduates, tmp_path):
    encoding = features.fit_encoding(graduates.where("placed = 1"), G)
    path = str(tmp_path / "document")
    metadata.write_document(metadata.document(spark, encoding), path)
    docs = metadata.read_documents(spark, path, G)
    rows = metadata.scaler(docs, G).collect()
    assert [r["feature"] for r in rows] == encoding.names
    assert tuple(r["mean"] for r in rows) == encoding.means and tuple(r["deviation"] for r in rows) == encoding.deviations
    text = "".join(p.read_text() for p in tmp_path.glob("document/part-*"))
    written = json.loads(text)
    assert "\n" in text.strip() and written["branch_categories"] == list(encoding.categories)
    assert "metrics" not in written and written["numerical_cols"] == list(G.numeric)


def test_no_document(spark, tmp_path):
    (tmp_path / "broken.json").write_text('{"feature_names": [1')
    with pytest.raises(Exception, match="MALFORMED"):
        metadata.read_documents(spark, str(tmp_path / "broken.json"), G).collect()


def test_keys_follow_the_spec():
    assert metadata.keys(G)["mean_actual"] == "mean_actual_salary" and metadata.keys(G)["categories"] == "branch_categories"
    assert metadata.keys(CUSTOMERS)["categories"] == "segment_categories"
