import math

import numpy as np
import pytest

from cohortlab import GRADUATES as G
from cohortlab import CohortSpec
from cohortlab.functions.names import feature_names, label_features
from cohortlab.operators import clean, features, learn, score
from dataclasses import replace

# Fixed value: the order of the encoded features.
ORDER = (
    "branch_Civil branch_ECE branch_EEE branch_IT branch_Mechanical cgpa coding_score "
    "communication_score aptitude_score internships projects backlogs resume_score skill_score "
    "college_tier python_skill dsa_skill ml_skill web_dev_skill"
).split()


def test_feature_order_and_dropped_category(graduates):
    encoding = features.fit_encoding(graduates, G)
    assert encoding.names == ORDER and encoding.dropped == "CSE"
    assert feature_names(G) == ORDER


def test_fit_equals_numpy(graduates):
    rows = graduates.toPandas()
    encoding = features.fit_encoding(graduates, G)
    for c in G.scalars:
        i = encoding.names.index(c)
        assert math.isclose(encoding.means[i], rows[c].mean(), rel_tol=1e-12)
        assert math.isclose(encoding.deviations[i], rows[c].std(ddof=0), rel_tol=1e-9)
    i = encoding.names.index("branch_IT")
    assert math.isclose(encoding.means[i], (rows.branch == "IT").mean(), rel_tol=1e-12)


def test_standardised_columns_have_no_mean_and_unit_deviation(graduates):
    z = features.standardize(graduates, features.fit_encoding(graduates, G)).toPandas().drop(columns="student_id")
    assert np.allclose(z.mean(), 0, atol=1e-9) and np.allclose(z.std(ddof=0), 1, atol=1e-9)


def test_only_seen_categories_are_fitted(make):
    df = make({"branch": "IT"}, {"branch": "EEE"}, {"branch": "Physics"}, {"branch": None})
    encoding = features.fit_encoding(df, G)
    # Unlisted and missing categories count as CSE before the fit.
    assert encoding.categories == ("CSE", "EEE", "IT")
    late = make({"branch": "Civil"}, {"branch": None}, {"branch": "IT"})
    hot = features.one_hot(late, encoding).orderBy("student_id").collect()
    assert [(r["branch_EEE"], r["branch_IT"]) for r in hot] == [(0, 0), (0, 0), (0, 1)]


def test_unlisted_categories_differ_before_a_fit_and_in_scoring(make):
    """Before a fit they count as the given default, in scoring as the first fitted category."""
    spec = replace(G, default_segment="IT")
    encoding = features.fit_encoding(make({"branch": "ECE"}, {"branch": "IT"}, {"branch": "Physics"}), spec)
    assert encoding.categories == ("ECE", "IT") and encoding.means[0] == 2 / 3
    odd = make({"branch": "Physics"})
    assert features.one_hot(odd, encoding).first()["branch_IT"] == 1.0
    assert odd.selectExpr(f"{encoding.clean_sql()} AS c").first()["c"] == "ECE"


def test_zero_variance_is_only_centred(make):
    encoding = features.fit_encoding(make({"cgpa": 7.0}, {"cgpa": 7.0}), G)
    z = features.standardize(make({"cgpa": 7.0}, {"cgpa": 9.0}), encoding).orderBy("student_id").collect()
    assert [r["z_cgpa"] for r in z] == [0.0, 2.0]


def test_fit_on_nothing_or_without_values(make):
    with pytest.raises(ValueError, match="no rows"):
        features.fit_encoding(make({}).where("false"), G)
    with pytest.raises(ValueError, match="cgpa"):
        features.fit_encoding(make({"cgpa": None}), G)


def test_category_names_with_quotes(make):
    names = ("B.Tech", "O'Neil\\x", "a `tick`", 'say "hi"')
    odd = replace(G, segments=names)
    df = make(*({"branch": n} for n in names))
    encoding = features.fit_encoding(df, odd)
    hot = features.one_hot(df, encoding).orderBy("student_id").collect()
    assert [tuple(r)[1:4] for r in hot] == [(0, 0, 0), (1, 0, 0), (0, 1, 0), (0, 0, 1)]
    weights = {"branch_a `tick`": 0.5}
    rows = score.explain(
        df, learn.weighted_sum(encoding, weights, 3.0), encoding.names, [*weights.items()], odd
    ).orderBy("student_id").collect()
    best = max(range(4), key=lambda i: rows[i]["predicted_value"])
    assert names[best] == "a `tick`" and rows[0]["top_factors"][0]["feature"] == "branch_a `tick`"


def test_leakage_guard():
    with pytest.raises(ValueError, match="job_role"):
        replace(G, numeric=(*G.numeric, "job_role"))
    assert isinstance(G, CohortSpec)


def test_clean_category(make):
    df = make({"branch": "IT"}, {"branch": "Physics"}, {"branch": None})
    rows = clean.clean_category(df, G, ["IT", "ECE"], "ECE").orderBy("student_id").collect()
    assert [r["segment_clean"] for r in rows] == ["IT", "ECE", "ECE"]
    assert [r["branch"] for r in rows] == ["IT", "Physics", None]


def test_split_is_stable(graduates):
    one = {r[0]: r["part"] for r in features.split(graduates.coalesce(1), G).select("student_id", "part").collect()}
    two = {r[0]: r["part"] for r in features.split(graduates.repartition(13), G).select("student_id", "part").collect()}
    assert one == two
    share = sum(p == "train" for p in one.values()) / len(one)
    assert 0.75 < share < 0.85
    other = features.split(graduates, G, seed=1).select("student_id", "part").collect()
    assert {r[0]: r[1] for r in other} != one


def test_folds_cover_all_rows(graduates):
    sizes = {r["fold"]: r["count"] for r in features.folds(graduates, G, 5).groupBy("fold").count().collect()}
    assert set(sizes) == set(range(5)) and sum(sizes.values()) == 800


def test_training_set_and_prepare_all(graduates):
    encoding = features.fit_encoding(graduates, G)
    train = features.training_set(graduates, encoding)
    assert train.columns == ["student_id", "label", *(f"z_{n}" for n in ORDER)]
    assert train.count() == graduates.where("placed = 1").count()
    pay = graduates.where("student_id = 'S00001'").first()["salary_lpa"]
    whole = features.prepare_all(graduates, encoding)
    assert whole.count() == 800
    assert whole.where("is_converted").count() == train.count()
    row = train.where("student_id = 'S00001'").collect()
    assert not row or math.isclose(row[0]["label"], math.log1p(pay))


def test_default_fill_counts_what_it_fills(make):
    df = make({"cgpa": None, "ml_skill": None}, {}, {"branch": None})
    rows = clean.default_fill(df, G).orderBy("student_id").collect()
    assert [r["n_filled"] for r in rows] == [2, 0, 1]
    assert (rows[0]["cgpa"], rows[0]["ml_skill"], rows[2]["branch"]) == (7.5, 0, "CSE")


def test_range_violations(make):
    df = make(
        {"cgpa": 4.9, "projects": 16}, {"cgpa": 5.0, "projects": 15}, {"cgpa": None, "branch": None},
        {"branch": "Physics"},
    )
    rows = clean.range_violations(df, G).collect()
    assert {tuple(r) for r in rows} == {
        ("T0", "cgpa", 4.9, 5.0, 10.0), ("T0", "projects", 16.0, 0.0, 15.0),
        ("T3", "branch", None, None, None),
    }


@pytest.mark.parametrize(
    ("value", "band"),
    [(80.0, "top"), (79.99, "solid"), (50.0, "solid"), (49.99, "modest"),
     (30.0, "modest"), (29.99, "base"), (None, None)],
)
def test_bands(spark, value, band):
    df = spark.createDataFrame([(value,)], "v double")
    row = clean.value_bands(df, G, "v").first()
    assert row["band"] == band and row["value_in_units"] == (None if value is None else value * 100000)


def test_reply_status(spark):
    turns = spark.createDataFrame(
        [(1, "assistant", "[AI is away]"), (2, "assistant", "[API key]"), (3, "assistant", "Hello [AI"),
         (4, "assistant", None), (5, "user", "[AI")], "turn int, role string, text string",
    )
    rows = clean.reply_status(turns).orderBy("turn").collect()
    assert [r["status"] for r in rows] == ["failed", "failed", "ok", "ok"]


def test_reply_texts(spark):
    """Blanks go at both ends; an error keeps its first hundred characters, any other text all of them."""
    long = "é" * 300
    turns = spark.createDataFrame(
        [(1, "assistant", f" \n[AI {long}"), (2, "assistant", f"\t {long} x \r\n"), (3, "assistant", " \n "),
         (4, "assistant", None), (5, "assistant", "[API]")], "turn int, role string, text string",
    )
    rows = clean.reply_status(turns).orderBy("turn").collect()
    assert [r["reply"] for r in rows] == [f"[AI {long}"[:100], f"{long} x", "", None, "[API]"]
    assert [r["status"] for r in rows] == ["failed", "ok", "ok", "ok", "failed"]


def test_outcome_mask_and_projection(make):
    df = make({}, {"placed": 0}, {"placed": None})
    assert [r["is_converted"] for r in clean.outcome_mask(df, G).orderBy("student_id").collect()] == [True, False, False]
    assert clean.converted_only(df, G).count() == 1
    assert clean.feature_projection(df, G).columns == list(G.features)


def test_labels_fall_back_to_the_key(spark):
    df = spark.createDataFrame([("cgpa",), ("branch_IT",)], "feature string")
    assert {r["feature"]: r["label"] for r in label_features(df, G).collect()} == {
        "cgpa": "Mean grade", "branch_IT": "branch_IT",
    }
