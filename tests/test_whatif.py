import pytest
from pyspark.sql import functions as F

from cohortlab import GRADUATES as G
from cohortlab import Lever
from cohortlab.operators import features, learn, whatif
from cohortlab.operators.score import predict
from cohortlab.plans.train import train
from dataclasses import replace

WEIGHTS = {
    "cgpa": 0.05, "coding_score": 0.04, "internships": 0.05, "projects": 0.05, "backlogs": -0.1,
    "skill_score": 0.2, "college_tier": -0.1, "python_skill": 0.02, "ml_skill": 0.02,
}


@pytest.fixture(scope="module")
def model(graduates):
    encoding = features.fit_encoding(graduates.where("placed = 1"), G)
    return learn.weighted_sum(encoding, WEIGHTS, 3.9)


@pytest.fixture(scope="module")
def trees(graduates):
    return train(graduates, G, tune=False, maxIter=6, maxDepth=3, stepSize=0.5).model


def changes(profile: dict) -> list[tuple[str, str, float, float]]:
    """All changes of one profile, written down case by case."""
    out = [(f"{c}_up", c, float(profile[c]), profile[c] + max(0.5, profile[c] * 0.1)) for c in G.numeric]
    out += [(f"{c}_on", c, 0.0, 1.0) for c in G.binary if (profile[c] or 0) == 0]
    if profile["college_tier"] > 1:
        out.append(("college_tier_better", "college_tier", profile["college_tier"], profile["college_tier"] - 1))
    if profile["internships"] < 5:
        out.append(("internships_plus_one", "internships", profile["internships"], profile["internships"] + 1))
    if profile["projects"] < 10:
        out.append(("projects_plus_one", "projects", profile["projects"], profile["projects"] + 1))
    return out


def one_by_one(spark, rows, model):
    """Score every changed profile as a row of its own and rank with a stable sort."""
    variants = []
    for row in rows:
        profile = {c: row[c] for c in G.features}
        variants.append((f"{row['student_id']}|base", profile))
        variants += [(f"{row['student_id']}|{lever}", profile | {f: new}) for lever, f, _, new in changes(profile)]
    schema = ", ".join(
        ["student_id string", *(f"{c} {'string' if c == G.segment else 'double'}" for c in G.features)]
    )
    table = spark.createDataFrame(
        [(k, *(p[c] if c == G.segment or p[c] is None else float(p[c]) for c in G.features)) for k, p in variants],
        schema,
    )
    value = {r["student_id"]: r["predicted_value"] for r in predict(table, model, G).collect()}
    want = {}
    for row in rows:
        key = row["student_id"]
        gains = []
        for lever, feature, current, new in changes({c: row[c] for c in G.features}):
            gain = value[f"{key}|{lever}"] - value[f"{key}|base"]
            if gain > 0.01:
                gains.append((lever, feature, round(float(current), 2), round(float(new), 2), round(gain, 2)))
        gains.sort(key=lambda g: g[4], reverse=True)
        want |= {(key, i + 1): g for i, g in enumerate(gains)}
    return want


@pytest.mark.parametrize("which", ["model", "trees"])
def test_equals_scoring_one_change_at_a_time(spark, graduates, which, request):
    model = request.getfixturevalue(which)
    few = graduates.orderBy("student_id").limit(40).drop("salary_lpa", "company_type", "job_role")
    rows = few.collect()
    got = {
        (r["student_id"], r["rank"]): (r["lever"], r["feature"], r["current_value"], r["improved_value"], r["gain"])
        for r in whatif.whatif_gains(spark.createDataFrame(rows, few.schema), model, G).collect()
    }
    want = one_by_one(spark, rows, model)
    assert got == want and len(got) > 40


def tries(df, spec=G):
    """Scenarios by the name of the lever."""
    rows = whatif.scenarios(df, spec).collect()
    assert sum(r["lever_order"] == whatif.BASE for r in rows) == df.count()
    return {spec.levers[r["lever_order"]].name: r for r in rows if r["lever_order"] != whatif.BASE}


def test_levers_that_do_not_apply(make):
    df = make({f: 1 for f in G.binary} | {"college_tier": 1, "internships": 5, "projects": 10, "backlogs": 0})
    rows = tries(df)
    assert set(rows) == {f"{c}_up" for c in G.numeric}
    assert rows["backlogs_up"]["improved"] == 0.5
    assert rows["projects_up"]["improved"] == 11.0


def test_missing_flag_counts_as_off(make):
    rows = tries(make({"ml_skill": None}))
    assert rows["ml_skill_on"]["ml_skill"] == 1.0


def test_gains_keep_the_profile_and_its_types(make, graduates):
    encoding = features.fit_encoding(graduates.where("placed = 1"), G)
    rising = learn.weighted_sum(encoding, {"ml_skill": 0.5, "projects": 0.5}, 3.9)
    df = make({"ml_skill": None, "projects": 4})
    filled = df.na.fill(0, ["ml_skill"])
    row = whatif.gains_per_profile(filled, rising, G).first()
    assert row["projects"] == 4 and isinstance(row["projects"], int) and row["branch"] == "CSE"
    assert {g["improved_value"] for g in row["gains"]} == {1.0, 4.5, 5.0}
    assert [g["gain"] for g in row["gains"]] == sorted((g["gain"] for g in row["gains"]), reverse=True)


def test_each_scenario_changes_one_feature(graduates):
    laid_out = whatif.scenarios(graduates, G).alias("t").join(graduates.alias("g"), "student_id")
    changed = sum((~F.col(f"t.{c}").eqNullSafe(F.col(f"g.{c}"))).cast("int") for c in G.features)
    wanted = F.when(F.col("lever_order") == whatif.BASE, 0).otherwise(1)
    assert laid_out.where(changed != wanted).count() == 0
    # At most sixteen levers and the base row.
    assert laid_out.groupBy("student_id").count().agg(F.max("count")).first()[0] <= 17


def test_no_gain_is_dropped(make, graduates):
    encoding = features.fit_encoding(graduates.where("placed = 1"), G)
    flat = learn.weighted_sum(encoding, {"cgpa": 0.0}, 3.0)
    assert whatif.whatif_gains(graduates, flat, G).count() == 0
    assert whatif.gains_per_profile(graduates, flat, G).count() == 800
    # Also a profile to which no lever applies at all keeps its base value.
    none = replace(G, levers=(Lever("x", "cgpa", "add", 1.0, above=99.0),))
    assert whatif.gains_per_profile(make({}), flat, none).first()["base_value"] > 0


def test_cap_and_direction(make):
    levers = (
        Lever("cgpa_capped", "cgpa", "grow", 0.5, share=0.1, cap=10.0),
        Lever("fewer_backlogs", "backlogs", "add", -1.0, above=0.0),
    )
    spec = replace(G, levers=levers)
    both = make({"cgpa": 9.8, "backlogs": 2}, {"cgpa": 10.0, "backlogs": 0})
    assert {(r["student_id"], name, r["improved"]) for name, r in tries(both, spec).items()} == {
        ("T0", "cgpa_capped", 10.0), ("T0", "fewer_backlogs", 1.0),
    }
    with pytest.raises(ValueError, match="unknown rule"):
        whatif.scenarios(make({}), replace(G, levers=(Lever("x", "cgpa", "halve", 1.0),)))


def test_no_shuffle_when_partitioned_by_id_and_one_score_per_scenario(graduates, trees):
    placed = graduates.repartition(4, "student_id")
    plan = whatif.whatif_gains(placed, trees, G)._jdf.queryExecution().optimizedPlan().toString()
    physical = whatif.whatif_gains(placed, trees, G)._jdf.queryExecution().executedPlan().toString()
    assert physical.count("Exchange") == 1
    # Assembling and predicting, each once.
    assert plan.count("UDF(") == 2
