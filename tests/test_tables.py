import pytest
from conftest import graduate_rows
from pyspark.sql import functions as F

from cohortlab import GRADUATES as G
from cohortlab.operators import cohorts
from cohortlab.sources import tables


def test_csv_round_trip(spark, graduates, tmp_path):
    path = str(tmp_path / "csv")
    graduates.write.option("header", True).csv(path)
    read = tables.read_csv(spark, path, G)
    assert read.schema.names == G.schema.names
    assert sorted(read.collect()) == sorted(graduates.collect())
    assert cohorts.overview(read, G).collect() == cohorts.overview(graduates, G).collect()


def write_csv(path, *rows: dict) -> str:
    lines = [",".join(rows[0])] + [",".join(str(v) for v in r.values()) for r in rows]
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def one_row() -> dict:
    return dict(zip(G.schema.names, graduate_rows(1)[0], strict=True))


@pytest.mark.parametrize(("column", "text"), [("cgpa", "high"), ("projects", "2.5"), ("placed", "yes")])
@pytest.mark.parametrize("strict", ["true", "false"])
def test_unfit_text_stops_the_job(spark, tmp_path, column, text, strict):
    path = write_csv(tmp_path / "bad.csv", one_row() | {column: text})
    before = spark.conf.get("spark.sql.ansi.enabled")
    try:
        spark.conf.set("spark.sql.ansi.enabled", strict)
        with pytest.raises(Exception, match=f"{column} is not a number: {text}"):
            tables.read_csv(spark, path, G).collect()
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)


def test_csv_with_too_few_values_stops_the_job(spark, tmp_path):
    path = write_csv(tmp_path / "short.csv", one_row())
    with open(path, "a") as f:
        f.write("S1,7.0\n")
    with pytest.raises(Exception, match="MALFORMED_RECORD"):
        tables.read_csv(spark, path, G).collect()


def test_csv_columns_by_name_and_missing_values(spark, tmp_path):
    row = one_row()
    back = dict(reversed(row.items())) | {"remark": "x"}
    path = write_csv(
        tmp_path / "odd.csv", back,
        back | {"cgpa": "NaN", "projects": "", "internships": "3.0", "branch": "NA", "job_role": "None"},
    )
    first, second = tables.read_csv(spark, path, G).collect()
    assert first.asDict() == row
    assert (second["cgpa"], second["projects"], second["branch"], second["job_role"]) == (None,) * 4
    assert second["internships"] == 3 and isinstance(second["internships"], int)


def test_csv_of_profiles_without_outcome(spark, tmp_path):
    row = {k: v for k, v in one_row().items() if k in ("student_id", *G.features)}
    df = tables.read_csv(spark, write_csv(tmp_path / "p.csv", row), G)
    assert set(df.columns) == set(row) and df.count() == 1
    short = {k: v for k, v in row.items() if k != "cgpa"}
    with pytest.raises(ValueError, match="cgpa"):
        tables.read_csv(spark, write_csv(tmp_path / "q.csv", short), G)


def test_parquet_nan_becomes_null(spark, make, tmp_path):
    path = str(tmp_path / "p")
    make({"cgpa": float("nan")}, {"cgpa": 6.0}).write.parquet(path)
    rows = tables.read_parquet(spark, path, G).orderBy("student_id").collect()
    assert [r["cgpa"] for r in rows] == [None, 6.0]


def test_missing_feature_fails_while_the_plan_is_built(spark, graduates, tmp_path):
    with pytest.raises(ValueError, match="ml_skill"):
        tables.profiles(graduates.drop("ml_skill"), G)
    path = str(tmp_path / "p")
    graduates.drop("cgpa").write.parquet(path)
    with pytest.raises(ValueError, match="cgpa"):
        tables.read_parquet(spark, path, G)


def test_profiles_hold_only_id_and_features(graduates):
    assert tables.profiles(graduates, G).columns == ["student_id", *G.features]


def test_from_dicts(spark):
    df = tables.from_dicts(spark, [dict(G.defaults), G.defaults | {"cgpa": 9}], G)
    assert df.columns == ["student_id", *G.features]
    assert [r["cgpa"] for r in df.orderBy("student_id").collect()] == [7.5, 9.0]
    with pytest.raises(ValueError, match="branch"):
        tables.from_dicts(spark, [{k: v for k, v in G.defaults.items() if k != "branch"}], G)


def test_filters_and_columns_reach_the_scan(spark, graduates, tmp_path):
    path = str(tmp_path / "p")
    graduates.write.parquet(path)
    df = tables.read_parquet(spark, path, G).where("placed = 1").groupBy("branch").agg(F.avg("salary_lpa"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(placed,1)" in plan
    assert "ReadSchema: struct<branch:string,placed:int,salary_lpa:double>" in plan


def test_bad_records_are_set_aside(spark, tmp_path):
    """Every record is in one of the two tables, whatever is wrong with it."""
    rows = [one_row() | {"student_id": f"S{i}"} for i in range(6)]
    rows[1] |= {"cgpa": "high", "projects": "2.5"}
    rows[2] |= {"projects": "3.0", "backlogs": "NA"}
    rows[3] |= {"branch": "IT,ECE"}
    path = write_csv(tmp_path / "some.csv", *rows)
    with open(path, "a") as file:
        file.write("S6,7.5\n")
    good, bad = tables.read_csv_checked(spark, path, G)
    assert good.schema == tables.read_csv(spark, path, G).schema
    found = {r["student_id"]: r for r in good.collect()}
    assert set(found) == {"S0", "S2", "S4", "S5"} and (found["S2"]["projects"], found["S2"]["backlogs"]) == (3, None)
    reasons = {(r["reason"], r["record"]) for r in bad.collect()}
    assert ("cgpa is not a number", "high") in reasons and ("wrong length", "S6,7.5") in reasons
    assert len(reasons) == 3 and any(a == "wrong length" and b.startswith("S3,") for a, b in reasons)
    with pytest.raises(Exception, match="MALFORMED|not a number"):
        tables.read_csv(spark, path, G).collect()


def test_written_texts_come_back(spark, graduates, tmp_path):
    texts = ['a "quoted" one', "commas, too", "two\nlines", ' "', " blanks ", '""', "\\", "NA", None, ""]
    columns = [c for c in G.schema.names if c not in ("student_id", "job_role")]
    first = graduates.limit(1).select(*columns).first()
    rows = [tuple({"student_id": f"T{i}", "job_role": t, **first.asDict()}[c] for c in G.schema.names) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, G.schema)
    tables.write_csv(df, str(tmp_path / "out"))
    for read in (tables.read_csv(spark, str(tmp_path / "out"), G, True), tables.read_csv_checked(spark, str(tmp_path / "out"), G, True)[0]):
        got = {r["student_id"]: r["job_role"] for r in read.collect()}
        assert got == {f"T{i}": None if t in ("NA", "") else t for i, t in enumerate(texts)}
