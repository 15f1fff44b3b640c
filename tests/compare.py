"""Compare a Spark result with DuckDB: same columns, same rows in any order."""

from __future__ import annotations

import duckdb
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet')")
    return con


def _normal(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    return df.sort_values(list(df.columns), ignore_index=True, na_position="first")


def assert_same(spark_df, con: duckdb.DuckDBPyConnection, sql: str) -> int:
    ours, theirs = _normal(spark_df.toPandas()), _normal(con.execute(sql).df())
    assert list(ours.columns) == list(theirs.columns)
    assert len(ours) == len(theirs), (len(ours), len(theirs))
    for c in ours.columns:
        a, b = ours[c], theirs[c]
        if pd.api.types.is_float_dtype(b) or pd.api.types.is_float_dtype(a):
            pd.testing.assert_series_equal(
                a.astype(float), b.astype(float), check_exact=True, check_names=False
            )
        else:
            assert a.tolist() == b.tolist(), c
    return len(ours)


def same_types(spark_df, con: duckdb.DuckDBPyConnection, sql: str) -> list[str]:
    """Columns whose types differ between the two engines."""
    names = {
        "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
        "boolean": "BOOLEAN", "timestamp": "TIMESTAMP",
    }
    theirs = {r[0]: r[1] for r in con.execute(f"describe {sql}").fetchall()}
    return [
        f"{c}: {t} / {theirs[c]}" for c, t in spark_df.dtypes if names.get(t, t) != theirs[c]
    ]
