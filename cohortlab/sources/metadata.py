"""The metadata document of a model: one JSON object in a file of its own, read into tables.

The keys are those that other tools write; ``keys`` is the one place that maps them to the roles of a spec.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlab.operators.features import Encoding
from cohortlab.spec import CohortSpec

# Keys of lists of column names by role, of the importances, and of the measures in the document.
ROLES = {"numeric": "numerical_cols", "ordinal": "ordinal_cols", "binary": "binary_cols"}
MEASURES = {
    "r2": "r2", "mae": "mae", "rmse": "rmse", "mape": "mape", "mean_actual": "mean_actual_{target}",
    "mean_predicted": "mean_predicted_{target}", "n": "n_test_samples",
}


def keys(spec: CohortSpec) -> dict[str, str]:
    """Key in the document of each part of a spec: categories, reference, roles and measures."""
    target = spec.target.split("_")[0]
    return {
        "features": "feature_names", "categories": f"{spec.segment}_categories", "reference": f"{spec.segment}_reference",
        **ROLES, "log": "log_transform", "importance": "feature_importance", "metrics": "metrics",
        **{m: key.format(target=target) for m, key in MEASURES.items()},
        "means": "scaler_mean", "deviations": "scaler_scale",
    }


def layout(spec: CohortSpec) -> str:
    """The document as a type; a key that it lacks is read as null."""
    k = keys(spec)
    lists = [*(f"`{k[x]}`: array<string>" for x in ("features", "categories", *ROLES)), f"`{k['reference']}`: string"]
    measures = ", ".join(f"`{k[m]}`: {'bigint' if m == 'n' else 'double'}" for m in MEASURES)
    return (
        f"struct<{', '.join(lists)}, `{k['log']}`: boolean, "
        f"`{k['importance']}`: array<struct<feature: string, importance: double>>, `{k['metrics']}`: struct<{measures}>, "
        f"`{k['means']}`: array<double>, `{k['deviations']}`: array<double>>"
    )


def read_documents(spark: SparkSession, path: str, spec: CohortSpec) -> DataFrame:
    """One row per file: ``doc``, the whole document, however many lines it has. What is no such object stops the job."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.from_json("value", layout(spec), {"mode": "FAILFAST"}).alias("doc"))


def write_document(df: DataFrame, path: str) -> None:
    """Write the ``doc`` column of one row, indented, to a folder with one file."""
    df.select(F.to_json("doc", {"pretty": "true", "ignoreNullFields": "true"}).alias("value")).coalesce(1).write.text(path)


def document(spark: SparkSession, encoding: Encoding) -> DataFrame:
    """The part of the document that an encoding knows: names, categories, roles and scaler figures."""
    spec, k = encoding.spec, keys(encoding.spec)
    row = {
        k["features"]: encoding.names, k["categories"]: list(encoding.categories), k["reference"]: encoding.dropped,
        k["numeric"]: list(spec.numeric), k["ordinal"]: [spec.tier], k["binary"]: list(spec.binary), k["log"]: True,
        k["means"]: list(encoding.means), k["deviations"]: list(encoding.deviations),
    }
    return spark.createDataFrame([(row,)], f"doc {layout(spec)}")


def _listed(docs: DataFrame, part: str, key: str) -> DataFrame:
    return docs.select(F.lit(part).alias("part"), F.posexplode(F.col("doc")[key]).alias("position", "name"))


def roles(docs: DataFrame, spec: CohortSpec) -> DataFrame:
    """``part, position, name``: feature names, categories, the one that has no column, and columns by role."""
    k = keys(spec)
    out = docs.select(F.lit("reference").alias("part"), F.lit(0).alias("position"), F.col("doc")[k["reference"]].alias("name"))
    for part in ("features", "categories", *ROLES):
        out = out.unionByName(_listed(docs, part, k[part]))
    return out


def scaler(docs: DataFrame, spec: CohortSpec) -> DataFrame:
    """``feature, mean, deviation`` in feature order; no rows if the document has no such figures."""
    k = keys(spec)
    pairs = F.arrays_zip(*(F.col("doc")[k[x]].alias(x) for x in ("features", "means", "deviations")))
    return docs.where(F.col("doc")[k["means"]].isNotNull()).select(F.inline(pairs)).toDF("feature", "mean", "deviation")


def importance(docs: DataFrame, spec: CohortSpec) -> DataFrame:
    """``rank, feature, importance``, from 1."""
    rows = docs.select(F.posexplode(F.col("doc")[keys(spec)["importance"]]).alias("at", "pair"))
    return rows.select((F.col("at") + 1).alias("rank"), "pair.feature", "pair.importance")


def metrics(docs: DataFrame, spec: CohortSpec) -> DataFrame:
    """One row of hold-out measures under the library's own names."""
    k = keys(spec)
    return docs.select(*(F.col("doc")[k["metrics"]][k[m]].alias(m) for m in MEASURES))
