"""The registered queries: every operator on the customer cohort and the chat turns."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlab.functions.names import label_features as with_labels
from cohortlab.functions.scalars import round_even
from cohortlab.operators import clean, cohorts, features, learn, score, text, whatif
from cohortlab.plans import compare
from cohortlab.plans.train import train
from cohortlab.session import file_states, new_folder, stage
from cohortlab.sources import bundle as bundles
from cohortlab.sources import customers, metadata, tables
from cohortlab.spec import CUSTOMERS as SPEC
from cohortlab.streaming import streams

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}

# A scoring rule with given weights of the standardised features, so that SQL can check what the
# scoring operators do. Two features have no importance and never become a main factor.
INTERCEPT = 7.8
WEIGHTS = {
    "segment_BUILDING": -0.01, "segment_FURNITURE": 0.005, "segment_HOUSEHOLD": 0.02,
    "segment_MACHINERY": 0.015, "acctbal": 0.01, "n_orders": 0.28, "n_urgent": 0.02,
    "n_low": 0.015, "n_open": 0.01, "n_recent": 0.012, "tier": -0.02, "flag_urgent": 0.03,
    "flag_low": 0.02, "flag_recent": 0.04, "flag_open": 0.025,
}
IMPORTANCE = [
    ("n_orders", 0.41), ("n_open", 0.14), ("acctbal", 0.11), ("n_recent", 0.09), ("n_low", 0.07),
    ("n_urgent", 0.06), ("segment_HOUSEHOLD", 0.04), ("segment_MACHINERY", 0.03), ("tier", 0.02),
    ("segment_FURNITURE", 0.01), ("segment_BUILDING", 0.01), ("flag_open", 0.005),
    ("flag_recent", 0.005),
]
KEYS = ["segment", "tier", "region", "last_priority"]
REPLY_PREFIXES = (*clean.FAILED_REPLY, "Th")


def query(function: Query) -> Query:
    REGISTRY[function.__name__] = function
    return function


def report_rows(spark: SparkSession, folder: str) -> DataFrame:
    """What the reports read. An exact median reads it four times; the order facts are shuffled once."""
    return customers.cohort(spark, folder).select("segment", "tier", "converted", "target")


_ENCODINGS: dict[tuple, features.Encoding] = {}


def written(spark: SparkSession, folder: str) -> tuple:
    """What tells this application and the present files of the cohort from all others."""
    return (spark.sparkContext.applicationId, folder, *(file_states(spark, f"{folder}/{t}.parquet") for t in ("customer", "orders")))


def fitted(spark: SparkSession, folder: str) -> features.Encoding:
    """The encoding of this folder's converted rows; like a saved model it is fitted once per application and
    state of the files, so that a query that scores reads its rows a single time."""
    key = written(spark, folder)
    if key not in _ENCODINGS:
        rows = clean.converted_only(customers.cohort(spark, folder), SPEC)
        _ENCODINGS[key] = features.fit_encoding(rows, SPEC)
    return _ENCODINGS[key]


def fixed_model(spark: SparkSession, folder: str) -> PipelineModel:
    return learn.weighted_sum(fitted(spark, folder), WEIGHTS, INTERCEPT)


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    names = columns or tuple(c for c in df.columns if c.startswith("z_"))
    return df.withColumns({c: round_even(F.col(c), digits) for c in names})


_SAVED: dict[tuple, str] = {}


def saved_model(spark: SparkSession, folder: str) -> str:
    """Path of the model of these files; trained and saved by the first query that needs it."""
    key = written(spark, folder)
    if key not in _SAVED:
        path = new_folder(spark, "model")
        bundles.save(spark, train(customers.cohort(spark, folder), SPEC, tune=False, **learn.UNTUNED), SPEC, path)
        _SAVED[key] = path
    return _SAVED[key]


# Sources, projections and row rules


@query
def scan_profiles(spark: SparkSession, folder: str) -> DataFrame:
    return tables.profiles(tables.nan_to_null(customers.cohort(spark, folder)), SPEC)


@query
def csv_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """The cohort written as CSV and read back, with quotes, commas and line ends in its texts."""
    df = customers.cohort(spark, folder, post_outcome=True)
    path = new_folder(spark, "csv")
    tables.write_csv(df.withColumn("region", F.concat(F.lit('a "'), "region", F.lit('",\n of it'))), path)
    return tables.read_csv(spark, path, SPEC, multi_line=True)


@query
def csv_bad_records(spark: SparkSession, folder: str) -> DataFrame:
    """Good and bad records of a CSV copy in which some texts have a comma without quotes, and some tiers are words."""
    df = customers.cohort(spark, folder, post_outcome=True)
    path = new_folder(spark, "csv")
    key = F.col("profile_id")
    spoiled = df.withColumns({
        "region": F.when(key % 7 == 0, F.concat("region", F.lit(", and more"))).otherwise(F.col("region")),
        "tier": F.when(key % 11 == 0, F.lit("first")).otherwise(F.col("tier").cast("string")),
    })
    # No text is quoted.
    spoiled.write.option("header", True).option("quote", "\0").csv(path)
    good, bad = tables.read_csv_checked(spark, path, SPEC)
    return good.select(F.lit("good").alias("reason")).unionAll(bad.select("reason")).groupBy("reason").agg(
        F.count(F.lit(1)).alias("n")
    )


@query
def metadata_document(spark: SparkSession, folder: str) -> DataFrame:
    """Categories, roles and scaler figures, written as a JSON document and read back."""
    path = new_folder(spark, "document")
    metadata.write_document(metadata.document(spark, fitted(spark, folder)), path)
    docs = metadata.read_documents(spark, path, SPEC)
    none = F.lit(None).cast("double")
    names = metadata.roles(docs, SPEC).select("part", F.col("position").cast("long"), "name", none.alias("mean"), none.alias("deviation"))
    figures = rounded(metadata.scaler(docs, SPEC), 6, "mean", "deviation")
    figures = figures.select(F.lit("scaler").alias("part"), F.lit(None).cast("long").alias("position"), F.col("feature").alias("name"), "mean", "deviation")
    return names.unionByName(figures)


@query
def converted_only(spark: SparkSession, folder: str) -> DataFrame:
    return clean.converted_only(customers.cohort(spark, folder, post_outcome=True), SPEC)


@query
def feature_projection(spark: SparkSession, folder: str) -> DataFrame:
    return clean.feature_projection(customers.cohort(spark, folder), SPEC)


@query
def clean_category(spark: SparkSession, folder: str) -> DataFrame:
    """Unlisted categories become the given default before a fit, the first fitted one after it."""
    df = customers.cohort(spark, folder).select("profile_id", "segment")
    listed = ("BUILDING", "FURNITURE", "AUTOMOBILE")
    before = clean.clean_category(df, SPEC, listed, "BUILDING", "segment_for_fit")
    return clean.clean_category(before, SPEC, sorted(listed), min(listed), "segment_for_score")


@query
def outcome_mask(spark: SparkSession, folder: str) -> DataFrame:
    df = customers.cohort(spark, folder)
    return rounded(features.prepare_all(df, fitted(spark, folder)), 6)


@query
def label_features(spark: SparkSession, folder: str) -> DataFrame:
    """Mean and deviation of every encoded column under its display name."""
    encoding = fitted(spark, folder)
    rows = list(zip(encoding.names, encoding.means, encoding.deviations, strict=True))
    stats = spark.createDataFrame(rows, "feature string, mean double, deviation double")
    return rounded(with_labels(stats, SPEC), 6, "mean", "deviation").select(
        F.col("label").alias("feature_name"), F.col("feature").alias("feature_key"), "mean", "deviation"
    )


@query
def value_bands(spark: SparkSession, folder: str) -> DataFrame:
    df = customers.cohort(spark, folder)
    scored = score.predict(df, fixed_model(spark, folder), SPEC)
    banded = clean.value_bands(scored, SPEC, "predicted_value")
    return banded.select("profile_id", "predicted_value", "band", "value_in_units")


@query
def range_violations(spark: SparkSession, folder: str) -> DataFrame:
    return clean.range_violations(customers.cohort(spark, folder), SPEC)


@query
def default_fill(spark: SparkSession, folder: str) -> DataFrame:
    facts = customers.order_facts(customers.read(spark, folder, "orders"))
    raw = customers.raw_profiles(customers.read(spark, folder, "customer"), facts)
    return clean.default_fill(raw.select("profile_id", "segment", "tier", *SPEC.numeric), SPEC)


@query
def reply_status(spark: SparkSession, folder: str) -> DataFrame:
    turns = customers.read(spark, folder, "conversations")
    return clean.reply_status(turns, REPLY_PREFIXES).select("conv_id", "turn", "status", "reply")


# Reports


@query
def overview(spark: SparkSession, folder: str) -> DataFrame:
    return cohorts.overview(report_rows(spark, folder), SPEC)


@query
def group_means(spark: SparkSession, folder: str) -> DataFrame:
    return cohorts.group_means(customers.cohort(spark, folder, post_outcome=True), KEYS, SPEC)


@query
def segment_comparison(spark: SparkSession, folder: str) -> DataFrame:
    return cohorts.segment_comparison(report_rows(spark, folder), SPEC)


@query
def tier_comparison(spark: SparkSession, folder: str) -> DataFrame:
    return cohorts.tier_comparison(report_rows(spark, folder), SPEC)


@query
def flag_premium(spark: SparkSession, folder: str) -> DataFrame:
    return cohorts.flag_premium(customers.cohort(spark, folder), SPEC)


@query
def mark_best(spark: SparkSession, folder: str) -> DataFrame:
    report = cohorts.segment_comparison(report_rows(spark, folder), SPEC)
    return cohorts.mark_best(report, [c for c in report.columns if c != "segment"])


@query
def all_comparisons(spark: SparkSession, folder: str) -> DataFrame:
    """Overview, segments, tiers and flags from one set of passes."""
    return compare.all_comparisons(customers.cohort(spark, folder), SPEC)


# Features


@query
def category_domain(spark: SparkSession, folder: str) -> DataFrame:
    return features.category_domain(clean.converted_only(customers.cohort(spark, folder), SPEC), SPEC)


@query
def one_hot(spark: SparkSession, folder: str) -> DataFrame:
    df = customers.cohort(spark, folder)
    return features.one_hot(df, fitted(spark, folder))


@query
def standardize(spark: SparkSession, folder: str) -> DataFrame:
    df = customers.cohort(spark, folder)
    return rounded(features.standardize(df, fitted(spark, folder)), 6)


@query
def training_set(spark: SparkSession, folder: str) -> DataFrame:
    df = customers.cohort(spark, folder)
    rows = features.training_set(df, fitted(spark, folder))
    return features.split(rounded(rounded(rows, 6), 6, "label"), SPEC)


@query
def split_counts(spark: SparkSession, folder: str) -> DataFrame:
    return features.split_counts(customers.cohort(spark, folder), SPEC)


@query
def regression_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """Hold-out errors of the segment mean of the logarithm."""
    rows = features.listed_category(clean.converted_only(customers.cohort(spark, folder), SPEC), SPEC)
    rows = rows.select("profile_id", "segment", F.log1p("target").alias("actual_log"))
    parts = features.split(rows, SPEC)
    scored = learn.segment_mean_scores(
        parts.where("part = 'train'"), parts.where("part = 'test'"), SPEC, "actual_log"
    )
    return learn.regression_metrics(scored, "actual_log", "predicted_log")


# Scores with the given weights


@query
def batch_scores(spark: SparkSession, folder: str) -> DataFrame:
    df = customers.cohort(spark, folder)
    scored = score.predict(df, fixed_model(spark, folder), SPEC)
    return rounded(scored.select("profile_id", "segment_clean", "predicted_log", "predicted_value"), 4, "predicted_log")


def _explained(spark: SparkSession, folder: str) -> DataFrame:
    model, names = fixed_model(spark, folder), fitted(spark, folder).names
    return score.explain(customers.cohort(spark, folder), model, names, IMPORTANCE, SPEC)


@query
def top_factors(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(score.factors_long(_explained(spark, folder), SPEC), 6, "value")


@query
def whatif_gains(spark: SparkSession, folder: str) -> DataFrame:
    df = customers.cohort(spark, folder)
    return whatif.whatif_gains(df, fixed_model(spark, folder), SPEC)


def _pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Each customer against the one with the next key."""
    key = F.col("c_custkey")
    pairs = customers.read(spark, folder, "customer").select(key.alias("a"), (key + 1).alias("b"))
    df = customers.cohort(spark, folder)
    scored = score.predict(df, fixed_model(spark, folder), SPEC)
    # Both sides of the pairs read the scores, so they are written once.
    scored = stage(scored.select("profile_id", "segment", "acctbal", "predicted_value"), "scores")
    return score.pair_comparison(pairs, scored, SPEC, ["segment", "acctbal"])


@query
def pair_comparison(spark: SparkSession, folder: str) -> DataFrame:
    return _pairs(spark, folder).select("a", "b", "value_a", "value_b", "gap", "abs_gap", "winner", "status")


# Text and chat


@query
def explain_text(spark: SparkSession, folder: str) -> DataFrame:
    return text.explain_text(_explained(spark, folder), SPEC)


@query
def advice_text(spark: SparkSession, folder: str) -> DataFrame:
    df = customers.cohort(spark, folder)
    return text.advice_text(df, fixed_model(spark, folder), SPEC)


@query
def pair_text(spark: SparkSession, folder: str) -> DataFrame:
    return text.pair_text(_pairs(spark, folder), SPEC, "acctbal")


@query
def chat_context(spark: SparkSession, folder: str) -> DataFrame:
    sentence = text.overview_sentence(customers.cohort(spark, folder), SPEC)
    return text.chat_context(customers.read(spark, folder, "conversations"), sentence.scalar())


@query
def append_once(spark: SparkSession, folder: str) -> DataFrame:
    """Turns appended in three batches, one of them written again."""
    turns = customers.read(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    path = new_folder(spark, "turns")
    for batch in (0, 1, 2, 1):
        streams.append_batch(turns.where(F.pmod("conv_id", F.lit(3)) == batch), path, batch)
    return streams.appended(spark, path, turns.schema)


@query
def chat_replay(spark: SparkSession, folder: str) -> DataFrame:
    """Replies appended to the other turns, then everything in reading order."""
    turns = customers.read(spark, folder, "conversations")
    replies = F.coalesce(F.col("role") == "assistant", F.lit(False))
    return text.chat_replay(text.append_turns(turns.where(~replies), turns.where(replies)))


# The learned model


@query
def gbt_scores(spark: SparkSession, folder: str) -> DataFrame:
    bundle = bundles.load(spark, saved_model(spark, folder))
    scored = score.predict(customers.cohort(spark, folder), bundle.model, SPEC)
    return scored.select("profile_id", "segment_clean", "predicted_log", "predicted_value")


@query
def gbt_top_factors(spark: SparkSession, folder: str) -> DataFrame:
    b = bundles.load(spark, saved_model(spark, folder))
    df = customers.cohort(spark, folder)
    explained = score.explain(df, b.model, b.feature_names, b.importance, SPEC)
    return score.factors_long(explained, SPEC)


@query
def gbt_whatif_gains(spark: SparkSession, folder: str) -> DataFrame:
    bundle = bundles.load(spark, saved_model(spark, folder))
    return whatif.whatif_gains(customers.cohort(spark, folder), bundle.model, SPEC)


@query
def feature_importance(spark: SparkSession, folder: str) -> DataFrame:
    """The fifteen highest importances of the saved model."""
    top = bundles.top_importance(spark, saved_model(spark, folder))
    return with_labels(top, SPEC).select("rank", "feature", "label", "importance").orderBy("rank")


@query
def model_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return bundles.model_metrics(spark, saved_model(spark, folder))


@query
def importance_text(spark: SparkSession, folder: str) -> DataFrame:
    return text.importance_text(bundles.feature_importance(spark, saved_model(spark, folder)))


@query
def grid_search(spark: SparkSession, folder: str) -> DataFrame:
    """Mean error of each combination of the grid."""
    df = customers.cohort(spark, folder)
    return learn.grid_table(df, train(df, SPEC, tune=True, grid=learn.GRID, folds=learn.FOLDS).grid)


# Boosted trees of one split each over the yes/no features, tier and segment: a learner that SQL can follow

STUMPS = replace(SPEC, numeric=())
STUMP_FIT = {"maxIter": 3, "maxDepth": 1, "stepSize": 0.25}
STUMP_GRID = {"maxIter": [1, 3], "maxDepth": [1], "stepSize": [0.25]}


_STUMPS: dict[tuple, learn.Bundle] = {}


def stumps(spark: SparkSession, folder: str) -> learn.Bundle:
    """The model of three splits of these files, fitted once per application and state of the files."""
    key = written(spark, folder)
    if key not in _STUMPS:
        _STUMPS[key] = train(customers.cohort(spark, folder), STUMPS, tune=False, **STUMP_FIT)
    return _STUMPS[key]


@query
def stump_scores(spark: SparkSession, folder: str) -> DataFrame:
    scored = score.predict(customers.cohort(spark, folder), stumps(spark, folder).model, STUMPS)
    return rounded(scored.select("profile_id", "predicted_log", "predicted_value"), 6, "predicted_log")


@query
def stump_importance(spark: SparkSession, folder: str) -> DataFrame:
    """Share of the squared error that the splits on each feature take away."""
    pairs = [(i, n, x) for i, (n, x) in enumerate(stumps(spark, folder).importance, 1)]
    return spark.createDataFrame(pairs, "rank int, feature string, importance double")


@query
def stump_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """Hold-out errors on the original scale."""
    measures = stumps(spark, folder).metrics
    kinds = ", ".join(f"{m} {'long' if m == 'n' else 'double'}" for m in bundles.MEASURES)
    return spark.createDataFrame([tuple(measures[m] for m in bundles.MEASURES)], kinds)


@query
def stump_grid(spark: SparkSession, folder: str) -> DataFrame:
    """Mean error over two folds after one and after three trees."""
    df = customers.cohort(spark, folder)
    return learn.grid_table(df, train(df, STUMPS, tune=True, grid=STUMP_GRID, folds=2).grid)


# Streams


def _drain(stream: DataFrame, label: str) -> DataFrame:
    """Run a stream over everything available and read what it wrote."""
    spark = stream.sparkSession
    out, state = new_folder(spark, label), new_folder(spark, f"{label}-progress")
    streams.start(stream, out, state).awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


@query
def stream_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Customers as they arrive, joined with their order facts and scored."""
    model = fixed_model(spark, folder)
    facts = stage(customers.order_facts(customers.read(spark, folder, "orders")), "facts")
    schema = customers.read(spark, folder, "customer").schema
    arriving = streams.table_stream(spark, folder, "customer", schema)
    profiles = tables.profiles(customers.finish(customers.raw_profiles(arriving, facts)), SPEC)
    scored = _drain(streams.score_stream(profiles, model, SPEC), "scores")
    return rounded(scored.drop("n_filled"), 4, "predicted_log")


class _Arriving:
    """A table that arrives in parts: each call writes the next one and returns a stream of the folder."""

    def __init__(self, df: DataFrame, label: str):
        self.df, self.path = df, new_folder(df.sparkSession, label)

    def __call__(self, rows: Column) -> DataFrame:
        self.df.where(rows).write.mode("append").parquet(self.path)
        return streams.file_stream(self.df.sparkSession, self.path, "*.parquet", self.df.schema)


def _arriving_profiles(spark: SparkSession, folder: str) -> Callable[[Column], DataFrame]:
    facts = stage(customers.order_facts(customers.read(spark, folder, "orders")), "facts")
    arriving = _Arriving(customers.read(spark, folder, "customer"), "arriving")
    return lambda rows: customers.finish(customers.raw_profiles(arriving(rows), facts))


@query
def stream_overview(spark: SparkSession, folder: str) -> DataFrame:
    """The overview after two parts of the customers have arrived, with a restart between them."""
    profiles, state = _arriving_profiles(spark, folder), new_folder(spark, "overview-progress")
    for part in (0, 1):
        report = streams.overview_so_far(profiles(F.pmod("c_custkey", F.lit(2)) == part), SPEC, state)
    return report


@query
def stream_moving_context(spark: SparkSession, folder: str) -> DataFrame:
    """Turns as they arrive, each with the overview of the customers that have arrived before it."""
    profiles, state = _arriving_profiles(spark, folder), new_folder(spark, "overview-progress")
    turns = _Arriving(customers.read(spark, folder, "conversations"), "turns")
    out, progress = new_folder(spark, "chat"), new_folder(spark, "chat-progress")
    for part in (0, 1):
        report = streams.overview_so_far(profiles(F.pmod("c_custkey", F.lit(2)) == part), SPEC, state)
        sentence = stage(text.report_sentence(report, SPEC), "sentence")
        stream = streams.context_stream(turns(F.pmod("conv_id", F.lit(2)) == part), sentence.scalar())
        streams.start(stream, out, progress).awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


@query
def stream_chat_context(spark: SparkSession, folder: str) -> DataFrame:
    """Chat turns as they arrive, each user turn with the overview of the cohort."""
    sentence = text.overview_sentence(customers.cohort(spark, folder), SPEC).first()["sentence"]
    schema = customers.read(spark, folder, "conversations").schema
    arriving = streams.table_stream(spark, folder, "conversations", schema)
    return _drain(streams.context_stream(arriving, F.lit(sentence)), "chat")
