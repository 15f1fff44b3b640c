"""Text columns that put results into words, and chat turns with context."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlab.functions.names import display_name
from cohortlab.functions.scalars import fixed, round_even
from cohortlab.operators.cohorts import overview
from cohortlab.operators.whatif import by_lever, gains_per_profile
from cohortlab.spec import CohortSpec

EXPLAIN_SYSTEM = "Each line is a figure of one profile. Put them into plain words for that person."
IMPORTANCE_SYSTEM = "Each line is a share that a model gave to one of its inputs."
ADVICE_SYSTEM = "Each option is one change to a profile and what it adds to the score."
PAIR_SYSTEM = "Two profiles and their scores, a figure on each line."
CHAT_SYSTEM = "Figures of the whole cohort stand below the question. Use them where they help."
TOP_IMPORTANCE = 10
TOP_GAINS = 8


def _value_text(df: DataFrame, column: str) -> Column:
    kind = df.schema[column].dataType
    floating = isinstance(kind, (T.DoubleType, T.FloatType))
    text = fixed(F.col(column), 2) if floating else F.col(column).cast("string")
    return F.coalesce(text, F.lit("unknown"))


def _lines(*lines: Column) -> Column:
    return F.concat_ws("\n", *lines)


def _figure(name: str, *value: Column | str) -> Column:
    """A line ``name = value``."""
    parts = (F.lit(v) if isinstance(v, str) else v for v in value)
    return F.concat(F.lit(f"{name} = "), *parts)


def profile_lines(df: DataFrame, spec: CohortSpec) -> Column:
    """One line per feature with its display name."""
    return _lines(*(_figure(display_name(spec, c), _value_text(df, c)) for c in spec.features))


def explain_text(explained: DataFrame, spec: CohortSpec) -> DataFrame:
    """Score, drivers and features of each row of ``score.explain``."""
    drivers = F.transform(
        "top_factors",
        lambda f, i: F.concat(
            F.lit("driver "), (i + 1).cast("string"), F.lit(" = "), f["feature"],
            F.lit(" at "), fixed(f["value"], 3), F.lit(", strength "), fixed(f["score"], 4),
        ),
    )
    units = F.format_number(round_even(F.col("predicted_value") * spec.unit_factor, 0), 0)
    user = _lines(
        _figure("score", fixed(F.col("predicted_value"), 2), f" {spec.unit}"),
        _figure("in single units", units),
        F.when(F.size("top_factors") > 0, F.array_join(drivers, "\n")).otherwise("driver = none"),
        profile_lines(explained, spec),
        _figure("wanted", "two sentences on the drivers, one on the rest"),
    )
    return explained.select(
        spec.id, F.lit(EXPLAIN_SYSTEM).alias("system_text"), user.alias("user_text")
    )


def importance_text(importance: DataFrame) -> DataFrame:
    """The ten most important features, a line each; one row."""
    line = F.format_string("place %d = %s, share %.6f", "rank", "feature", "importance")
    top = importance.where(F.col("rank") <= TOP_IMPORTANCE)
    lines = F.transform(
        F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))), lambda x: x["line"]
    )
    user = _lines(
        F.array_join(lines, "\n"), _figure("wanted", "what the first three have in common, then the surprises")
    )
    return top.agg(user.alias("user_text")).select(
        F.lit(IMPORTANCE_SYSTEM).alias("system_text"), "user_text"
    )


def advice_text(df: DataFrame, model: PipelineModel, spec: CohortSpec) -> DataFrame:
    """The eight largest gains, the base value and the features of each profile, also without any gain."""
    labels = [display_name(spec, lever.feature) for lever in spec.levers]
    gathered = gains_per_profile(df, model, spec)
    best = F.transform(
        F.slice("gains", 1, TOP_GAINS),
        lambda g, i: F.concat(
            F.lit("option "), (i + 1).cast("string"), F.lit(" = "), by_lever(labels, g), F.lit(" "),
            fixed(g["current_value"], 2), F.lit(" -> "), fixed(g["improved_value"], 2),
            F.lit(" adds "), fixed(g["gain"], 2),
        ),
    )
    user = _lines(
        F.when(F.size("gains") > 0, F.array_join(best, "\n")).otherwise("option = none"),
        _figure("score now", fixed(F.col("base_value"), 2), f" {spec.unit}"),
        profile_lines(gathered, spec),
        _figure("wanted", "the option with the best return, and what stands against it"),
    )
    return gathered.select(
        spec.id, F.lit(ADVICE_SYSTEM).alias("system_text"), user.alias("user_text")
    )


def pair_text(compared: DataFrame, spec: CohortSpec, feature: str) -> DataFrame:
    """Both profiles of a pair in figures; ``compared`` carries the segment and ``feature``. What is missing is
    ``unknown``."""

    def figures(s: str) -> list[Column]:
        value = F.coalesce(fixed(F.col(f"value_{s}"), 2), F.lit("unknown"))
        return [
            _figure(f"score {s}", value, f" {spec.unit}"),
            _figure(f"{display_name(spec, spec.segment)} {s}", F.coalesce(F.col(f"{spec.segment}_{s}"), F.lit("unknown"))),
            _figure(f"{display_name(spec, feature)} {s}", _value_text(compared, f"{feature}_{s}")),
        ]

    gap = F.coalesce(fixed(F.col("abs_gap"), 2), F.lit("unknown"))
    user = _lines(
        _figure("distance", gap, f" {spec.unit}"), *figures("a"), *figures("b"),
        _figure("wanted", "whether the figures above account for the distance"),
    )
    return compared.select("a", "b", F.lit(PAIR_SYSTEM).alias("system_text"), user.alias("user_text"))


def overview_sentence(df: DataFrame, spec: CohortSpec) -> DataFrame:
    """One row with the figures that are added to a user's message."""
    return report_sentence(overview(df, spec, exact=False), spec)


def report_sentence(report: DataFrame, spec: CohortSpec) -> DataFrame:
    """The figures of an overview that was made before, as ``overview_sentence`` words them."""

    def amount(column: str) -> Column:
        return F.concat(fixed(F.col(column), 2), F.lit(f" {spec.unit}"))

    figures = F.concat(
        F.lit("\n\nrows = "), F.col("total").cast("string"),
        F.lit("\nconverted = "), F.coalesce(F.concat(fixed(F.col("rate"), 1), F.lit(" in 100")), F.lit("none")),
        F.lit("\nlowest = "), amount("min_target"), F.lit("\nmean = "), amount("avg_target"),
        F.lit("\nhighest = "), amount("max_target"),
    )
    return report.select(figures.alias("sentence"))


def chat_context(turns: DataFrame, sentence: Column) -> DataFrame:
    """User turns with the overview added and a fixed system turn; earlier turns are not sent. A null text counts as
    an empty one."""
    return turns.where(F.col("role") == "user").select(
        "conv_id",
        "turn",
        F.lit(CHAT_SYSTEM).alias("system_text"),
        F.concat(F.coalesce("text", F.lit("")), F.coalesce(sentence, F.lit(""))).alias("user_text"),
    )


def append_turns(history: DataFrame, *more: DataFrame) -> DataFrame:
    """The history with further turns, columns matched by name."""
    for turns in more:
        history = history.unionByName(turns)
    return history


def chat_replay(history: DataFrame) -> DataFrame:
    """All turns in reading order. The sort spreads a long conversation over several partitions."""
    return history.select("conv_id", "turn", "role", "text").orderBy("conv_id", "turn")
