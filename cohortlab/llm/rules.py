"""Quality rules learned as a decision list.

Sequential covering: conditions on statistics of the text are added to a rule as long as they raise its information
gain over labelled rows, then the rule is cut back to the beginning that does best on other labelled rows; the rows it
covers are set aside and the next rule is grown, until none is precise enough. The list becomes one conditional
expression. Every step is one aggregation: counts by statistic and value, which has three digits at most.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlab.llm.tables import BLANK, field, keep, packed, unpacked, words

SYMBOLS = "#*$%&|<>"
LEAST_WORDS, MOST_REPEATED = 10, 20
WINDOW = 5
MAX_RULES, MAX_CONDITIONS = 12, 4
# Share of bad rows that a rule must reach on the rows that it was not grown on, corrected for small counts.
PRECISION = 0.9


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    value: float

    def holds(self) -> Column:
        return F.col(self.feature) > self.value if self.above else F.col(self.feature) <= self.value


Conjunction = tuple[Condition, ...]


def _both(conditions: Sequence[Condition]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c.holds()
    return out


def _any(rules: Sequence[Conjunction]) -> Column:
    out = F.lit(False)
    for r in rules:
        out = out | _both(r)
    return out


def decision(rules: Sequence[Conjunction]) -> Column:
    """Number of the first rule that rejects the row, from 1; null if none does."""
    out = F.lit(None).cast("int")
    for i, rule in reversed(list(enumerate(rules, 1))):
        out = F.when(_both(rule), i).otherwise(out)
    return out


# Statistics


def text_arrays(df: DataFrame, text: str) -> DataFrame:
    """Adds ``_words``, ``_windows`` (hashes of the windows of five words) and ``_lines`` (those with a word)."""
    df = df.withColumn("_words", words(F.col(text)))
    n = F.greatest(F.size("_words") - (WINDOW - 1), F.lit(0))
    shifted = F.arrays_zip(*(F.slice("_words", i + 1, n).alias(f"w{i}") for i in range(WINDOW)))
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda line: F.btrim(line, F.lit(BLANK)) != "")
    return df.withColumn("_windows", F.transform(shifted, lambda w: F.xxhash64(w))).withColumn("_lines", lines)


def _covered(windows: Column) -> Column:
    """Words in windows that a text has twice or more: equal hashes stand together once sorted, and each place of such a
    window covers five words, less what the next one covers."""
    placed = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def from_sorted(s: Column) -> Column:
        n = F.size(s) - 1
        pairs = F.arrays_zip(F.slice(s, 1, n).alias("a"), F.slice(s, 2, n).alias("b"))
        same = F.filter(pairs, lambda p: p["a"]["h"] == p["b"]["h"])
        return F.sort_array(F.array_distinct(F.flatten(F.transform(same, lambda p: F.array(p["a"]["i"], p["b"]["i"])))))

    def from_places(p: Column) -> Column:
        gaps = F.zip_with(p, F.slice(p, 2, F.size(p)), lambda a, b: F.least(b - a, F.lit(WINDOW)))
        return F.aggregate(gaps, F.lit(0), lambda t, g: t + F.coalesce(g, F.lit(WINDOW)))

    # A lambda over a one-element array computes its argument once.
    places = F.transform(F.array(placed), from_sorted)
    return F.transform(places, from_places)[0]


def statistics(df: DataFrame, text: str) -> DataFrame:
    """Adds the statistics of a text: ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_digits,
    n_distinct`` (all long)."""
    t = F.coalesce(text, F.lit(""))
    repeated = F.size(F.array_distinct("_windows")) < F.size("_windows")
    counts = {
        "n_words": F.size("_words"),
        "word_chars": F.length(F.translate(t, BLANK, "")),
        "n_symbols": F.length(t) - F.length(F.translate(t, SYMBOLS, "")),
        "n_dup_lines": F.size("_lines") - F.size(F.array_distinct("_lines")),
        "n_repeat_words": F.when(repeated, _covered(F.col("_windows"))).otherwise(0),
        "n_lines": F.size("_lines"),
        "n_digits": F.length(t) - F.length(F.translate(t, "0123456789", "")),
        "n_distinct": F.size(F.array_distinct("_words")),
    }
    df = text_arrays(df, text)
    return df.withColumns({k: v.cast("long") for k, v in counts.items()}).drop("_words", "_windows", "_lines")


def _short(x: Column) -> Column:
    """Three digits of a number, so that no statistic has more than some thousand values."""
    scale = F.pow(F.lit(10.0), F.lit(2) - F.floor(F.log10(F.abs(x))))
    return F.when(x == 0, 0.0).otherwise(F.rint(x * scale) / scale)


def features() -> dict[str, Column]:
    n, lines = F.greatest("n_words", F.lit(1)), F.greatest("n_lines", F.lit(1))
    ratios = {
        "f_words": F.col("n_words"), "f_word_length": F.col("word_chars") / n, "f_symbols": F.col("n_symbols") / n,
        "f_dup_lines": F.col("n_dup_lines") / lines, "f_repeats": F.col("n_repeat_words") / n,
        "f_line_words": F.col("n_words") / lines, "f_digits": F.col("n_digits") / n,
        "f_distinct": F.col("n_distinct") / n,
    }
    return {k: _short(v.cast("double")) for k, v in ratios.items()}


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


# Learning


def _best(counts: Sequence, bad: int, good: int) -> tuple[float, Condition | None]:
    """The condition with the largest gain, from the counts of all values."""
    best, choice = 0.0, None
    before = math.log2(bad / (bad + good)) if bad else 0.0
    by_feature: dict[str, list] = {}
    for r in counts:
        by_feature.setdefault(r["feature"], []).append((r["value"], r["bad"], r["n"] - r["bad"]))
    for feature in sorted(by_feature):
        rows = sorted(by_feature[feature])
        p = n = 0
        for (value, pos, neg), (following, _, _) in zip(rows, rows[1:], strict=False):
            p, n = p + pos, n + neg
            # Halfway to the next value, which leaves most room on both sides.
            value = (value + following) / 2
            for above, x, y in ((False, p, n), (True, bad - p, good - n)):
                gain = x * (math.log2(x / (x + y)) - before) if x else 0.0
                if gain > best + 1e-9:
                    best, choice = gain, Condition(feature, above, value)
    return best, choice


def _counted(rows: DataFrame, names: Sequence[str]) -> list:
    pairs = F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f).alias("value")) for f in names)))
    return rows.select("bad", pairs.alias("p")).groupBy("p.feature", "p.value").agg(
        F.sum("bad").alias("bad"), F.count("*").alias("n")
    ).collect()


def learn(labelled: DataFrame, max_rules: int = MAX_RULES, precision: float = PRECISION) -> list[Conjunction]:
    """A decision list for the rows with ``bad = 1``, from ``labelled(bad, grow, f_...)``.

    ``grow`` tells the rows that rules are grown on from those that they are cut back and judged on. No labelled rows,
    or none of one kind: no rules. Equal gains: the first statistic in name order, the smaller value.
    """
    names = [c for c in labelled.columns if c.startswith("f_")]
    rules: list[Conjunction] = []
    while len(rules) < max_rules:
        left = labelled.where(~_any(rules))
        conditions: list[Condition] = []
        while len(conditions) < MAX_CONDITIONS:
            counts = _counted(left.where("grow").where(_both(conditions)), names)
            one = [r for r in counts if r["feature"] == names[0]]
            bad, n = sum(r["bad"] for r in one), sum(r["n"] for r in one)
            gain, choice = _best(counts, bad, n - bad)
            if choice is None or gain <= 0 or bad == n:
                break
            conditions.append(choice)
        if not conditions:
            break
        cuts = [_both(conditions[:k]) for k in range(1, len(conditions) + 1)]
        sums = left.where("not grow").agg(
            *(F.sum(F.when(c, F.col("bad")).otherwise(0)) for c in cuts), *(F.count_if(c) for c in cuts)
        ).first()
        pairs = [(int(sums[k] or 0), int(sums[len(cuts) + k] or 0)) for k in range(len(cuts))]
        value, k = max(((2 * p - n) / n if n else -1.0, -i) for i, (p, n) in enumerate(pairs))
        p, n = pairs[-k]
        if (p + 1) / (n + 2) < precision:
            # Of the beginnings, the most precise one that is still good enough; else no more rules.
            better = [(q, -i) for i, (q, m) in enumerate(pairs) if m and (q + 1) / (m + 2) >= precision]
            if not better:
                break
            k = max(better)[1]
        rules.append(tuple(conditions[: 1 - k]))
    return rules


def labelled_rows(stats: DataFrame, labels: DataFrame) -> DataFrame:
    """Learning rows: statistics of the labelled texts that the base rules let pass."""
    marks = labels.where(field("quality").isNotNull()).groupBy(field("doc_id").alias("doc_id")).agg(
        F.max((field("quality") == 0).cast("int")).alias("bad")
    )
    rows = stats.where(~base_failed()).join(marks, "doc_id")
    part = F.pmod(F.xxhash64("doc_id", F.lit("grow")), F.lit(3)) < 2
    return rows.select("bad", part.alias("grow"), *(v.alias(k) for k, v in features().items()))


def judge(documents: DataFrame, labels: DataFrame, max_rules: int = MAX_RULES) -> DataFrame:
    """Statistics, ``base_failed``, ``rule`` (the one that rejects the row) and ``kept`` for each row of
    ``documents(doc_id, text)``; ``labels(doc_id, quality)`` has quality 0 for bad texts.

    Null or empty text: no words, so the base rules reject it. Null id: judged, never labelled. Repeated rows each get
    their result and, if labelled, count each time; a text with several labels is bad if one says so; null labels do
    not count. Very long texts are read whole. No labels: the base rules only. An empty table gives no rows. Other
    columns are not used.
    """
    texts = documents.select(field("doc_id").alias("doc_id"), field("text").cast("string").alias("text"))
    stats = keep(statistics(texts, "text").drop("text"), "statistics")
    rules = learn(keep(labelled_rows(stats, labels), "labelled"), max_rules)
    return judged(stats, rules)


def judged(stats: DataFrame, rules: Sequence[Conjunction]) -> DataFrame:
    out = stats.withColumns(features()).withColumn("base_failed", base_failed()).withColumn("rule", decision(rules))
    out = out.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())
    return out.drop(*features())


def good_documents(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``documents`` that the base rules and the learned rules keep, with their columns.

    Null, empty and blank texts go, as the base rules reject them. A null id is judged, never labelled; repeated rows
    stay or go together. Very long texts are read whole. No labels: the base rules only. An empty table gives no rows;
    extra columns, whatever their names, are passed on.
    """
    # Every text is split once; rules are learned from and applied to the numbers written beside the rows.
    rows = packed(documents, field("doc_id").alias("doc_id"), field("text").cast("string").alias("text"))
    stats = keep(statistics(rows, "text").drop("text"), "statistics")
    rules = learn(keep(labelled_rows(stats.drop("doc"), labels), "labelled"))
    return unpacked(judged(stats, rules).where("kept"), documents.columns)
