"""Rows that every operator must survive: nulls, empty and long texts, repeats, clashing extra columns."""

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, "
    "node long, label string, size long, `k.1` string, position double, copy int, n_values string, spans string, rank int"
)
LONG = " ".join(f"word{i % 977} thing{i % 1013}" for i in range(30_000))


def rows() -> list[tuple]:
    extra = (1, "x", 2, "y", 0.5, 3, "z", "s", 4)
    base = [
        (1, "One small text about nothing.\nWith a second line of words.", "en", "a"),
        (1, "One small text about nothing.\nWith a second line of words.", "en", "a"),
        (2, None, "en", "b"), (3, "", None, None), (4, " \t\n ", "en", "b"), (5, LONG, "en", "a"),
        (None, "A text without an id.", None, "c"), (None, None, None, None),
        (6, "one SMALL text about nothing.  with a second line of words.", "en", "c"),
        (7, "Mail me at some.one42@example.org or call +1 (803) 555-4232.", "en", None),
        (1, "Another text with the id of the first one.", "en", "a"),
    ]
    return [(i, t, lang, source, None if t is None else len(t), *extra) for i, t, lang, source in base]


def edge_documents(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


def empty_documents(spark):
    return spark.createDataFrame([], SCHEMA)
