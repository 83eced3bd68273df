import pytest

ODD = [
    (1, "one line here to keep\nshort\none line here to keep", "en", "a"),
    (2, "One Line here to keep \nsecond text line", "en", "a"),
    (3, None, None, None),
    (4, "", "de", "b"),
    (None, "no id but a line of text", "de", "b"),
    (5, "second text line\n\n" + "wort " * 9000, "de", "b"),
    (6, "same text twice " * 30, "en", "c"),
    (7, "same text twice " * 30, "en", "c"),
    (7, "same text twice " * 30, "en", "c"),
    (8, "Ünïcode ǅ   <|endoftext|> it's 日本 é İ ﬁ", "fr", "c"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, and columns whose names clash with the operators' own."""
    rows = [(*r, len(r[1] or ""), 1, 2, "x", 3.0) for r in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, id int, h int, n_lines string, size double").repartition(3)


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.where("false")
