import pytest
from corpora import prose

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, doc string, key int, line string, n int"


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty and long texts, ties, repeated rows, column names that clash."""
    base, other = prose(1, 150), prose(2, 90)
    words = base.split(" ")
    near = " ".join([*words[:70], "changed", *words[71:]])
    rows = [
        (1, base, "en"), (2, base, "en"), (3, near, "en"), (4, other, None), (5, None, "en"), (6, "", "de"),
        (7, "one", "en"), (8, "ONE", "en"), (9, "two words", "en"), (10, "  \n\t ", None), (None, prose(3, 60), "en"),
        (11, other, "en"), (11, other, "en"), (12, prose(4, 40) + "\n" + other + "\n" + prose(5, 40), "en"),
        (13, "ab " * 400, "en"), (14, "x" * 700, "en"), (15, prose(6, 3000), "de"), (16, "Ünï çødé " * 30 + base, "fr"),
        (17, "a\x00b  c\r\nd  e f " + prose(7, 55), "en"), (-5, prose(8, 80).upper(), "en"),
    ]
    return [(i, t, lang, None if i == 3 else "s", None, "clash", 7, None, 1) for i, t, lang in rows]


@pytest.fixture(scope="session")
def odd_documents(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], SCHEMA)
