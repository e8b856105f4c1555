"""Documents that the operators' tests share."""

import pytest

SMALL = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, row string, position int, _order string"


@pytest.fixture(scope="session")
def given(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls everywhere, empty and long texts, ties, repeated rows, and columns named like the operators' own."""
    long = " ".join(f"w{i % 997} x{i}" for i in range(6000))
    same = "the quick brown fox jumps over the lazy dog " * 12
    rows = [
        (1, None, "en", "a"), (2, "", None, "a"), (3, " \t\n ", "en", None), (4, long, "en", "a"), (5, same, "en", "b"), (6, same, "en", "b"), (6, same, "en", "b"),
        (7, same + "end", None, None), (None, "no id here", "en", "b"), (None, None, None, None), (8, "one", "fr", "c"), (9, "ÀÉ   é́ <|endoftext|> don't", "fr", "c"),
        (10, "x" * 20000, "de", "c"), (11, "a b c d", "de", "c"), (12, "A B C D", "de", "c"), (13, "漢字 かな 🤦🏼‍♂️ ok\x0b\x0cend", None, "c"), (13, "other text of the same id", None, "c"),
    ]
    return spark.createDataFrame([(i, t, g, s, None, True, "r", 1, "o") for i, t, g, s in rows], COLUMNS)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], COLUMNS)
