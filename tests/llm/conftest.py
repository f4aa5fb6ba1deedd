import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import pytest

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def sf():
    if not os.path.isdir(SF):
        pytest.skip("test tables not present")
    return SF


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in any column, empty and very long texts, ties, repeated rows."""
    long = " ".join(f"w{i % 5000}" for i in range(60_000))
    rows = [(1, "alpha beta gamma delta", "en", "s1", 1), (2, "alpha  beta\tgamma\ndelta", "en", "s1", 1),
            (2, "alpha  beta\tgamma\ndelta", "en", "s1", 1), (3, None, "en", None, None), (4, "", None, "s2", 0),
            (5, " \n\t ", "en", "s2", 4), (None, "null id here", "en", "s2", 1), (6, long, "en", "s3", len(long)),
            (7, "x" * 200_000, "en", "s3", 1), (8, "é ü ñ 日本 \U0001f600 İ ΑΣ", "xx", "s1", 1),
            (9, "alphabetagammadelta", "en", "s1", 1), (None, "null id here", "en", "s2", 1)]
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, DOCS)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 1, 0), (6, 0, 0), (None, 1, 0), (9, None, None)], "doc_id long, quality int, toxic int")
