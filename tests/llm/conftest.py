import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from llm_util import CLASHES, DOCS, LONG, PROSE  # noqa: E402


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, clashing extra columns."""
    rows = [
        (1, PROSE, "en", "a", 1), (2, PROSE, "en", "a", 1), (2, PROSE, "en", "a", 1), (3, None, "en", "a", None),
        (4, "", "en", None, 0), (5, "   \n\t ", None, "b", 5), (6, "word", "fr", "b", 4), (7, LONG, "en", "c", None),
        (8, LONG + " tail", "en", "c", None), (9, "12345 67890", "de", "c", 11), (None, "no id here", "en", "a", 3),
        (10, "one two", None, None, None), (10, "one two", None, None, None), (10, "another text of this id", "en", "a", 2),
        (11, "ünï çödé ßtraße naïve café", "de", "b", 9),
    ]
    df = spark.createDataFrame(rows, DOCS)
    for i, c in enumerate(CLASHES):
        df = df.selectExpr("*", f"{i} AS `{c}`")
    return df.repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
