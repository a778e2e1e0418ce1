"""Every catalogue entry with an SQL twin equals DuckDB on the same parquet."""

import pytest

import __spark_entry__ as entry
import tools.check_oracle as check
from tools.check_oracle import compare, duck

from book_paths import SF_SMALL

SQL = entry.oracle_sql()
QUERIES = entry.queries()
check.EXACT = True    # floats must agree bit for bit
check.DTYPES = True   # and arrive as the same pandas dtypes


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_oracle(spark, con, name):
    problems, n, _, _ = compare(spark, con, name, QUERIES[name], SQL[name], SF_SMALL)
    assert not problems, problems


def test_every_query_has_a_callable():
    assert set(SQL) <= set(QUERIES)


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.columns == ["Region", "DefaultRate", "NumLoans"]
    assert df.count() > 0
