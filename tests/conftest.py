import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from book_paths import SF_CHECK  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    from loanscope.session import local_session

    s = local_session(cpus="*", shuffle_partitions=8, app="loanscope-tests")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def book(spark):
    from loanscope.sources.fixtures import load_book

    return load_book(spark, SF_CHECK)
