import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from fieldtrace.plans.registry import Tables  # noqa: E402
from fieldtrace.session import local_session  # noqa: E402

SF = os.environ.get("FIELDTRACE_TEST_SF", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    return local_session(8, 4)


@pytest.fixture(scope="session")
def tables(spark):
    return Tables(spark, SF)


@pytest.fixture(scope="session")
def sf_dir():
    return SF


def rows(df, *order):
    """Collected rows as tuples in a stable order."""
    return sorted((tuple(r) for r in df.collect()), key=repr)
