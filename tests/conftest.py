import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from runledger.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("runledger-tests", "8", **{"spark.sql.shuffle.partitions": "2"})
    yield session
    session.stop()


def rows(df):
    """Rows as a sorted list of tuples."""
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((v is None, str(v)) for v in r))
