import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from wiretally.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, 4)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small(spark):
    """The given tables at the smallest scale with the request-shaped views."""
    from wiretally.catalog.views import Tables
    return Tables(spark, "/root/testdata/sf0.001")
