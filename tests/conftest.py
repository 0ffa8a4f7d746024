import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from panelwell.session import GROUP_ROWS_KEY, local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, 4, "4g")
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture
def tiny_groups(spark):
    """Lets no group over 7 rows be ordered in one task, so that the segmented way is taken."""
    spark.conf.set(GROUP_ROWS_KEY, "7")
    yield
    spark.conf.unset(GROUP_ROWS_KEY)


def stamp(text):
    import datetime

    return datetime.datetime.fromisoformat(text)


@pytest.fixture(scope="session")
def ts():
    return stamp
