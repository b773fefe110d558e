"""One small session for all tests."""
import sys, os; sys.path.insert(0, os.path.dirname(__file__))

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from groundwork.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session(cpus=4, shuffle_partitions=4)


@pytest.fixture(scope="session")
def data():
    """The smallest test tables; tests that need them are skipped where there are none."""
    folder = os.environ.get("GROUNDWORK_TEST_DATA", "/root/testdata/sf0.001")
    if not os.path.isdir(folder):
        pytest.skip("no test tables here")
    return folder
