import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from canonspark import get_spark  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = get_spark(master="local[*]", shuffle_partitions=8)
    yield s


SF_SMALL = "/root/testdata/sf0.001"
