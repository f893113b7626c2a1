import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from lodestone.session import build_session
    return build_session("local[8]", shuffle_partitions=4, memory="8g", app="tests")


@pytest.fixture(scope="session")
def data():
    return "/root/testdata/sf0.001"
