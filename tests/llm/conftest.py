import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from tablewise.session import get_session

    return get_session(master="local[*]", shuffle_partitions=8, app="tablewise-llm-tests")
