import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from shotsmith.session import get_session
    s = get_session("*", shuffle_partitions=8, app="shotsmith-tests")
    yield s
    s.stop()
