import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from textfold.session import get_session

    s = get_session("local[4]", app="textfold-tests", shuffle_partitions=8)
    yield s


@pytest.fixture
def tmpdir_fresh(tmp_path):
    return str(tmp_path)
