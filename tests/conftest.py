import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from lodestar.operators.tables import release
    from lodestar.plans.session import session

    s = session("tests", master="local[4]", partitions=4)
    yield s
    release(s)
    s.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return os.environ.get("LODESTAR_TEST_DIR", "/root/testdata/sf0.001")
