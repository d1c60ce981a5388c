import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from veldra.session import local_session

    s = local_session(4, "tests", "3g", spark__sql__shuffle__partitions="3", spark__default__parallelism="3")
    yield s
    s.stop()
