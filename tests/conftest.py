import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from sievework.session import local_session

    s = local_session(4, driver_memory="4g")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def data():
    d = Path("/root/testdata/sf0.01")
    if not d.exists():
        pytest.skip("no test data here")
    return str(d)
