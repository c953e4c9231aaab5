import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from threadloom.session import session, ship  # noqa: E402

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    s = session("local[4]", "tests", spark__sql__shuffle__partitions="4", spark__ui__enabled="false", spark__ui__showConsoleProgress="false")
    s.sparkContext.setLogLevel("OFF")
    return ship(s)


@pytest.fixture(scope="session")
def data():
    if not Path(DATA).exists():
        pytest.skip("no test data")
    return DATA
