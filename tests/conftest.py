import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))


@pytest.fixture(scope="session")
def spark():
    from tapeloom.session import session

    s = session(
        "local[8]", spark__sql__shuffle__partitions="8", spark__driver__memory="8g",
        spark__sql__warehouse__dir="/tmp/tapeloom-test-warehouse",
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
