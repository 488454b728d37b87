import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from signalmill.session import build_session

    s = build_session("local[8]", 8, "tests")
    yield s
    s.stop()
