from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from graphloom.session import local_session

    s = local_session(os.environ.get("TEST_CPUS", "8"), "8g", 8)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
