import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from marketloom.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("local[8]", 8, spark__checkpoint__dir=tempfile.mkdtemp(prefix="marketloom-tests-"))
    yield session
    session.stop()
