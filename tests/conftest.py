"""One local session for all tests."""

import pytest

from auditloom.session import local_session


@pytest.fixture(scope="session")
def spark():
    s = local_session(cpus=4, memory="4g", app="tests")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
