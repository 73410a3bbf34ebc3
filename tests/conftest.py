from __future__ import annotations

import pytest

from corpuswright.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", 4)
    session.sparkContext.setLogLevel("ERROR")
    return session
