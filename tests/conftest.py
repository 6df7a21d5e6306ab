from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).parents[1]), str(Path(__file__).parent)]


@pytest.fixture(scope="session")
def spark():
    from tallyloom.session import local_session

    session = local_session("*", 8)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir() -> str:
    path = Path("/root/testdata/sf0.001")
    if not path.exists():
        pytest.skip("no test tables here")
    return str(path)
