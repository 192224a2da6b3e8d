import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from cohortry.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "cohortry-tests")
    yield session
    session.stop()


@pytest.fixture(autouse=True)
def small_limits(monkeypatch):
    """Make small fixtures take the paths that large tables take: many cells, salted joins."""
    from cohortry.operators import prefix, skew

    monkeypatch.setattr(prefix, "CELL_ROWS", 10)
    monkeypatch.setattr(skew, "HOT_ROWS", 5)
