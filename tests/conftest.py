"""One Spark session for the whole run."""

import pytest

from tests.compare import session


@pytest.fixture(scope="session")
def spark():
    yield session()
