import pytest

from sparkfen.session import get_session


@pytest.fixture(scope="session")
def spark():
    return get_session("tests", cpus=4)
