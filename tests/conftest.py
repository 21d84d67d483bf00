import pytest

from quillspark.session import local_session


@pytest.fixture(scope="session")
def spark():
    yield local_session(4, 4)


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
