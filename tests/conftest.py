import pytest

from ticketloom.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", 4, **{"spark.ui.showConsoleProgress": "false"})
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"
