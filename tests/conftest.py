import pytest

from tidemark.session import local_session

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = "file://" + str(tmp_path_factory.mktemp("checkpoints"))
    s = local_session("tests", cores=8, spark__sql__shuffle__partitions="4", spark__ui__showConsoleProgress="false", spark__checkpoint__dir=shared)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def small():
    return SMALL
