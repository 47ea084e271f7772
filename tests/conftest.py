import pytest

from harness.check import session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = session(4)
    s.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoint")))
    return s
