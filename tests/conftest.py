import pytest

from kinegrid.session import local_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session(4, 4, "tests", **{"spark.checkpoint.dir": f"file://{tmp_path_factory.mktemp('checkpoint')}"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
