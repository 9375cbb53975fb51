import pytest

from quern.session import local_session


@pytest.fixture(scope="session")
def spark():
    s = local_session(4, "4g", "tests")
    s.sparkContext.setLogLevel("ERROR")
    s.conf.set("spark.sql.shuffle.partitions", "4")
    yield s


@pytest.fixture()
def root(tmp_path):
    return f"file://{tmp_path}"
