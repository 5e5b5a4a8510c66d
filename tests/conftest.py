import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ.setdefault("PYTHONPATH", sys.path[0])
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from lexwarden.session import local_session

    where = tmp_path_factory.mktemp("spark")
    session = local_session(4, spark__sql__shuffle__partitions="4", spark__ui__showConsoleProgress="false", spark__sql__warehouse__dir=str(where / "warehouse"), spark__checkpoint__dir=f"file://{where}/checkpoint")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF
