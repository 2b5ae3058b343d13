import os

import duckdb
import pytest

from minegrove.session import local_session

DATA = os.environ.get("MINEGROVE_TEST_DATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = local_session(cpus=4, partitions=4, memory="4g", app="tests")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data():
    if not os.path.isdir(DATA):
        pytest.skip("the test tables are not here")
    return DATA


@pytest.fixture(scope="session")
def duck(data):
    connection = duckdb.connect()
    for name in sorted(os.listdir(data)):
        path = os.path.join(data, name)
        source = f"{path}/*.parquet" if os.path.isdir(path) else path
        connection.sql(f"create view {name.split('.')[0]} as select * from '{source}'")
    return connection
