import pytest

from lathe.session import local_session


@pytest.fixture(scope="session")
def spark():
    s = local_session(4, 4, **{"spark.sql.warehouse.dir": "/tmp/lathe-warehouse"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
