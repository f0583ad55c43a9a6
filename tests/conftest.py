import pytest

from carefold.session import build_session


@pytest.fixture(scope="session")
def spark():
    s = build_session("tests", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g"})
    s.sparkContext.setLogLevel("ERROR")
    return s
