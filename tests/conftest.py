import pytest

from loomgraph.runtime import session


@pytest.fixture(scope="session")
def spark():
    s = session("local[8]", 4)
    s.sparkContext.setLogLevel("ERROR")
    return s
