import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from ledgerloom.session import local_session

    session = local_session("tests", cores="8", partitions=4)
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def rows():
    """Collect a frame as sorted plain tuples."""
    return lambda df: sorted((tuple(r) for r in df.collect()), key=repr)
