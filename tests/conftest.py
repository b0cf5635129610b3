import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from mapstats.session import local_session

    session = local_session("tests", cores=4, shuffle_partitions=4, checkpoint_dir=tempfile.mkdtemp(prefix="mapstats-test-"))
    yield session
    session.stop()
