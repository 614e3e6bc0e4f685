import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ["PYTHONPATH"] = os.pathsep.join([sys.path[0], os.environ.get("PYTHONPATH", "")])


@pytest.fixture(scope="session")
def spark():
    from quarryline.session import build_session

    session = build_session("tests", cpus=int(os.environ.get("TEST_CPUS", "8")), memory="6g", partitions=8)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
