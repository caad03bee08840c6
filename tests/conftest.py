import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pulsegrid.session import build_session

    session = build_session("pulsegrid-tests", master="local[8]", shuffle_partitions=8)
    session.conf.set("spark.sql.autoBroadcastJoinThreshold", str(10 << 20))
    session.sparkContext.setLogLevel("ERROR")
    yield session
