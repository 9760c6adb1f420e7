import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SMOKE = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from riskframe.session import get_session
    shared = tempfile.mkdtemp(prefix="riskframe-tests-")
    s = get_session("local[4]", app="riskframe-tests", shuffle_partitions=4, conf={"spark.checkpoint.dir": shared})
    yield s
    s.stop()
