import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from rivalry.session import build_session
    ck = tempfile.mkdtemp(prefix="rivalry-test-ckpt-", dir="/tmp")
    s = build_session("local[4]", app="rivalry-tests",
                      conf={"spark.sql.shuffle.partitions": "4", "spark.checkpoint.dir": ck})
    yield s
    s.stop()
