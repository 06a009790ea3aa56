import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from riskframe.session import get_spark
    s = get_spark("local[4]", app="riskframe-tests", shuffle_partitions=4,
                  extra={"spark.driver.memory": "4g"})
    s.sparkContext.setLogLevel("OFF")
    if not s.conf.get("spark.checkpoint.dir", None):
        s.conf.set("spark.checkpoint.dir", tempfile.mkdtemp(prefix="rf-test-ckpt-", dir="/tmp"))
    yield s
    s.stop()


@pytest.fixture
def tmpdir_fresh():
    return tempfile.mkdtemp(prefix="rf-test-", dir="/tmp")

