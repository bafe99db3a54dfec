import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from kbspark.session import get_session
    ckpt = tempfile.mkdtemp(prefix="kbspark-test-ckpt-")
    s = get_session("local[4]", shuffle_partitions=4, extra={"spark.checkpoint.dir": ckpt})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture
def tmp_root(spark):
    from kbspark.session import scratch_dir
    return scratch_dir(spark, "test")
