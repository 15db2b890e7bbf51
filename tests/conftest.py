import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from regionpulse.session import checkpoint_dir, get_session

    s = get_session("local[4]", shuffle_partitions=4, app="regionpulse-tests")
    if not s.sparkContext.getCheckpointDir() and not s.conf.get("spark.checkpoint.dir", None):
        s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="rp-test-ckpt-"))
    checkpoint_dir(s)
    yield s


SF0001 = "/root/testdata/sf0.001"
SF001 = "/root/testdata/sf0.01"
