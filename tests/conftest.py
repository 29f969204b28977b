import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from casestory.session import checkpoint_dir, get_spark
    s = get_spark(master="local[*]", shuffle_partitions=8)
    checkpoint_dir(s, tempfile.mkdtemp(prefix="casestory-test-ckpt-"))
    yield s
