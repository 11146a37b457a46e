import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from vigil.session import get_spark

    s = get_spark(master="local[4]", shuffle_partitions=8,
                  extra={"spark.checkpoint.dir": tempfile.mkdtemp(prefix="vigil-test-ckpt-")})
    yield s
    s.stop()


@pytest.fixture(scope="session")
def small_dir():
    return SMALL


def rows(df, *cols):
    """Collect as sorted list of tuples (for order-insensitive asserts)."""
    cols = cols or df.columns
    return sorted(tuple(r[c] for c in cols) for r in df.collect())
