import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from sparkmill.session import get_session
    s = get_session("local[4]", app="sparkmill-tests", shuffle_partitions=8)
    # Tests own their checkpoint folder (a cluster names its own shared one).
    if not s.sparkContext.getCheckpointDir():
        s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="sparkmill-test-ckpt-"))
    yield s
    s.stop()


@pytest.fixture()
def tmpdir_fresh():
    return tempfile.mkdtemp(prefix="sparkmill-test-")


def rows(df, *cols):
    cols = cols or df.columns
    out = [tuple(r[c] for c in cols) for r in df.collect()]
    # Nulls sort first within a column; values of one column share a type.
    return sorted(out, key=lambda t: tuple((v is not None, v if v is not None else 0) for v in t))
