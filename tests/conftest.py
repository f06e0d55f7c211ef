import datetime as dt
import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from kelasflow.session import build_session, ensure_checkpoint_dir  # noqa: E402

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    s = build_session("local[4]", app="kelasflow-tests", shuffle_partitions=8)
    ensure_checkpoint_dir(s, fallback=tempfile.mkdtemp(prefix="kelasflow-test-ckpt-"))
    yield s


def ts(y, m, d, hh=0, mm=0):
    return dt.datetime(y, m, d, hh, mm)


def rows(df, order=None):
    out = [tuple(r) for r in df.collect()]
    return sorted(out, key=repr) if order is None else out
