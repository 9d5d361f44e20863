import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from transcript_lake.session import lake_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"
MEDIUM = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    s = lake_session("local[4]", 4, **{"spark.sql.shuffle.partitions": "4"})
    yield s
    s.stop()


@pytest.fixture
def tmp(tmp_path_factory):
    """A fresh scratch folder per test (never reused, never cleared)."""
    return tempfile.mkdtemp(prefix="tl-", dir=str(tmp_path_factory.getbasetemp()))
