import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from patchloom.session import local_session
    s = local_session("*", shuffle_partitions=8)
    yield s
    s.stop()


@pytest.fixture
def make_diffs(spark):
    """``make_diffs(a=text, b=text)`` -> diffs(diff_id, content)."""
    def _make(**texts):
        rows = [(k, v) for k, v in texts.items()]
        return spark.createDataFrame(rows, "diff_id string, content string").repartition(2, "diff_id")
    return _make
