from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

from epitrove.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session("8", "epitrove-tests")


@pytest.fixture
def small_splits(spark):
    """Files are cut every few bytes, as large files are on a cluster."""
    settings = {"spark.sql.files.maxPartitionBytes": "16", "spark.sql.files.openCostInBytes": "1"}
    before = {name: spark.conf.get(name) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    yield
    for name, value in before.items():
        spark.conf.set(name, value)


def rows(frame, *order):
    """Collected rows as tuples, sorted."""
    return sorted((tuple(r) for r in frame.collect()), key=lambda r: tuple((v is not None, str(v)) for v in r))
