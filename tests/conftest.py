"""One local session for all tests."""

from __future__ import annotations

import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from crossweave.session import local_session, ship_package

    folder = tmp_path_factory.mktemp("shared")
    session = local_session(4, "4g", "tests", **{"spark.sql.shuffle.partitions": "4", "spark.checkpoint.dir": f"file://{folder}"})
    ship_package(session)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF
