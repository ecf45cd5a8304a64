import os
import sys
import time
from pathlib import Path

import pytest

os.environ["TZ"] = "UTC"
time.tzset()
sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from clusterlens.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    scratch = tmp_path_factory.mktemp("spark")
    session = local_session(
        8,
        "clusterlens-tests",
        **{
            "spark.sql.warehouse.dir": str(scratch / "warehouse"),
            "spark.sql.shuffle.partitions": "4",
            "spark.sql.maxMetadataStringLength": "5000",
            "spark.sql.dataFrameQueryContext.enabled": "false",
        },
    )
    yield session
    session.stop()


@pytest.fixture
def settings(spark):
    """Set session options for one test."""
    before = {}

    def apply(**options):
        for name, value in options.items():
            key = name.replace("__", ".")
            before.setdefault(key, spark.conf.get(key, None))
            spark.conf.set(key, value)

    yield apply
    for key, value in before.items():
        if value is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, value)
