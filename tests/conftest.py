import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from nearkin.session import get_spark  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("checkpoint"))
    session = get_spark("tests", "8", **{"spark.sql.shuffle.partitions": "8", "spark.checkpoint.dir": folder})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
