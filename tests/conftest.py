import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from licmatch.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("licmatch-tests", **{
        "spark.master": "local[4]", "spark.ui.enabled": "false",
        "spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g",
        "spark.ui.showConsoleProgress": "false"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture()
def folder():
    return tempfile.mkdtemp(prefix="licmatch-test-")
