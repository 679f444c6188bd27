import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from logloom.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests", "local[" + os.environ.get("LOGLOOM_TEST_CPUS", "8") + "]",
        **{
            "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g",
            "spark.ui.showConsoleProgress": "false", "spark.log.level": "ERROR",
        },
    )
    yield session
    session.stop()


@pytest.fixture
def rows():
    """Collected rows as dictionaries, for small results."""
    return lambda df: [r.asDict(recursive=True) for r in df.collect()]
