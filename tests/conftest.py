import os
import signal
import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
#: Seconds a test may take.
LIMIT = int(os.environ.get("COLLATIO_TEST_LIMIT", "600"))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .appName("collatio-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(autouse=True)
def time_limit(request):
    """Ends a test that hangs, so that one plan does not take the later tests along."""

    def over(signum, frame):
        if running := SparkSession.getActiveSession():
            running.sparkContext.cancelAllJobs()
        raise TimeoutError(f"{request.node.name} took more than {LIMIT} seconds")

    before = signal.signal(signal.SIGALRM, over)
    signal.alarm(LIMIT)
    yield
    signal.alarm(0)
    signal.signal(signal.SIGALRM, before)
