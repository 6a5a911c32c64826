import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from capacitron.session import get_session
    extra = {}
    from pyspark.sql import SparkSession
    if SparkSession.getActiveSession() is None:
        # tests only: a scratch checkpoint folder when the environment names none
        extra["spark.checkpoint.dir"] = os.environ.get("SPARK_CHECKPOINT_DIR") or tempfile.mkdtemp(prefix="capacitron-test-")
    s = get_session("local[4]", app="capacitron-tests", shuffle_partitions=4, extra=extra)
    s.sparkContext.setLogLevel("ERROR")
    yield s


@pytest.fixture
def tmpdir_path():
    return tempfile.mkdtemp(prefix="capacitron-t-")
