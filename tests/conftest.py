import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"
SF_ORACLE = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession
    from quadflow.session import get_session
    builder = SparkSession.builder
    if not os.environ.get("SPARK_CHECKPOINT_PRESET"):
        builder.config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="quadflow-test-ckpt-"))
    session = get_session("local[8]", "quadflow-tests", shuffle_partitions=8)
    session.sparkContext.setLogLevel("ERROR")
    yield session
