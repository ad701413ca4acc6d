import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]").appName("skeinlog-tests").config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.driver.memory", "4g")
        .config("spark.ui.showConsoleProgress", "false").config("spark.python.sql.dataFrameDebugging.enabled", "false").getOrCreate()
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture
def tiny_blocks(spark):
    """Blocks of a few rows, so that carrying values across blocks is what the test runs."""
    from skeinlog.session import BLOCK_ROWS_CONF
    spark.conf.set(BLOCK_ROWS_CONF, "5")
    yield
    spark.conf.unset(BLOCK_ROWS_CONF)
