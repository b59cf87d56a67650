import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    builder = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
    builder = builder.config("spark.local.dir", f"{base}/local").config("spark.sql.warehouse.dir", f"{base}/warehouse").config("spark.checkpoint.dir", f"file://{base}/shared").config("spark.driver.memory", "4g")
    session = builder.config("spark.ui.showConsoleProgress", "false").getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
