"""A Spark session for all tests."""

import os
import sys
import tempfile
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

HERE = Path(__file__).resolve().parent
sys.path.insert(0, str(HERE.parent))
# Python workers import the package and the tests' fakes by name
os.environ["PYTHONPATH"] = os.pathsep.join([str(HERE.parent), str(HERE), os.environ.get("PYTHONPATH", "")])


@pytest.fixture(scope="session")
def spark():
    builder = SparkSession.builder.master("local[4]").appName("notegrain-tests")
    conf = {"spark.checkpoint.dir": tempfile.mkdtemp(prefix="notegrain-tests-"), "spark.cleaner.referenceTracking.cleanCheckpoints": "true", "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "4g", "spark.sql.session.timeZone": "UTC", "spark.ui.showConsoleProgress": "false"}
    session = builder.config(map=conf).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
