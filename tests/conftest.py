import os
import sys

import pytest
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    conf = {
        "spark.sql.shuffle.partitions": "4",
        "spark.default.parallelism": "4",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.session.timeZone": "UTC",
        "spark.checkpoint.dir": str(tmp_path_factory.mktemp("checkpoints")),
    }
    builder = SparkSession.builder.master("local[4]").appName("tests")
    session = builder.config(map=conf).getOrCreate()
    session.sparkContext.setLogLevel("OFF")
    session.sparkContext.setCheckpointDir(conf["spark.checkpoint.dir"])
    yield session
    session.stop()
