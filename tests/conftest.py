import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ.setdefault("TZ", "UTC")
DATA = os.environ.get("VELLUMQ_TESTDATA", "/root/testdata")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .config("spark.checkpoint.dir", tmp_path_factory.mktemp("cp").as_uri())
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    from vellumq.session import ship

    ship(s)
    yield s


@pytest.fixture(scope="session")
def data():
    if not Path(DATA, "sf0.001").exists():
        pytest.skip("no test tables")
    return f"{DATA}/sf0.001"
