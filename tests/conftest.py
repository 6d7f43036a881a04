import datetime as dt
import json
import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from logloom.functions.timestamps import parse_instant  # noqa: E402
from logloom.session import prepare  # noqa: E402
from logloom.sources import envelopes  # noqa: E402
from logloom.sources.table import LogTable  # noqa: E402

NOW = "2026-07-20T12:00:00.000Z"
TODAY = dt.date(2026, 7, 20)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .appName("tests")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.driver.extraJavaOptions", "-XX:TieredStopAtLevel=1")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .config("spark.sql.maxMetadataStringLength", "10000")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield prepare(session)
    session.stop()


@pytest.fixture
def now():
    return F.timestamp_millis(F.lit(parse_instant(NOW)).cast("long"))


@pytest.fixture
def table(spark, tmp_path):
    return LogTable(spark, str(tmp_path / "table")).create(TODAY)


def entry(**changes):
    """A good entry; a change to ``...`` removes the field."""
    fields = {
        "timestamp": "2026-07-20T11:00:00.000Z",
        "level": "info",
        "service": "checkout",
        "message": "order placed",
        "attributes": {"user_id": "42", "paid": True, "retries": 3},
        **changes,
    }
    return {name: value for name, value in fields.items() if value is not ...}


def body(*entries):
    return json.dumps({"logs": list(entries)})


def batches(spark, *bodies):
    rows = [(f"b{number}", text) for number, text in enumerate(bodies)]
    frame = spark.createDataFrame(rows, "id string, body string")
    return envelopes.from_column(frame, "id", "body")
