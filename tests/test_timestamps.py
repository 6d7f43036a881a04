import datetime as dt

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from logloom.functions import timestamps as ts

CASES = [
    ("2026-07-20T14:32:00Z", "2026-07-20T14:32:00.000Z"),
    ("2026-07-20T14:32:00.1Z", "2026-07-20T14:32:00.100Z"),
    ("2026-07-20T14:32:00.123456Z", "2026-07-20T14:32:00.123Z"),
    ("2026-07-20T14:32:00.123999999Z", "2026-07-20T14:32:00.123Z"),
    ("1969-12-31T23:59:59.9999Z", "1969-12-31T23:59:59.999Z"),
    ("2026-07-20T14:32Z", "2026-07-20T14:32:00.000Z"),
    ("2026-07-20T14:32", "2026-07-20T14:32:00.000Z"),
    ("2026-07-20t14:32:00z", "2026-07-20T14:32:00.000Z"),
    ("2026-07-20", "2026-07-20T00:00:00.000Z"),
    ("2026-07", "2026-07-01T00:00:00.000Z"),
    ("2026", "2026-01-01T00:00:00.000Z"),
    ("2026-07-20T14:32:00+02:00", "2026-07-20T12:32:00.000Z"),
    ("2026-07-20T14:32:00+0200", "2026-07-20T12:32:00.000Z"),
    ("2026-07-20 14:32:00Z", "2026-07-20T14:32:00.000Z"),
    ("2026-07-20 14:32:00.5-0130", "2026-07-20T16:02:00.500Z"),
    ("2026-07-20 14:32", "2026-07-20T14:32:00.000Z"),
    ("2026-07 14:32", None),
    ("2026 14:32Z", None),
    ("2026-07-20  14:32", None),
    ("2026-07-20T14:32:00-23:59", "2026-07-21T14:31:00.000Z"),
    ("2026-07-20T24:00:00Z", "2026-07-21T00:00:00.000Z"),
    ("2026-12-31T24:00", "2027-01-01T00:00:00.000Z"),
    ("2024-02-29T00:00:00.000Z", "2024-02-29T00:00:00.000Z"),
    ("2026-02-30T00:00:00Z", "2026-03-02T00:00:00.000Z"),
    ("2026-04-31", "2026-05-01T00:00:00.000Z"),
    ("0001-01-01T00:00:00Z", "0001-01-01T00:00:00.000Z"),
    ("9999-12-31T23:59:59.999Z", "9999-12-31T23:59:59.999Z"),
    ("2026-07-20T24:00:01Z", None),
    ("2026-13-01T00:00:00Z", None),
    ("2026-00-01", None),
    ("2026-07-32", None),
    ("2026-07-20T14:60:00Z", None),
    ("2026-07-20T14:32:60Z", None),
    ("2026-07-20T14:32:00Z\n", None),
    ("2026-07-20T14", None),
    ("2026-7-2", None),
    ("12:00", None),
    ("not-a-timestamp", None),
    ("", None),
]


@pytest.fixture(scope="module")
def parsed(spark):
    frame = spark.createDataFrame([(text,) for text, _ in CASES], "text string")
    rows = frame.select(
        "text",
        ts.iso_millis(ts.parse_iso("text")).alias("iso"),
        F.unix_micros(ts.parse_iso("text")).alias("micros"),
    ).collect()
    return {row["text"]: row for row in rows}


@pytest.mark.parametrize("text, expected", CASES)
def test_parse(parsed, text, expected):
    assert parsed[text]["iso"] == expected
    ms = ts.parse_instant(text)
    assert (None if ms is None else ts.render_instant(ms)) == expected
    if ms is not None:
        assert parsed[text]["micros"] == ms * 1000


@given(st.integers(-62135596800000, 253402300799999))
def test_driver_round_trip(ms):
    text = ts.render_instant(ms)
    assert ts.parse_instant(text) == ms
    assert ts.day_of_ms(ms) == text[:10]


def test_days_stay_in_order_at_the_end_of_time():
    assert ts.day_of_ms(ts.parse_instant("9999-12-31T24:00")) == "9999-12-31"


@pytest.mark.parametrize("width", [60, 300, 3600, 86400])
def test_bucket_start(spark, width):
    anchor = ts.parse_instant("2026-07-20T10:17:23.456Z")
    offsets = [-200000000, -1, 0, 1, 59999, 60000, 299999, 300000, 3599999, 3600000, 86400000]
    frame = spark.createDataFrame([(anchor + n,) for n in offsets], "ms long")
    rows = frame.select(
        "ms",
        F.unix_millis(
            ts.bucket_start(F.timestamp_millis("ms"), anchor, width)
        ).alias("start"),
    ).collect()
    for row in rows:
        step = width * 1000
        assert row["start"] == anchor + (row["ms"] - anchor) // step * step


def test_day_of(spark):
    row = spark.sql("SELECT TIMESTAMP '2026-07-20 23:59:59.999' AS t").select(
        ts.day_of(F.col("t")).alias("day")
    ).first()
    assert row["day"] == dt.date(2026, 7, 20).isoformat()
