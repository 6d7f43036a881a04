import pytest
from pyspark.sql import functions as F

from logloom.errors import InvalidRequest
from logloom.functions.text import escape_like
from logloom.operators import filters
from logloom.operators.aggregate import parse_aggregate_request
from logloom.operators.filters import LogFilter, TimeRange, filter_condition, parse_filters
from logloom.operators.listing import parse_list_request

GOOD_RANGE = {"since": "2026-07-20T00:00:00Z", "until": "2026-07-21T00:00:00Z"}
GOOD_COUNT = {**GOOD_RANGE, "bucket": "1h"}

SHARED = [
    ({"service": ""}, "service must be a single non-empty string"),
    ({"service": ["a", "b"]}, "service must be a single non-empty string"),
    ({"level": ["info", "warn"]}, "level must be a single string"),
    ({"level": "critical"}, "invalid level: 'critical'"),
    ({"level": "Info"}, "invalid level: 'Info'"),
    ({"level": ""}, "invalid level: ''"),
    ({"q": ["a", "b"]}, "q must be a single string"),
    ({"attr.": "x"}, "attribute filter key must not be empty"),
    ({"attr.k": ["1", "2"]}, "attr.k must be a single string"),
    ({"attr.a.b": ["1", "2"]}, "attr.a.b must be a single string"),
    ({"since": ["a"]}, "since must be a single string"),
    ({"since": "soon"}, "invalid timestamp for since: 'soon'"),
    ({"until": ""}, "invalid timestamp for until: ''"),
    ({"since": "2026-07-20", "until": "2026-07-19"}, "until must not be earlier than since"),
]
LIST_ONLY = [
    ({"limit": ["1"]}, "limit must be a single numeric value"),
    ({"limit": ""}, "limit must be a single numeric value"),
    ({"limit": " \t"}, "limit must be a single numeric value"),
    ({"limit": "1.5"}, "limit must be a non-negative integer"),
    ({"limit": "-1"}, "limit must be a non-negative integer"),
    ({"limit": "1e2"}, "limit must be a non-negative integer"),
    ({"limit": "١"}, "limit must be a non-negative integer"),
    ({"limit": "0"}, "limit must be between 1 and 1000"),
    ({"limit": "1001"}, "limit must be between 1 and 1000"),
    ({"limit": "9" * 5000}, "limit must be between 1 and 1000"),
    ({"cursor": ["a"]}, "cursor must be a single string"),
    ({"cursor": "garbage"}, "invalid or malformed cursor"),
    ({"service": "", "since": "soon", "limit": "0"}, "service must be a single non-empty string"),
    ({"since": "soon", "limit": "0"}, "invalid timestamp for since: 'soon'"),
    ({"limit": "0", "cursor": "x"}, "limit must be between 1 and 1000"),
]
COUNT_ONLY = [
    ({"since": None}, "since is required"),
    ({"until": None}, "until is required"),
    ({"bucket": None}, "bucket is required"),
    ({"bucket": "2m"}, "bucket must be one of: 1m, 5m, 1h, 1d"),
    ({"bucket": "constructor"}, "bucket must be one of: 1m, 5m, 1h, 1d"),
    ({"bucket": ["1m"]}, "bucket must be one of: 1m, 5m, 1h, 1d"),
    ({"group_by": "message"}, "group_by must be one of: service, level"),
    ({"group_by": ""}, "group_by must be one of: service, level"),
    ({"group_by": ["service"]}, "group_by must be one of: service, level"),
    ({"level": "x", "since": None}, "invalid level: 'x'"),
    ({"since": None, "bucket": None}, "since is required"),
    ({"bucket": None, "group_by": "x"}, "bucket is required"),
]


@pytest.mark.parametrize("params, message", SHARED + LIST_ONLY)
def test_bad_list_arguments(params, message):
    with pytest.raises(InvalidRequest) as error:
        parse_list_request(params)
    assert str(error.value) == message


@pytest.mark.parametrize("params, message", SHARED + COUNT_ONLY)
def test_bad_count_arguments(params, message):
    with pytest.raises(InvalidRequest) as error:
        parse_aggregate_request({**GOOD_COUNT, **params})
    assert str(error.value) == message


def test_good_arguments():
    assert parse_filters({}) == LogFilter()
    assert parse_filters(
        {"service": " ", "level": "warn", "q": "", "attr.a.b": "", "attr.__proto__": "x", "x": ["y"]}
    ) == LogFilter(" ", "warn", "", {"a.b": "", "__proto__": "x"})
    assert parse_list_request({}).limit == 100
    assert parse_list_request({"limit": "0001000"}).limit == 1000
    assert parse_list_request({"since": "2026-07-20", "until": "2026-07-20"}).span == TimeRange(
        1784505600000, 1784505600000
    )
    assert parse_aggregate_request(GOOD_COUNT).group_by is None


@pytest.mark.parametrize(
    "term, pattern",
    [
        ("plain", "plain"),
        ("100%", "100\\%"),
        ("user_id", "user\\_id"),
        ("a\\b", "a\\\\b"),
        ("\\%_", "\\\\\\%\\_"),
        ("", ""),
    ],
)
def test_escape_like(term, pattern):
    assert escape_like(term) == pattern


MESSAGES = ["user_id", "userXid", "100% sure", "1000 sure", "C:\\temp", "c:/temp", "ERROR Code", "a\nb", ""]


@pytest.mark.parametrize(
    "q, found",
    [
        ("user_id", ["user_id"]),
        ("USER", ["user_id", "userXid"]),
        ("0%", ["100% sure"]),
        ("%", ["100% sure"]),
        (":\\t", ["C:\\temp"]),
        ("r c", ["ERROR Code"]),
        ("A\nB", ["a\nb"]),
        ("", MESSAGES),
        ("nowhere", []),
    ],
)
def test_q(spark, q, found):
    frame = spark.createDataFrame([(m,) for m in MESSAGES], "message string")
    rows = frame.where(filter_condition(LogFilter(q=q))).collect()
    assert [row["message"] for row in rows] == found


def test_all_filters_must_hold(spark):
    rows = [
        ("a", "info", "hello", '{"k":1}'),
        ("a", "info", "hello", '{"k":2}'),
        ("a", "info", "bye", '{"k":1}'),
        ("a", "warn", "hello", '{"k":1}'),
        ("A", "info", "hello", '{"k":1}'),
        ("a", "info", "hello", None),
    ]
    frame = spark.createDataFrame(rows, "service string, level string, message string, json string")
    frame = frame.withColumn("attributes", F.parse_json("json"))
    wanted = LogFilter("a", "info", "HELLO", {"k": "1"})
    assert [tuple(r) for r in frame.where(filter_condition(wanted)).drop("attributes").collect()] == rows[:1]
    assert frame.where(filter_condition(LogFilter())).count() == len(rows)


def test_bounds_and_days(spark):
    frame = spark.sql(
        """SELECT timestamp, coalesce(day, left(timestamp, 10)) AS log_day FROM VALUES
        (TIMESTAMP '2026-07-19 23:59:59.999', NULL), (TIMESTAMP '2026-07-20 00:00:00', NULL),
        (TIMESTAMP '2026-07-20 12:00:00', 'default'), (TIMESTAMP '2026-07-21 00:00:00', NULL)
        AS t(timestamp, day)"""
    )
    span = filters.parse_time_range(GOOD_RANGE)
    inside = frame.where(filters.time_condition(span)).collect()
    assert [str(r.timestamp) for r in inside] == ["2026-07-20 00:00:00", "2026-07-20 12:00:00"]
    days = frame.where(filters.day_condition(span.since, span.until)).collect()
    assert [r.log_day for r in days] == ["2026-07-20", "default", "2026-07-21"]
    assert frame.where(filters.day_condition(None, None)).count() == 4
