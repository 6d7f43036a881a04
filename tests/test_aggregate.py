import pytest
from pyspark.sql import functions as F

from logloom.functions.timestamps import parse_instant
from logloom.operators import aggregate

SINCE, UNTIL = "2026-07-20T00:00:30Z", "2026-07-20T06:00:30Z"


@pytest.fixture(scope="module")
def logs(spark):
    start = parse_instant("2026-07-20T00:00:00Z")
    return spark.range(5000).select(
        F.timestamp_millis(F.lit(start) + F.col("id") * 7919 % 25200000).alias("timestamp"),
        F.element_at(F.array(*map(F.lit, ["debug", "info", "warn", "error"])), (F.col("id") % 4 + 1).cast("int")).alias("level"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise("cold").alias("service"),
        F.concat(F.lit("message "), F.col("id") % 10).alias("message"),
        F.parse_json(F.concat(F.lit('{"n":'), F.col("id") % 5, F.lit("}"))).alias("attributes"),
    )


def expected(logs, step_ms, key, keep):
    since, until = parse_instant(SINCE), parse_instant(UNTIL)
    counts = {}
    for row in logs.select(F.unix_millis("timestamp").alias("ms"), "level", "service", "message").collect():
        if since <= row.ms < until and keep(row):
            at = (since + (row.ms - since) // step_ms * step_ms, key(row))
            counts[at] = counts.get(at, 0) + 1
    return counts


@pytest.mark.parametrize("bucket, seconds", [("1m", 60), ("5m", 300), ("1h", 3600), ("1d", 86400)])
@pytest.mark.parametrize("group", [None, "service", "level"])
def test_counts(logs, bucket, seconds, group):
    params = {"since": SINCE, "until": UNTIL, "bucket": bucket, "level": "warn"}
    if group:
        params["group_by"] = group
    rows = aggregate.aggregate_logs(logs, params).collect()
    found = {(int(r.start.timestamp() * 1000), r.group): r["count"] for r in rows}
    assert found == expected(
        logs, seconds * 1000, lambda r: r[group] if group else None, lambda r: r.level == "warn"
    )
    assert [r.start for r in rows] == sorted(r.start for r in rows)


def test_filters_apply_before_counting(logs):
    params = {"since": SINCE, "until": UNTIL, "bucket": "1d", "q": "MESSAGE 3", "attr.n": "3"}
    total = logs.where("message = 'message 3'").where(
        (F.unix_millis("timestamp") >= parse_instant(SINCE)) & (F.unix_millis("timestamp") < parse_instant(UNTIL))
    ).count()
    (row,) = aggregate.render(aggregate.aggregate_logs(logs, params)).collect()
    assert tuple(row) == ("2026-07-20T00:00:30.000Z", None, total)


def test_no_rows_no_buckets(logs):
    empty = {"since": SINCE, "until": SINCE, "bucket": "1m"}
    assert aggregate.aggregate_logs(logs, empty).collect() == []


def test_counting_is_partial_then_final(logs):
    params = {"since": SINCE, "until": UNTIL, "bucket": "1m", "group_by": "service"}
    plan = aggregate.aggregate_logs(logs, params)._jdf.queryExecution().executedPlan().toString()
    assert "partial_count" in plan and plan.count("hashpartitioning") == 1


@pytest.mark.parametrize(
    "change, answer",
    [
        ({}, False),
        ({"since": "2026-07-20T00:00:00Z"}, False),
        ({"since": "2026-07-20T00:00:00Z", "until": "2026-07-20T06:00:00Z"}, True),
        ({"since": "2026-07-20T00:00Z", "until": "2026-07-20T06:00Z", "level": "info", "service": "a"}, True),
        ({"since": "2026-07-20T00:00Z", "until": "2026-07-20T06:00Z", "q": ""}, False),
        ({"since": "2026-07-20T00:00Z", "until": "2026-07-20T06:00Z", "attr.k": "1"}, False),
    ],
)
def test_when_minute_counts_suffice(change, answer):
    params = {"since": SINCE, "until": UNTIL, "bucket": "5m", **change}
    request = aggregate.parse_aggregate_request(params)
    assert aggregate.answers_from_minutes(request) is answer
