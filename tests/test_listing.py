import base64
import json

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from logloom import schema as S
from logloom.functions.timestamps import parse_instant
from logloom.operators import listing
from logloom.operators.listing import Position, decode_cursor, encode_cursor


def token(value):
    return base64.urlsafe_b64encode(json.dumps(value).encode()).decode().rstrip("=")


GOOD = {"timestamp": "2026-07-20T14:32:00.123Z", "id": "42"}


@given(st.integers(-62135596800000, 253402300799999), st.integers(0, 2**63 - 1))
def test_round_trip(ms, row_id):
    text = encode_cursor(Position(ms, row_id))
    assert decode_cursor(text) == Position(ms, row_id)
    assert set(text) <= set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_")


def test_token_is_the_published_form():
    raw = base64.urlsafe_b64decode(encode_cursor(Position(parse_instant(GOOD["timestamp"]), 42)) + "==")
    assert raw == b'{"timestamp":"2026-07-20T14:32:00.123Z","id":"42"}'


@pytest.mark.parametrize("row_id", ["0", "9007199254740993", "9223372036854775807"])
def test_ids_are_exact(row_id):
    assert decode_cursor(token({**GOOD, "id": row_id})).id == int(row_id)


@pytest.mark.parametrize(
    "text",
    [
        "",
        "garbage",
        "!!!",
        base64.urlsafe_b64encode(b"not json").decode(),
        base64.urlsafe_b64encode(b"\xff\xfe").decode(),
        token([]),
        token([GOOD]),
        token(None),
        token("text"),
        token({"id": "42"}),
        token({"timestamp": GOOD["timestamp"]}),
        token({**GOOD, "timestamp": 5}),
        token({**GOOD, "timestamp": "yesterday"}),
        token({**GOOD, "id": 42}),
        token({**GOOD, "id": "1.5"}),
        token({**GOOD, "id": "-1"}),
        token({**GOOD, "id": "1e10"}),
        token({**GOOD, "id": ""}),
        token({**GOOD, "id": "x"}),
        token({**GOOD, "id": "9223372036854775808"}),
        token({**GOOD, "id": "9" * 5000}),
    ],
)
def test_malformed_tokens(text):
    assert decode_cursor(text) is None


def test_tokens_in_the_other_alphabet_or_padded():
    text = encode_cursor(Position(0, 1))
    assert decode_cursor(text + "==") == Position(0, 1)
    odd = base64.b64encode(json.dumps({**GOOD, "x": "???>>>"}).encode()).decode()
    assert decode_cursor(odd).id == 42


@pytest.fixture(scope="module")
def logs(spark):
    """Two hundred rows, nine to an instant, so pages end between equal instants."""
    # The instants cross hours, so that counting per minute has something to decide.
    rows = spark.range(200).select(
        (F.col("id") * 37 % 200 + 2**53).alias("id"),
        F.timestamp_millis((F.col("id") / 9).cast("long") * 600000 + parse_instant(GOOD["timestamp"])).alias("timestamp"),
        F.when(F.col("id") % 3 == 0, "warn").otherwise("info").alias("level"),
        F.lit("api").alias("service"),
        F.concat(F.lit("row "), "id").alias("message"),
        F.when(F.col("id") % 2 == 0, F.parse_json(F.lit('{"n":1,"t":"x","b":false}'))).alias("attributes"),
    )
    return rows.repartition(7).cache()


@pytest.mark.parametrize("limit", ["23", "200", "201"])
@pytest.mark.parametrize(
    "params", [{}, {"level": "warn"}, {"since": "2026-07-20T15:10:00Z", "until": "2026-07-20T18:00:00Z"}]
)
def test_pages_have_no_gaps_and_no_repeats(logs, limit, params):
    pages = list(listing.walk(lambda p: listing.list_logs(logs, p), {**params, "limit": limit}))
    walked = [record["id"] for page in pages for record in page.logs]
    whole = [row["id"] for row in listing.export(logs, params).collect()]
    assert walked == whole
    assert all(len(page.logs) == int(limit) for page in pages[:-1])


def test_look_ahead_row_is_hidden(logs):
    page = listing.list_logs(logs, {"limit": "199"})
    assert len(page.logs) == 199 and page.next_cursor is not None
    assert listing.list_logs(logs, {"limit": "200"}).next_cursor is None


def test_record(logs):
    first = listing.list_logs(logs, {"limit": "1"}).logs[0]
    assert list(first) == ["id", "timestamp", "level", "service", "message", "attributes"]
    assert first["id"] == str(2**53 + 199 * 37 % 200)
    assert first["timestamp"] == "2026-07-20T18:12:00.123Z"
    assert first["attributes"] == {}
    even = listing.list_logs(logs, {"q": "row 198"}).logs[0]
    assert even["attributes"] == {"n": 1, "t": "x", "b": False}


def test_empty_page(logs):
    page = listing.list_logs(logs, {"service": "nobody"})
    assert page == listing.Page([], None)


def test_a_page_is_a_heap_per_task_not_a_sort(logs):
    request = listing.parse_list_request({"limit": "10", "cursor": token(GOOD)})
    plan = listing.top_rows(logs, request)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "Exchange" not in plan.split("InMemory")[0]


def test_no_bound_to_try_reads_nothing():
    def scan(span):
        raise AssertionError("nothing to read")

    request = listing.parse_list_request({"q": "absent"})
    assert listing.fetch_page(request, scan, []) == listing.Page([], None)


def test_a_range_is_read_once(spark):
    read = []

    def scan(span):
        read.append(span.since)
        return spark.createDataFrame([], S.LOGS)

    request = listing.parse_list_request({"since": "2026-07-20T00:00:00Z"})
    since = request.span.since
    assert listing.fetch_page(request, scan, [since + 1, since, since - 1, None]).logs == []
    assert read == [since + 1, since]
