import json

import pytest
from pyspark.sql import functions as F

from conftest import batches, body, entry
from logloom import schema as S
from logloom.operators import validate
from logloom.plans.ingest import check_batches, summarize_batches
from logloom.sources import envelopes

FLAT = S.ATTRIBUTES_NOT_FLAT

# (entry, reason it is refused for; None if it is accepted)
ENTRIES = [
    (entry(), None),
    ("text", S.NOT_AN_OBJECT),
    (5, S.NOT_AN_OBJECT),
    (None, S.NOT_AN_OBJECT),
    ([entry()], S.NOT_AN_OBJECT),
    (json.dumps(entry()), S.NOT_AN_OBJECT),
    ({}, S.TIMESTAMP_MISSING),
    (entry(timestamp=...), S.TIMESTAMP_MISSING),
    (entry(timestamp=None), S.TIMESTAMP_MISSING),
    (entry(timestamp=1784548800000), S.TIMESTAMP_NOT_STRING),
    (entry(timestamp={"a": 1}), S.TIMESTAMP_NOT_STRING),
    (entry(timestamp="yesterday-ish"), "invalid timestamp: 'yesterday-ish'"),
    (entry(timestamp=""), "invalid timestamp: ''"),
    (entry(timestamp="2026-07-20T12:05:00.000Z"), None),
    (entry(timestamp="2026-07-20T12:05:00.001Z"), S.TIMESTAMP_IN_FUTURE),
    (entry(timestamp="1999-01-01T00:00:00Z"), None),
    (entry(timestamp="2026-07-20"), None),
    (entry(level=...), S.LEVEL_MISSING),
    (entry(level=None), S.LEVEL_MISSING),
    (entry(level="critical"), "invalid level: 'critical'"),
    (entry(level="INFO"), "invalid level: 'INFO'"),
    (entry(level=3), "invalid level: '3'"),
    (entry(level=1e21), "invalid level: '1e+21'"),
    (entry(level=True), "invalid level: 'true'"),
    (entry(level={"a": 1}), "invalid level: '[object Object]'"),
    (entry(level=["info", ["x", None]]), "invalid level: 'info,x,'"),
    (entry(level=["info"]), "invalid level: 'info'"),
    (entry(service=...), S.SERVICE_BLANK),
    (entry(service=""), S.SERVICE_BLANK),
    (entry(service=" \t\n"), S.SERVICE_BLANK),
    (entry(service=7), S.SERVICE_BLANK),
    (entry(service=" padded "), None),
    (entry(message=None), S.MESSAGE_BLANK),
    (entry(message="\u00a0\u2003\ufeff\u2028\u3000"), S.MESSAGE_BLANK),
    (entry(message="\u200b"), None),
    (entry(message=["x"]), S.MESSAGE_BLANK),
    (entry(attributes=...), None),
    (entry(attributes=None), None),
    (entry(attributes={}), None),
    (entry(attributes=[]), FLAT),
    (entry(attributes="x"), FLAT),
    (entry(attributes={"a": None}), FLAT),
    (entry(attributes={"a": {"b": 1}}), FLAT),
    (entry(attributes={"a": 1, "b": [1]}), FLAT),
    (entry(attributes={"OBJECT<x>": "OBJECT", "a;b": 2.5}), None),
    (entry(attributes={"a": 1e21, "b": 12345678901234567890}), None),
    (entry(timestamp=5, level=None, service="", message=""), S.TIMESTAMP_NOT_STRING),
    (entry(level="x", service="", message=""), "invalid level: 'x'"),
    (entry(service="", message=""), S.SERVICE_BLANK),
    (entry(message="", attributes=[]), S.MESSAGE_BLANK),
]


@pytest.fixture(scope="module")
def checked_rows(spark):
    moment = F.lit("2026-07-20T12:00:00Z").cast("timestamp")
    checked = check_batches(batches(spark, body(*[raw for raw, _ in ENTRIES])), moment)
    rows = checked.withColumn("attributes", F.to_json("attributes")).collect()
    return {row["index"]: row for row in rows}


@pytest.mark.parametrize("number", range(len(ENTRIES)))
def test_reason(checked_rows, number):
    assert checked_rows[number]["reason"] == ENTRIES[number][1]


def test_accepted_entry_is_normalised(spark, now):
    one = entry(timestamp="2026-07-20T13:00:00.123999+02:00", service=" padded ")
    row = validate.accepted(check_batches(batches(spark, body(one)), now)).select(
        F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"),
        "service",
        F.to_json("attributes").alias("attributes"),
    ).first()
    assert row["ts"] == "2026-07-20 11:00:00.123000"
    assert row["service"] == " padded "
    assert json.loads(row["attributes"]) == {"user_id": "42", "paid": True, "retries": 3}


@pytest.mark.parametrize(
    "text, stored",
    [
        ("{}", {}),
        ("null", {}),
        ('{"a": 9007199254740993, "b": "9007199254740993"}',
         {"a": 9007199254740992, "b": "9007199254740993"}),
        ('{"a": 1e400, "b": -1e400}', {"a": None, "b": None}),
        ('{"a": 0.12345678901234567890, "b": 3.0}', {"a": 0.12345678901234568, "b": 3}),
        ('{"a": 1, "a": 2}', {"a": 2}),
        ('{"__proto__": "x", "a.b": true}', {"__proto__": "x", "a.b": True}),
    ],
)
def test_stored_attributes(spark, now, text, stored):
    raw = body(entry(attributes=...)).replace("}]}", f', "attributes": {text}}}]}}')
    row = validate.accepted(check_batches(batches(spark, raw), now)).select(
        F.to_json("attributes").alias("attributes")
    ).first()
    assert json.loads(row["attributes"]) == stored


GOOD = body(entry())
BODIES = [
    (GOOD, None, "ok", 1, []),
    (body(), None, "rejected", 0, []),
    (body(5), None, "rejected", 0, [(0, S.NOT_AN_OBJECT)]),
    (body(entry(), 5, entry(), entry(level=None)), None, "ok", 2,
     [(1, S.NOT_AN_OBJECT), (3, S.LEVEL_MISSING)]),
    (GOOD[:-1], S.MALFORMED_BODY, "error", 0, []),
    (GOOD + " x", S.MALFORMED_BODY, "error", 0, []),
    (GOOD + GOOD, S.MALFORMED_BODY, "error", 0, []),
    (GOOD + "," + GOOD, S.MALFORMED_BODY, "error", 0, []),
    ("{'logs':[]}", S.MALFORMED_BODY, "error", 0, []),
    ('{"logs":[NaN]}', S.MALFORMED_BODY, "error", 0, []),
    ('{"logs":[1,]}', S.MALFORMED_BODY, "error", 0, []),
    ('{"logs":[1],"x":tru}', S.MALFORMED_BODY, "error", 0, []),
    ('{"logs":[1],"x":NaN}', S.MALFORMED_BODY, "error", 0, []),
    ('"logs"', S.MALFORMED_BODY, "error", 0, []),
    ("12", S.MALFORMED_BODY, "error", 0, []),
    ("null", S.MALFORMED_BODY, "error", 0, []),
    ("  ", S.MALFORMED_BODY, "error", 0, []),
    ("", S.BAD_ENVELOPE, "error", 0, []),
    ("{}", S.BAD_ENVELOPE, "error", 0, []),
    ("[]", S.BAD_ENVELOPE, "error", 0, []),
    (f"[{GOOD}]", S.BAD_ENVELOPE, "error", 0, []),
    ('{"logs":null}', S.BAD_ENVELOPE, "error", 0, []),
    ('{"logs":"x"}', S.BAD_ENVELOPE, "error", 0, []),
    ('{"logs":{}}', S.BAD_ENVELOPE, "error", 0, []),
    ('{"Logs":[]}', S.BAD_ENVELOPE, "error", 0, []),
    ('{"logs":[5],"logs":[]}', None, "rejected", 0, []),
    ('{"logs":[5],"logs":null}', S.BAD_ENVELOPE, "error", 0, []),
    (" \n" + GOOD + "\n", None, "ok", 1, []),
    ('{"more":{"logs":[1]},' + GOOD[1:], None, "ok", 1, []),
    (GOOD + " " * (S.MAX_BODY_BYTES - len(GOOD)), None, "ok", 1, []),
    (GOOD + " " * (S.MAX_BODY_BYTES - len(GOOD) + 1), S.BODY_TOO_LARGE, "error", 0, []),
]


@pytest.fixture(scope="module")
def summaries(spark):
    moment = F.lit("2026-07-20T12:00:00Z").cast("timestamp")
    frame = summarize_batches(batches(spark, *[case[0] for case in BODIES]), moment)
    return {row["batch_id"]: row for row in frame.collect()}


@pytest.mark.parametrize("number", range(len(BODIES)))
def test_body(summaries, number):
    _, error, status, accepted, rejected = BODIES[number]
    row = summaries[f"b{number}"]
    assert (row["error"], row["status"], row["accepted"]) == (error, status, accepted)
    assert [tuple(r) for r in row["rejected"]] == rejected


def test_files_are_batches_and_large_ones_stay_unread(spark, tmp_path, now):
    (tmp_path / "good.json").write_text(GOOD)
    (tmp_path / "blank.json").write_text(" ")
    (tmp_path / "bytes.json").write_bytes(GOOD.encode().replace(b"order", b"or\xffder"))
    (tmp_path / "large.json").write_text(GOOD + " " * S.MAX_BODY_BYTES)
    files = envelopes.read_files(spark, str(tmp_path))
    found = {
        row["batch_id"].rsplit("/", 1)[1]: (row["error"], row["accepted"])
        for row in summarize_batches(files, now).collect()
    }
    assert found == {
        "good.json": (None, 1),
        "bytes.json": (None, 1),
        "blank.json": (S.MALFORMED_BODY, 0),
        "large.json": (S.BODY_TOO_LARGE, 0),
    }
    plan = files._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(length,10485760)" in plan
    assert "GreaterThan(length,10485760)" in plan


def test_lines_carry_their_batch_id(spark, tmp_path, now):
    tabbed = body(entry(message="a\tb")).replace("\\t", "\\t").replace(", ", ",\t")
    (tmp_path / "lines.txt").write_text(f"first\t{GOOD}\nsecond\t{tabbed}\nthird\t\n")
    rows = summarize_batches(envelopes.read_lines(spark, str(tmp_path)), now).collect()
    assert {row["batch_id"]: (row["error"], row["accepted"]) for row in rows} == {
        "first": (None, 1),
        "second": (None, 1),
        "third": (S.BAD_ENVELOPE, 0),
    }


def test_lines_without_a_tab_are_malformed(spark, tmp_path, now):
    (tmp_path / "lines.txt").write_text(f"{GOOD}\nplain\nfirst\t{GOOD}\n")
    rows = summarize_batches(envelopes.read_lines(spark, str(tmp_path)), now).collect()
    found = sorted((row["batch_id"] or "", row["error"] or "", row["accepted"]) for row in rows)
    assert found == [("", S.MALFORMED_BODY, 0)] * 2 + [("first", "", 1)]


def test_bodies_that_share_an_id_are_judged_each_by_itself(spark, now):
    bad = body(entry(level="loud"))
    frame = spark.createDataFrame(
        [("dup", GOOD), ("dup", GOOD), ("dup", bad), ("dup", "{")], "batch_id string, body string"
    )
    rows = summarize_batches(envelopes.from_column(frame, "batch_id", "body"), now).collect()
    found = sorted((row["status"], row["accepted"], len(row["rejected"])) for row in rows)
    assert found == [("error", 0, 0), ("ok", 1, 0), ("ok", 1, 0), ("rejected", 0, 1)]


def test_one_entry_does_not_carry_the_keys_of_its_batch(spark):
    """Entries with many different keys stay small after they are taken apart."""
    many = [entry(attributes={f"key_{n}": n}) for n in range(3000)]
    exploded = envelopes.explode_entries(envelopes.parse(batches(spark, body(*many))))
    plan = exploded._jdf.queryExecution().optimizedPlan().toString()
    assert "variant_explode" not in plan and "logs,ArrayType(VariantType" in plan
    assert exploded.count() == 3000
