"""The given tables seen as log data: as stored rows, and as batches on their way in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.functions.timestamps import instant
from logloom.operators.filters import TimeRange, all_of
from logloom.session import prepare

ENTRIES_PER_BATCH = 50

_SERVICE = "concat('svc-', CAST(user_id % 5 AS STRING))"
_LEVEL = """CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'warn'
            WHEN 'purchase' THEN 'info' ELSE 'debug' END"""
_MESSAGE = "concat(event_type, ' by user_', CAST(user_id AS STRING))"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/events.parquet")


def _parsed_once(json: Column) -> Column:
    """A variant from JSON text, parsed once per row.

    As a plain column, every mention of it in a filter would parse the text again.
    """
    return F.explode(F.array(F.parse_json(json)))


def events_as_logs(
    spark: SparkSession,
    sf_dir: str,
    span: TimeRange = TimeRange(),
    attributes: bool = True,
    json: bool = False,
) -> DataFrame:
    """Events as log rows, cut to milliseconds.

    Bounds of whole milliseconds mean the same before and after the cut, so they are
    put on the stored column, where the scan can skip row groups by them. With
    ``json``, the unparsed attributes stay as ``props``.
    """
    stored = F.col("ts").cast("timestamp")
    bounds = []
    if span.since is not None:
        bounds.append(F.col("ts") >= instant(span.since).cast("timestamp_ntz"))
    if span.until is not None:
        bounds.append(F.col("ts") < instant(span.until).cast("timestamp_ntz"))
    columns = [
        F.col("event_id").alias("id"),
        F.timestamp_millis(F.unix_millis(stored)).alias("timestamp"),
        F.expr(_LEVEL).alias("level"),
        F.expr(_SERVICE).alias("service"),
        F.expr(_MESSAGE).alias("message"),
    ]
    if attributes:
        columns.append(_parsed_once(F.col("props")).alias("attributes"))
    if json:
        columns.append(F.col("props"))
    return events(spark, sf_dir).where(all_of(bounds)).select(columns)


def events_with_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows with attributes of every kind a value may have."""
    fields = F.struct(
        F.get_json_object("props", "$.k").cast("int").alias("k"),
        F.col("value").alias("value"),
        (F.col("user_id") % 2 == 0).alias("vip"),
        F.col("event_type").alias("kind"),
        F.concat(F.lit("user_"), "user_id").alias("user.name"),
        F.col("user_id").cast("string").alias("user's id"),
    )
    return events(spark, sf_dir).select(
        F.col("event_id").alias("id"),
        F.expr(_SERVICE).alias("service"),
        F.expr(_MESSAGE).alias("message"),
        _parsed_once(F.to_json(fields)).alias("attributes"),
    )


def documents_as_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as log rows: long messages in several languages."""
    return prepare(spark).read.parquet(f"{sf_dir}/documents.parquet").select(
        F.col("doc_id").alias("id"),
        F.col("source").alias("service"),
        F.col("text").alias("message"),
    )


# --- batches -------------------------------------------------------------------

# One fault per entry, by position in a cycle of twenty; the rest are good entries.
# The clock of these batches stands still at NOW.
NOW = "2024-02-15T00:00:00.000Z"
_TIMESTAMP = "date_format(CAST(ts AS TIMESTAMP), \"yyyy-MM-dd'T'HH:mm:ss.SSS'Z'\")"
_FAULTS = {
    0: {"timestamp": None},
    1: {"timestamp": "1704067200000"},
    2: {"timestamp": '"not-a-timestamp"'},
    3: {"timestamp": '"2024-02-15T00:06:00.000Z"'},
    4: {"level": "null"},
    5: {"level": '"critical"'},
    6: {"service": '"   "'},
    7: {"service": "7"},
    8: {"message": '"\u00a0"'},
    9: {"attributes": '{"n":{"a":1}}'},
    10: {"attributes": '{"a":null}'},
    12: {"attributes": None},
    13: {"attributes": "null"},
    14: {"timestamp": '"2024-02-15T00:05:00.000Z"'},
    15: {"timestamp": '"2000-01-01T00:00:00.000Z"'},
}


def _entry_text(faults: bool) -> str:
    good = {
        "timestamp": f"concat('\"', {_TIMESTAMP}, '\"')",
        "level": f"concat('\"', {_LEVEL}, '\"')",
        "service": f"concat('\"', {_SERVICE}, '\"')",
        "message": f"concat('\"', {_MESSAGE}, '\"')",
        "attributes": "props",
    }
    fields = []
    for name, value in good.items():
        whole = f"""concat('"{name}":', {value})"""
        cases = [
            f"WHEN {n} THEN " + ("NULL" if fault[name] is None else f"""'"{name}":{fault[name]}'""")
            for n, fault in _FAULTS.items()
            if faults and name in fault
        ]
        fields.append(
            f"CASE event_id % 20 {' '.join(cases)} ELSE {whole} END" if cases else whole
        )
    entry = f"concat('{{', concat_ws(',', {', '.join(fields)}), '}}')"
    if faults:
        entry = f"""CASE event_id % 20 WHEN 11 THEN '"an entry"' ELSE {entry} END"""
    return entry


def event_batches(spark: SparkSession, sf_dir: str, faults: bool = True) -> DataFrame:
    """``batch_id, body``: events packed fifty to a batch, in their order."""
    packed = (
        events(spark, sf_dir)
        .select(
            F.expr(f"event_id DIV {ENTRIES_PER_BATCH}").alias("batch"),
            F.struct("event_id", F.expr(_entry_text(faults)).alias("entry")).alias("item"),
        )
        .groupBy("batch")
        .agg(F.array_sort(F.collect_list("item")).alias("items"))
    )
    entries = F.array_join(F.col("items.entry"), ",")
    return packed.select(
        F.col("batch").cast("string").alias("batch_id"),
        F.concat(F.lit('{"logs":['), entries, F.lit("]}")).alias("body"),
    )


DOCUMENTS_PER_BATCH = 20


def document_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``batch_id, body``: whole documents as messages, twenty to a batch."""
    entry = F.struct(
        F.lit("2024-02-01T00:00:00.000Z").alias("timestamp"),
        F.lit("info").alias("level"),
        F.col("source").alias("service"),
        F.col("text").alias("message"),
        F.struct("doc_id", "lang", "n_chars").alias("attributes"),
    )
    packed = (
        prepare(spark)
        .read.parquet(f"{sf_dir}/documents.parquet")
        .groupBy(F.expr(f"doc_id DIV {DOCUMENTS_PER_BATCH}").alias("batch"))
        .agg(F.array_sort(F.collect_list(F.struct("doc_id", entry.alias("entry")))).alias("items"))
    )
    return packed.select(
        F.col("batch").cast("string").alias("batch_id"),
        F.to_json(F.struct(F.col("items.entry").alias("logs"))).alias("body"),
    )


def broken_event_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same batches with every way a whole body can be wrong."""
    number = F.col("batch_id").cast("long") % 10
    empty = F.lit('{"logs":[]}')
    filler = F.repeat(F.lit(" "), 10 * 1024 * 1024)
    body = (
        F.when(number == 0, F.expr("left(body, length(body) - 1)"))
        .when(number == 1, F.concat("body", F.lit(" x")))
        .when(number == 2, F.concat("body", F.lit(","), "body"))
        .when(number == 3, F.regexp_replace("body", '^\\{"logs"', '{"entries"'))
        .when(number == 4, F.concat(F.lit('{"logs":{"a":'), "body", F.lit("}}")))
        .when(number == 5, F.concat(F.lit("["), "body", F.lit("]")))
        .when(number == 6, empty)
        .when(F.col("batch_id") == "7", F.concat("body", filler))
        .when(number == 7, F.lit(""))
        .when(number == 8, F.concat(F.lit('{"logs":[1],'), F.expr("substring(body, 2)")))
        .otherwise(F.col("body"))
    )
    return event_batches(spark, sf_dir, faults=False).withColumn("body", body)
