"""Queries over the given tables, each with SQL that gives the same rows."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.functions.timestamps import iso_millis, parse_instant
from logloom.operators import aggregate, listing, retention, validate
from logloom.operators.filters import LogFilter, TimeRange, filter_condition
from logloom.operators.ordering import numbered
from logloom.plans import views
from logloom.plans.ingest import check_batches, ingest
from logloom.session import scratch_path, small_tasks
from logloom.sources import envelopes
from logloom.sources.table import Commit, LogTable, route_day
from logloom.streaming.ingest import start_ingest

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# --- the log view of the events, in SQL ------------------------------------------

_LOGS = """
logs AS (
  SELECT event_id AS id,
         date_trunc('millisecond', ts) AS ts,
         strftime(date_trunc('millisecond', ts), '%Y-%m-%dT%H:%M:%S.%gZ') AS timestamp,
         CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'warn'
              WHEN 'purchase' THEN 'info' ELSE 'debug' END AS level,
         concat('svc-', CAST(user_id % 5 AS VARCHAR)) AS service,
         concat(event_type, ' by user_', CAST(user_id AS VARCHAR)) AS message,
         props, value, user_id, event_type
  FROM events)
"""
_RECORD = """CAST(id AS VARCHAR) AS id, timestamp, level, service, message,
       concat('{"k":', json_extract_string(props, '$.k'), '}') AS attributes"""


def _register(name: str, query: Query, oracle: str | None = None) -> None:
    QUERIES[name] = query
    if oracle is not None:
        ORACLES[name] = oracle


def _as_text(records: DataFrame) -> DataFrame:
    return records.withColumn("attributes", F.to_json("attributes"))


# --- bucket counts ---------------------------------------------------------------


def _register_counts(name: str, where: str = "TRUE", **params: str) -> None:
    request = aggregate.parse_aggregate_request(params)

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        by_attribute = bool(request.filters.attributes)
        logs = views.events_as_logs(spark, sf_dir, request.span, by_attribute)
        return aggregate.render(aggregate.count_rows(logs, request))

    since, until = params["since"].rstrip("Z"), params["until"].rstrip("Z")
    group = f"CAST({params.get('group_by', 'NULL')} AS VARCHAR)"
    bucket = f"time_bucket(INTERVAL {request.width_seconds} SECONDS, ts, TIMESTAMP '{since}')"
    _register(
        name,
        query,
        f"""WITH {_LOGS}
SELECT strftime({bucket}, '%Y-%m-%dT%H:%M:%S.%gZ') AS start,
       {group} AS "group", count(*) AS count
FROM logs
WHERE ts >= TIMESTAMP '{since}' AND ts < TIMESTAMP '{until}' AND ({where})
GROUP BY 1, 2 ORDER BY 1, 2""",
    )


_MONTH = {"since": "2024-01-01T00:00:00Z", "until": "2024-02-01T00:00:00Z"}
_register_counts("agg_1h_service", bucket="1h", group_by="service", **_MONTH)
_register_counts("agg_1m_all", bucket="1m", **_MONTH)
_register_counts("agg_5m_level", bucket="5m", group_by="level", **_MONTH)
_register_counts("agg_1d_service", bucket="1d", group_by="service", **_MONTH)
_register_counts(
    "agg_odd_anchor",
    bucket="1h",
    since="2024-01-03T10:17:23.456Z",
    until="2024-01-20T00:00:00.001Z",
)
_register_counts(
    "agg_filtered",
    where="level = 'error' AND contains(message, 'user_1') "
    "AND json_extract_string(props, '$.k') = '69'",
    bucket="1d",
    group_by="service",
    level="error",
    q="USER_1",
    **{"attr.k": "69"},
    **_MONTH,
)


# --- listing ---------------------------------------------------------------------


Logs = Callable[[SparkSession, str, TimeRange], DataFrame]


def _events(spark: SparkSession, sf_dir: str, span: TimeRange) -> DataFrame:
    return views.events_as_logs(spark, sf_dir, span, attributes=False, json=True)


def _hourly(spark: SparkSession, sf_dir: str, span: TimeRange) -> DataFrame:
    """Rows that tie on the timestamp, so that the id decides the order."""
    until = None if span.until is None else span.until + 3600 * 1000
    rows = _events(spark, sf_dir, TimeRange(span.since, until))
    return rows.withColumn("timestamp", F.date_trunc("hour", "timestamp"))


def _page(number: int, logs: Logs, **params: str) -> Query:
    """A page of the listing; only its rows get their attributes parsed."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        def without_attributes(span: TimeRange) -> DataFrame:
            rows = logs(spark, sf_dir, span)
            return rows.withColumn("attributes", F.lit(None).cast("variant"))

        def begin(wanted: dict) -> listing.ListRequest:
            request = listing.parse_list_request(wanted)
            span = TimeRange(request.span.since, listing.request_end(request))
            return listing.narrowed(without_attributes(span), request)

        wanted, more = dict(params), F.lit(True)
        for _ in range(number):
            cursor = listing.fetch_page(begin(wanted), without_attributes).next_cursor
            if cursor is None:
                more = F.lit(False)
                break
            wanted["cursor"] = cursor
        request = begin(wanted)
        span = TimeRange(request.span.since, listing.request_end(request))
        rows = logs(spark, sf_dir, span).where(more)
        page = listing.top_rows(rows, request, look_ahead=0)
        return _as_text(listing.render(page.withColumn("attributes", F.parse_json("props"))))

    return query


def _page_oracle(number: int, size: int, where: str = "TRUE", ts: str = "ts") -> str:
    record = _RECORD.replace(
        "timestamp,", f"strftime({ts}, '%Y-%m-%dT%H:%M:%S.%gZ') AS timestamp,"
    )
    return f"""WITH {_LOGS}
SELECT {record} FROM logs WHERE {where}
ORDER BY {ts} DESC, logs.id DESC LIMIT {size} OFFSET {number * size}"""


_register("list_first_page", _page(0, _events), _page_oracle(0, 100))
_register("list_after_cursor", _page(1, _events), _page_oracle(1, 100))
_register(
    "list_ties_after_cursor",
    _page(2, _hourly, limit="250"),
    _page_oracle(2, 250, ts="date_trunc('hour', ts)"),
)
_register(
    "list_filtered",
    _page(1, _events, service="svc-1", level="debug", q="VIEW BY", limit="40"),
    _page_oracle(1, 40, "service = 'svc-1' AND level = 'debug' AND contains(message, 'view by')"),
)


def _register_matching(name: str, where: str, **params: str) -> None:
    """All matching records, in no order: a scan without a shuffle."""
    request = listing.parse_list_request(params)

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = views.events_as_logs(spark, sf_dir, request.span)
        return _as_text(listing.render(listing.matching(rows, request)))

    _register(name, query, f"WITH {_LOGS} SELECT {_RECORD} FROM logs WHERE {where}")


_register_matching("filter_service", "service = 'svc-3'", service="svc-3")
_register_matching("filter_level", "level = 'warn'", level="warn")
_register_matching(
    "filter_time_range",
    "ts >= TIMESTAMP '2024-01-09 22:00:00' AND ts < TIMESTAMP '2024-01-12 03:30:00.500'",
    since="2024-01-10T00:00:00+02:00",
    until="2024-01-12T03:30:00.500Z",
)
_register(
    "export_all",
    lambda spark, sf_dir: _as_text(listing.export(views.events_as_logs(spark, sf_dir), {})),
    f"WITH {_LOGS} SELECT {_RECORD} FROM logs",
)


def _numbered_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The listing's keys with their places, so that its order shows in the rows."""
    rows = listing.matching(_events(spark, sf_dir, TimeRange()), listing.ListRequest())
    placed, _ = numbered(rows.select("timestamp", "id"), *listing.newest_first(), name="position")
    return placed.select("position", iso_millis(F.col("timestamp")).alias("timestamp"), "id")


_register(
    "list_positions",
    _numbered_export,
    f"""WITH {_LOGS}
SELECT row_number() OVER (ORDER BY ts DESC, id DESC) AS position, timestamp, id FROM logs""",
)
_register(
    "list_page_keys",
    lambda spark, sf_dir: listing.page_keys(
        _hourly(spark, sf_dir, TimeRange()), {"limit": "40", "level": "debug"}
    ).withColumn("timestamp", iso_millis(F.col("timestamp"))),
    f"""WITH {_LOGS}, placed AS (
  SELECT id, strftime(date_trunc('hour', ts), '%Y-%m-%dT%H:%M:%S.%gZ') AS timestamp,
         row_number() OVER (ORDER BY date_trunc('hour', ts) DESC, id DESC) AS position,
         count(*) OVER () AS total
  FROM logs WHERE level = 'debug')
SELECT position // 40 AS page, timestamp, id,
       translate(to_base64(encode(concat('{{"timestamp":"', timestamp, '","id":"', id, '"}}'))),
                 '+/=', '-_') AS next_cursor
FROM placed WHERE position % 40 = 0 AND position < total""",
)


def _bucket_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bucket counts with the places the operator gives them: by start, then group."""
    request = aggregate.parse_aggregate_request({"bucket": "1d", "group_by": "service", **_MONTH})
    logs = views.events_as_logs(spark, sf_dir, request.span, attributes=False)
    counts = aggregate.count_rows(logs, request)
    placed, _ = numbered(
        counts.withColumn("task_row", F.monotonically_increasing_id()),
        F.col("task_row"),
        name="position",
    )
    return placed.select("position", iso_millis(F.col("start")).alias("start"), "group", "count")


_register(
    "agg_order",
    _bucket_order,
    f"""WITH counted AS ({ORACLES["agg_1d_service"]})
SELECT row_number() OVER (ORDER BY start, "group") AS position, start, "group", count FROM counted""",
)


# --- text and attribute filters ----------------------------------------------------


def _register_text(name: str, q: str, where: str) -> None:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        logs = views.documents_as_logs(spark, sf_dir)
        return logs.where(filter_condition(LogFilter(q=q))).select("id", "service")

    _register(
        name,
        query,
        f"SELECT doc_id AS id, source AS service FROM documents WHERE {where}",
    )


_register_text("filter_q", "LICENSE", "text ILIKE '%license%'")
_register_text("filter_q_literal_percent", "%", "contains(text, '%')")
_register_text("filter_q_empty", "", "text IS NOT NULL")


def _register_attributes(
    name: str,
    wanted: dict[str, str],
    where: str,
    view: Callable[[SparkSession, str], DataFrame] = views.events_with_attributes,
) -> None:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        logs = view(spark, sf_dir)
        return logs.where(filter_condition(LogFilter(attributes=wanted))).select(
            "id", "service", "message"
        )

    _register(name, query, f"WITH {_LOGS} SELECT id, service, message FROM logs WHERE {where}")


_register_attributes(
    "filter_attr_number",
    {"k": "69"},
    "json_extract_string(props, '$.k') = '69'",
    views.events_as_logs,
)
_register_attributes("filter_attr_decimal", {"value": "12.5"}, "value = 12.5")
_register_attributes("filter_attr_whole_decimal", {"value": "12"}, "value = 12")
_register_attributes("filter_attr_boolean", {"vip": "true"}, "user_id % 2 = 0")
_register_attributes("filter_attr_text", {"kind": "signup"}, "event_type = 'signup'")
_register_attributes(
    "filter_attr_odd_keys", {"user.name": "user_7", "user's id": "7"}, "user_id = 7"
)
_register_attributes(
    "filter_attr_multi",
    {"vip": "false", "kind": "click", "k": "3"},
    "user_id % 2 = 1 AND event_type = 'click' AND json_extract_string(props, '$.k') = '3'",
)


_register(
    "filter_q_literal_underscore",
    lambda spark, sf_dir: views.events_as_logs(spark, sf_dir, attributes=False)
    .where(filter_condition(LogFilter(q="R_1")))
    .select("id", "message"),
    f"WITH {_LOGS} SELECT id, message FROM logs WHERE contains(message, 'r_1')",
)




def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    message = F.concat(F.lit("C:\\logs\\"), "service", F.lit("\\100%_"), "level")
    return views.events_as_logs(spark, sf_dir, attributes=False).withColumn("message", message)


_register(
    "filter_q_all_specials",
    lambda spark, sf_dir: _paths(spark, sf_dir)
    .where(filter_condition(LogFilter(q="S\\SVC-2\\100%_W")))
    .select("id", "message"),
    f"""WITH {_LOGS}
SELECT id, concat('C:\\logs\\', service, '\\100%_', level) AS message FROM logs
WHERE service = 'svc-2' AND level = 'warn'""",
)


# --- validation --------------------------------------------------------------------

_FATE = """
fate AS (
  SELECT logs.*, CAST(id // 50 AS VARCHAR) AS batch_id, CAST(id % 50 AS INTEGER) AS index,
    CASE id % 20
      WHEN 0 THEN 'timestamp is required'
      WHEN 1 THEN 'timestamp must be a string'
      WHEN 2 THEN 'invalid timestamp: ''not-a-timestamp'''
      WHEN 3 THEN 'timestamp must not be more than five minutes in the future'
      WHEN 4 THEN 'level is required'
      WHEN 5 THEN 'invalid level: ''critical'''
      WHEN 6 THEN 'service is required and must be a non-empty string'
      WHEN 7 THEN 'service is required and must be a non-empty string'
      WHEN 8 THEN 'message is required and must be a non-empty string'
      WHEN 9 THEN 'attributes must be a flat object with string, number, or boolean values'
      WHEN 10 THEN 'attributes must be a flat object with string, number, or boolean values'
      WHEN 11 THEN 'entry must be an object' END AS reason,
    CASE id % 20 WHEN 14 THEN TIMESTAMP '2024-02-15 00:05:00'
                 WHEN 15 THEN TIMESTAMP '2000-01-01' ELSE ts END AS stored_ts,
    CASE WHEN id % 20 IN (12, 13) THEN '{}'
         ELSE concat('{"k":', json_extract_string(props, '$.k'), '}') END AS stored_attributes
  FROM logs)
"""


def _now():
    return F.timestamp_millis(F.lit(parse_instant(views.NOW)).cast("long"))


def _checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    batches = envelopes.from_column(views.event_batches(spark, sf_dir), "batch_id", "body")
    return check_batches(batches, _now())


def _accepted_as_text(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.select(
        *keys,
        iso_millis(F.col("timestamp")).alias("timestamp"),
        "level",
        "service",
        "message",
        F.to_json("attributes").alias("attributes"),
    )


_ACCEPTED = """strftime(stored_ts, '%Y-%m-%dT%H:%M:%S.%gZ') AS timestamp, level, service,
       message, stored_attributes AS attributes"""

_register(
    "validate_accepted",
    lambda spark, sf_dir: _accepted_as_text(
        validate.accepted(_checked(spark, sf_dir)), "batch_id", "index"
    ),
    f"WITH {_LOGS}, {_FATE} SELECT batch_id, index, {_ACCEPTED} FROM fate WHERE reason IS NULL",
)
_register(
    "validate_reject_reasons",
    lambda spark, sf_dir: validate.rejected(_checked(spark, sf_dir)),
    f"WITH {_LOGS}, {_FATE} SELECT batch_id, index, reason FROM fate WHERE reason IS NOT NULL",
)


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    batches = envelopes.from_column(views.document_batches(spark, sf_dir), "batch_id", "body")
    accepted = validate.accepted(check_batches(batches, _now()))
    return accepted.select(
        "batch_id", "index", "service", "message", F.to_json("attributes").alias("attributes")
    )


_register(
    "validate_documents",
    _documents,
    """SELECT CAST(doc_id // 20 AS VARCHAR) AS batch_id,
  CAST(row_number() OVER (PARTITION BY doc_id // 20 ORDER BY doc_id) - 1 AS INTEGER) AS index,
  source AS service, text AS message,
  concat('{"doc_id":', doc_id, ',"lang":"', lang, '","n_chars":', n_chars, '}') AS attributes
FROM documents WHERE regexp_matches(text, '\\S')""",
)


def _summary_as_text(summary: DataFrame) -> DataFrame:
    lines = F.transform(
        "rejected", lambda r: F.concat(r["index"].cast("string"), F.lit(":"), r["reason"])
    )
    return summary.select(
        "batch_id", "error", "status", "accepted", F.array_join(lines, ";").alias("rejected")
    )


_register(
    "batch_summary",
    lambda spark, sf_dir: _summary_as_text(validate.summarize(_checked(spark, sf_dir))),
    f"""WITH {_LOGS}, {_FATE}
SELECT batch_id, CAST(NULL AS VARCHAR) AS error,
       CASE WHEN count(*) FILTER (reason IS NULL) > 0 THEN 'ok' ELSE 'rejected' END AS status,
       count(*) FILTER (reason IS NULL) AS accepted,
       coalesce(string_agg(concat(index, ':', reason), ';' ORDER BY index)
                FILTER (reason IS NOT NULL), '') AS rejected
FROM fate GROUP BY batch_id""",
)


def _repeated_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches under seven ids: each body has a verdict of its own."""
    batches = views.event_batches(spark, sf_dir).withColumn(
        "batch_id", (F.col("batch_id").cast("long") % 7).cast("string")
    )
    checked = check_batches(envelopes.from_column(batches, "batch_id", "body"), _now())
    return _summary_as_text(validate.summarize(checked))


_register(
    "batch_summary_repeated_ids",
    _repeated_ids,
    ORACLES["batch_summary"]
    .replace("SELECT batch_id,", "SELECT CAST(CAST(fate.batch_id AS BIGINT) % 7 AS VARCHAR) AS batch_id,")
    .replace("GROUP BY batch_id", "GROUP BY fate.batch_id"),
)


def _broken(spark: SparkSession, sf_dir: str) -> DataFrame:
    batches = views.broken_event_batches(spark, sf_dir)
    checked = check_batches(envelopes.from_column(batches, "batch_id", "body"), _now())
    return validate.summarize(checked).select(
        "batch_id", "error", "status", "accepted", F.size("rejected").alias("rejected")
    )


_register(
    "batch_errors",
    _broken,
    """WITH batches AS (
  SELECT event_id // 50 AS batch, count(*) AS n FROM events GROUP BY 1),
judged AS (
  SELECT batch, n, CASE
    WHEN batch = 7 THEN 'request body exceeds size limit'
    WHEN batch % 10 IN (0, 1, 2) THEN 'malformed JSON in request body'
    WHEN batch % 10 IN (3, 4, 5, 7)
      THEN 'request body must be an object with a ''logs'' array' END AS error
  FROM batches)
SELECT CAST(batch AS VARCHAR) AS batch_id, error,
  CASE WHEN error IS NOT NULL THEN 'error' WHEN batch % 10 = 6 THEN 'rejected'
       ELSE 'ok' END AS status,
  CASE WHEN error IS NOT NULL OR batch % 10 = 6 THEN 0 ELSE n END AS accepted,
  0 AS rejected
FROM judged""",
)


def _file_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies in a file each, of every way they can be wrong but the one without a byte."""
    folder = scratch_path(spark, "bodies")
    bodies = views.broken_event_batches(spark, sf_dir)
    number = F.col("batch_id").cast("long")
    bodies = bodies.where((number % 10 != 7) | (number == 7))
    files = bodies.select(F.col("batch_id").alias("number"), F.col("body").alias("value"))
    with small_tasks(spark):
        files.write.partitionBy("number").text(folder)
    summary = validate.summarize(check_batches(envelopes.read_files(spark, folder), _now()))
    return summary.select(
        F.regexp_extract("batch_id", "number=([0-9]+)", 1).alias("batch_id"),
        "error",
        "status",
        "accepted",
        F.size("rejected").alias("rejected"),
    )


_register(
    "files_batch_summary",
    _file_summaries,
    ORACLES["batch_errors"] + " WHERE batch % 10 <> 7 OR batch = 7",
)


# --- the stored table ----------------------------------------------------------------

_FIRST_DAY, _LAST_DAY = dt.date(2024, 1, 3), dt.date(2024, 1, 30)
_STORED = f"""
stored AS (
  SELECT *, CASE WHEN CAST(stored_ts AS DATE) BETWEEN DATE '{_FIRST_DAY}' AND DATE '{_LAST_DAY}'
                 THEN strftime(stored_ts, '%Y-%m-%d') ELSE 'default' END AS log_day
  FROM fate WHERE reason IS NULL)
"""


def _new_table(spark: SparkSession) -> LogTable:
    """A table with partitions for the fixed window of days, made in scratch space."""
    table = LogTable(spark, scratch_path(spark, "log-table"))
    table.create(_FIRST_DAY + dt.timedelta(days=3))
    count = (_LAST_DAY - _FIRST_DAY).days + 1
    table.add_days((_FIRST_DAY + dt.timedelta(days=n)).isoformat() for n in range(count))
    return table


def _stored_table(spark: SparkSession, sf_dir: str) -> LogTable:
    table = _new_table(spark)
    batches = envelopes.from_column(views.event_batches(spark, sf_dir), "batch_id", "body")
    ingest(table, batches, _now())
    return table


def _routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    count = (_LAST_DAY - _FIRST_DAY).days + 1
    days = [(_FIRST_DAY + dt.timedelta(days=n)).isoformat() for n in range(count)]
    rows = validate.accepted(_checked(spark, sf_dir))
    return rows.select(
        "batch_id", "index", route_day(F.col("timestamp"), days).alias("log_day")
    )


_register(
    "route_partitions",
    _routed,
    f"WITH {_LOGS}, {_FATE}, {_STORED} SELECT batch_id, index, log_day FROM stored",
)
_register(
    "stored_rows",
    lambda spark, sf_dir: _accepted_as_text(
        _stored_table(spark, sf_dir).scan(), "log_day", "ingest_epoch"
    ),
    f"""WITH {_LOGS}, {_FATE}, {_STORED}
SELECT log_day, CAST(0 AS BIGINT) AS ingest_epoch, {_ACCEPTED} FROM stored""",
)


def _day_counts(table: LogTable) -> DataFrame:
    return table.scan().groupBy("log_day").agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("id").alias("ids")
    )


_register(
    "stored_ids",
    lambda spark, sf_dir: _day_counts(_stored_table(spark, sf_dir)),
    f"""WITH {_LOGS}, {_FATE}, {_STORED}
SELECT log_day, count(*) AS rows, count(*) AS ids FROM stored GROUP BY log_day""",
)


def _after_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _stored_table(spark, sf_dir)
    retention.run_retention(table, dt.date(2024, 2, 5), 20)
    return _day_counts(table)


_register(
    "retention_survivors",
    _after_retention,
    f"""WITH {_LOGS}, {_FATE}, {_STORED}
SELECT log_day, count(*) AS rows, count(*) AS ids FROM stored
WHERE log_day = 'default' OR log_day >= '2024-01-16' GROUP BY log_day""",
)


def _stored_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of a stored table, whose ids are its own."""
    table = _stored_table(spark, sf_dir)
    wanted = {
        "level": "debug",
        "since": "2024-01-01T00:00:00Z",
        "until": "2024-01-25T00:00:00Z",
        "limit": "40",
    }
    wanted["cursor"] = table.list(wanted).next_cursor
    request = listing.parse_list_request(wanted)
    page = listing.top_rows(table.scan(request.span), request, look_ahead=0)
    return _as_text(listing.render(page)).drop("id")


_register(
    "stored_page_after_cursor",
    _stored_page,
    f"""WITH {_LOGS}, {_FATE}, {_STORED}
SELECT {_ACCEPTED} FROM stored
WHERE level = 'debug' AND stored_ts >= TIMESTAMP '2024-01-01'
  AND stored_ts < TIMESTAMP '2024-01-25'
ORDER BY stored_ts DESC LIMIT 40 OFFSET 40""",
)

_STORED_COUNTS = f"""WITH {_LOGS}, {_FATE}, {_STORED}
SELECT strftime(time_bucket(INTERVAL 300 SECONDS, stored_ts, TIMESTAMP '2024-01-02 00:01:00'),
                '%Y-%m-%dT%H:%M:%S.%gZ') AS start, service AS "group", count(*) AS count
FROM stored
WHERE stored_ts >= TIMESTAMP '2024-01-02 00:01:00' AND stored_ts < TIMESTAMP '2024-01-20 12:00:00'
  AND level = 'debug' AND (WHERE_TEXT)
GROUP BY 1, 2"""


def _stored_counts(
    make_table: Callable[[SparkSession, str], LogTable], **extra: str
) -> Query:
    params = {
        "since": "2024-01-02T00:01:00Z",
        "until": "2024-01-20T12:00:00Z",
        "level": "debug",
        "bucket": "5m",
        "group_by": "service",
        **extra,
    }
    return lambda spark, sf_dir: aggregate.render(make_table(spark, sf_dir).aggregate(params))


_register(
    "stored_counts_from_rows",
    _stored_counts(_stored_table, q="view"),
    _STORED_COUNTS.replace("WHERE_TEXT", "contains(message, 'view')"),
)
_register(
    "stored_counts_from_minutes",
    _stored_counts(_stored_table),
    _STORED_COUNTS.replace("WHERE_TEXT", "TRUE"),
)


# --- the stream ------------------------------------------------------------------------


def _streamed_table(spark: SparkSession, sf_dir: str) -> LogTable:
    """Batches written to a folder and taken in from there by the stream."""
    inbox = scratch_path(spark, "inbox")
    lines = F.concat("batch_id", F.lit("\t"), "body").alias("value")
    views.event_batches(spark, sf_dir).select(lines).write.text(inbox)
    table = _new_table(spark)
    checkpoint = scratch_path(spark, "stream-checkpoint")
    stream = envelopes.stream_lines(spark, inbox)
    start_ingest(table, stream, checkpoint, _now(), available_now=True).awaitTermination()
    return table


_register(
    "stream_ingest_accepted",
    lambda spark, sf_dir: _accepted_as_text(_streamed_table(spark, sf_dir).scan(), "log_day"),
    f"WITH {_LOGS}, {_FATE}, {_STORED} SELECT log_day, {_ACCEPTED} FROM stored",
)
_register(
    "stream_rejects",
    lambda spark, sf_dir: _streamed_table(spark, sf_dir).rejects(),
    ORACLES["validate_reject_reasons"],
)
_register(
    "stream_counts_from_minutes",
    _stored_counts(_streamed_table),
    ORACLES["stored_counts_from_minutes"],
)
_register(
    "reconcile",
    lambda spark, sf_dir: _streamed_table(spark, sf_dir)
    .reconcile()
    .agg(*[F.sum(c).alias(c) for c in ("accepted", "visible", "difference")]),
    f"""WITH {_LOGS}, {_FATE}
SELECT count(*) AS accepted, count(*) AS visible, CAST(0 AS BIGINT) AS difference
FROM fate WHERE reason IS NULL""",
)


def _lines(spark: SparkSession, sf_dir: str, files: int) -> str:
    """A folder with the batches as lines of some files."""
    inbox = scratch_path(spark, "inbox")
    lines = F.concat("batch_id", F.lit("\t"), "body").alias("value")
    batches = views.event_batches(spark, sf_dir)
    batches.repartition(files, "batch_id").select(lines).write.text(inbox)
    return inbox


def _many_epochs(spark: SparkSession, sf_dir: str) -> LogTable:
    """A table that a stream has fed in several micro-batches, a file each."""
    stream = envelopes.stream_lines(spark, _lines(spark, sf_dir, 4), maxFilesPerTrigger=1)
    table = _new_table(spark)
    checkpoint = scratch_path(spark, "stream-checkpoint")
    start_ingest(table, stream, checkpoint, _now(), available_now=True).awaitTermination()
    if table.last_commit().epoch < 1:
        raise RuntimeError("the stream made a single epoch")
    return table


_register(
    "stream_counts_many_epochs",
    _stored_counts(_many_epochs),
    ORACLES["stored_counts_from_minutes"],
)


class _TornTable(LogTable):
    """A table whose writer is lost once, after an epoch's files and before its mark."""

    def _commit(self, commit: Commit, *rest: object) -> None:
        if commit.epoch == 1:
            raise ConnectionError("the writer is lost")
        super()._commit(commit, *rest)


def _restarted(spark: SparkSession, sf_dir: str) -> LogTable:
    """A stream that fails in its second micro-batch and goes on from its checkpoint."""
    stream = envelopes.stream_lines(spark, _lines(spark, sf_dir, 4), maxFilesPerTrigger=1)
    table = _new_table(spark)
    checkpoint = scratch_path(spark, "stream-checkpoint")
    torn = start_ingest(
        _TornTable(spark, table.root), stream, checkpoint, _now(), available_now=True
    )
    try:
        torn.awaitTermination()
    except StreamingQueryException:
        pass
    if table.last_commit().epoch != 0:
        raise RuntimeError("the failure left another number of epochs than one")
    start_ingest(table, stream, checkpoint, _now(), available_now=True).awaitTermination()
    return table


_register(
    "stream_ingest_after_failure",
    lambda spark, sf_dir: _accepted_as_text(_restarted(spark, sf_dir).scan(), "log_day"),
    ORACLES["stream_ingest_accepted"],
)
_register(
    "stream_ids_after_failure",
    lambda spark, sf_dir: _day_counts(_restarted(spark, sf_dir)),
    ORACLES["stored_ids"],
)


# --- upkeep ------------------------------------------------------------------------------

_EPOCHS = 3


def _by_epoch(spark: SparkSession, sf_dir: str) -> LogTable:
    """A table of three epochs: every third batch in each."""
    table = _new_table(spark)
    batches = envelopes.from_column(views.event_batches(spark, sf_dir), "batch_id", "body")
    for epoch in range(_EPOCHS):
        ingest(table, batches.where(F.col("batch_id").cast("long") % _EPOCHS == epoch), _now())
    return table


def _merged(spark: SparkSession, sf_dir: str) -> LogTable:
    """Two epochs merged, a third appended, all days but one merged again, old files gone."""
    table = _new_table(spark)
    batches = envelopes.from_column(views.event_batches(spark, sf_dir), "batch_id", "body")
    for epoch in range(_EPOCHS):
        ingest(table, batches.where(F.col("batch_id").cast("long") % _EPOCHS == epoch), _now())
        if epoch == 1:
            table.merge(table.days_to_merge(dt.date(2024, 3, 1)))
    table.merge([day for day in table.days() if day != f"{_LAST_DAY}"])
    table.clean(grace_seconds=0)
    return table


_register(
    "stored_rows_after_merge",
    lambda spark, sf_dir: _accepted_as_text(
        _merged(spark, sf_dir).scan(), "log_day", "ingest_epoch"
    ),
    f"""WITH {_LOGS}, {_FATE}, {_STORED}
SELECT log_day, CAST(batch_id AS BIGINT) % {_EPOCHS} AS ingest_epoch, {_ACCEPTED} FROM stored""",
)
_register(
    "stored_counts_after_merge",
    _stored_counts(_merged),
    ORACLES["stored_counts_from_minutes"],
)


def _id_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, distinct ids and ids out of order over all epochs of a table."""
    table = _by_epoch(spark, sf_dir)
    counts = table.scan().agg(F.count("id").alias("rows"), F.count_distinct("id").alias("ids"))
    falls = table.id_disorder().agg(F.count(F.lit(1)).alias("out_of_order"))
    return counts.crossJoin(falls)  # of one row each


_register(
    "stored_id_order",
    _id_order,
    f"""WITH {_LOGS}, {_FATE}
SELECT count(*) AS rows, count(*) AS ids, CAST(0 AS BIGINT) AS out_of_order
FROM fate WHERE reason IS NULL""",
)


def _rare_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of rows that only an attribute tells apart, far fewer than one a minute."""
    page = _by_epoch(spark, sf_dir).list(
        {"attr.k": "7", "service": "svc-1", "until": "2024-01-25T00:00:00Z", "limit": "10"}
    )
    rows = [
        (r["timestamp"], r["level"], r["service"], r["message"], r["attributes"]["k"])
        for r in page.logs
    ]
    return spark.createDataFrame(
        rows, "timestamp string, level string, service string, message string, k bigint"
    )


_register(
    "stored_page_rare",
    _rare_page,
    f"""WITH {_LOGS}, {_FATE}, {_STORED}
SELECT strftime(stored_ts, '%Y-%m-%dT%H:%M:%S.%gZ') AS timestamp, level, service, message,
       CAST(7 AS BIGINT) AS k
FROM stored
WHERE json_extract_string(stored_attributes, '$.k') = '7' AND service = 'svc-1'
  AND stored_ts < TIMESTAMP '2024-01-25'
ORDER BY stored_ts DESC LIMIT 10""",
)


_MISFILED = ("2024-01-10", "2024-01-11", "2024-01-12")


def _misfiled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What reconciling says after one epoch's rows of some days went over to another epoch.

    As many are missing in one as are too many in the other, so their sum shows nothing.
    """
    table = _by_epoch(spark, sf_dir)
    for day in _MISFILED:
        folder = f"{table.logs_path}/log_day={day}"
        if table.folders.exists(f"{folder}/ingest_epoch=1"):
            rows = spark.read.parquet(f"{folder}/ingest_epoch=1")
            rows.write.mode("append").parquet(f"{folder}/ingest_epoch=2")
            table.folders.remove(f"{folder}/ingest_epoch=1")
    return table.reconcile()


_register(
    "reconcile_after_loss",
    _misfiled,
    f"""WITH {_LOGS}, {_FATE}, {_STORED},
rows AS (
  SELECT CAST(batch_id AS BIGINT) % {_EPOCHS} AS ingest_epoch, log_day FROM stored),
acknowledged AS (SELECT ingest_epoch, count(*) AS accepted FROM rows GROUP BY 1),
seen AS (
  SELECT CASE WHEN log_day IN {_MISFILED} AND ingest_epoch = 1 THEN 2 ELSE ingest_epoch END
         AS ingest_epoch, count(*) AS visible
  FROM rows GROUP BY 1)
SELECT ingest_epoch, accepted, visible, accepted - visible AS difference
FROM acknowledged JOIN seen USING (ingest_epoch)""",
)


def _swept_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days after sweeps on one day, again on that day, and on the next; empty ones too."""
    table = _stored_table(spark, sf_dir)
    for today in (dt.date(2024, 2, 5), dt.date(2024, 2, 5), dt.date(2024, 2, 6)):
        retention.run_retention(table, today, 20)
    return table.day_counts()


_register(
    "day_window_after_sweeps",
    _swept_window,
    f"""WITH {_LOGS}, {_FATE}, {_STORED},
days AS (
  SELECT strftime(day, '%Y-%m-%d') AS log_day FROM (
    SELECT unnest(generate_series(TIMESTAMP '2024-01-17', TIMESTAMP '2024-01-30', INTERVAL 1 DAY)) AS day
    UNION ALL
    SELECT unnest(generate_series(TIMESTAMP '2024-02-05', TIMESTAMP '2024-02-09', INTERVAL 1 DAY)))
  UNION ALL SELECT 'default')
SELECT days.log_day, count(stored.id) AS rows
FROM days LEFT JOIN stored USING (log_day) GROUP BY 1""",
)


def _catalog_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalog table after a sweep; its oldest day has an epoch for every row."""
    name = f"30_days_{uuid.uuid4().hex}"
    rows = views.events_as_logs(spark, sf_dir, attributes=False)
    day = F.to_date("timestamp").cast("string")
    epoch = F.when(day == f"{_FIRST_DAY}", F.col("id")).otherwise(F.col("id") % _EPOCHS)
    rows = rows.withColumns({"log_day": day, "ingest_epoch": epoch})
    table = retention.quoted([name])
    # A table saved with its rows has all its files listed again; rows inserted into an empty
    # one bring their partitions with them.
    empty = rows.limit(0).write.partitionBy("log_day", "ingest_epoch")
    empty.option("path", scratch_path(spark, "catalog-table")).saveAsTable(table)
    with small_tasks(spark):
        rows.hint("rebalance", "log_day", "ingest_epoch").write.insertInto(table)
    retention.run_catalog_retention(spark, [name], dt.date(2024, 2, 5), 20)
    kept = spark.table(table).groupBy(F.col("log_day").alias("day")).agg(
        F.count(F.lit(1)).alias("rows")
    )
    parts = retention.catalog_partitions(spark, [name]).groupBy("day").agg(
        F.count(F.lit(1)).alias("epochs")
    )
    return parts.join(kept, "day", "left").fillna(0, "rows").withColumnRenamed("day", "log_day")


_register(
    "catalog_retention_survivors",
    _catalog_survivors,
    f"""WITH {_LOGS}
SELECT strftime(ts, '%Y-%m-%d') AS log_day, count(DISTINCT id % {_EPOCHS}) AS epochs,
       count(*) AS rows
FROM logs WHERE ts >= TIMESTAMP '2024-01-16' GROUP BY 1
UNION ALL
SELECT strftime(day, '%Y-%m-%d'), 1, 0
FROM (SELECT unnest(generate_series(TIMESTAMP '2024-02-05', TIMESTAMP '2024-02-08', INTERVAL 1 DAY)) AS day)""",
)
