"""Newest-first listing in pages that follow each other by key, not by offset."""

from __future__ import annotations

import base64
import json
import re
from collections.abc import Callable, Iterable, Iterator, Mapping
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom import schema as S
from logloom.errors import InvalidRequest
from logloom.functions import variants
from logloom.functions.text import is_blank
from logloom.functions.timestamps import instant, iso_millis, parse_instant, render_instant
from logloom.operators.filters import (
    LogFilter,
    TimeRange,
    all_of,
    filter_condition,
    parse_filters,
    parse_time_range,
    time_condition,
)
from logloom.operators.ordering import numbered

_LARGEST_ID = 2**63 - 1


@dataclass(frozen=True)
class Position:
    """Key of the last row of a page."""

    timestamp: int
    id: int


@dataclass(frozen=True)
class ListRequest:
    filters: LogFilter = LogFilter()
    span: TimeRange = TimeRange()
    limit: int = S.DEFAULT_LIMIT
    after: Position | None = None


@dataclass(frozen=True)
class Page:
    logs: list[dict]
    next_cursor: str | None


# --- page tokens ---------------------------------------------------------------


def encode_cursor(position: Position) -> str:
    fields = {"timestamp": render_instant(position.timestamp), "id": str(position.id)}
    text = json.dumps(fields, separators=(",", ":"))
    return base64.urlsafe_b64encode(text.encode()).decode().rstrip("=")


def _refuse_constant(name: str):
    raise ValueError(f"{name} is not JSON")


def decode_cursor(token: str) -> Position | None:
    """The position a token stands for, or None if it is not one of ours."""
    # Both alphabets are read and other characters are skipped.
    digits = re.sub("[^A-Za-z0-9_-]", "", token.replace("+", "-").replace("/", "_"))
    if len(digits) % 4 == 1:
        digits = digits[:-1]
    text = base64.urlsafe_b64decode(digits + "=" * (-len(digits) % 4))
    try:
        fields = json.loads(text.decode(errors="replace"), parse_constant=_refuse_constant)
    except (ValueError, RecursionError):
        return None
    if not isinstance(fields, dict):
        return None
    timestamp, row_id = fields.get("timestamp"), fields.get("id")
    if not isinstance(timestamp, str) or not isinstance(row_id, str):
        return None
    ms = parse_instant(timestamp)
    if ms is None or not re.fullmatch("[0-9]+", row_id):
        return None
    digits = row_id.lstrip("0") or "0"
    if len(digits) > 19 or int(digits) > _LARGEST_ID:
        return None
    return Position(ms, int(digits))


# --- arguments -----------------------------------------------------------------


def parse_limit(params: Mapping[str, object]) -> int:
    value = params.get("limit")
    if value is None:
        return S.DEFAULT_LIMIT
    if not isinstance(value, str) or is_blank(value):
        raise InvalidRequest("limit must be a single numeric value")
    if not re.fullmatch("[0-9]+", value):
        raise InvalidRequest("limit must be a non-negative integer")
    significant = value.lstrip("0")
    # Longer than the largest limit is out of range however long it is.
    limit = int(significant or "0") if len(significant) <= 4 else S.MAX_LIMIT + 1
    if not 1 <= limit <= S.MAX_LIMIT:
        raise InvalidRequest(f"limit must be between 1 and {S.MAX_LIMIT}")
    return limit


def parse_list_request(params: Mapping[str, object]) -> ListRequest:
    filters = parse_filters(params)
    span = parse_time_range(params)
    limit = parse_limit(params)
    token, after = params.get("cursor"), None
    if token is not None:
        if not isinstance(token, str):
            raise InvalidRequest("cursor must be a single string")
        after = decode_cursor(token)
        if after is None:
            raise InvalidRequest("invalid or malformed cursor")
    return ListRequest(filters, span, limit, after)


# --- the query -----------------------------------------------------------------


def after_condition(position: Position) -> Column:
    """Rows that follow ``position``, with the plain bound that files are pruned by."""
    at = instant(position.timestamp)
    same_instant = (F.col("timestamp") == at) & (F.col("id") < F.lit(position.id))
    return (F.col("timestamp") <= at) & ((F.col("timestamp") < at) | same_instant)


def newest_first() -> list[Column]:
    return [F.desc("timestamp"), F.desc("id")]


def matching(logs: DataFrame, request: ListRequest) -> DataFrame:
    conditions = [time_condition(request.span), filter_condition(request.filters)]
    if request.after is not None:
        conditions.append(after_condition(request.after))
    return logs.where(all_of(conditions))


def top_rows(logs: DataFrame, request: ListRequest, look_ahead: int = 1) -> DataFrame:
    """The page's rows and one more, which tells whether another page follows."""
    return (
        matching(logs, request).orderBy(*newest_first()).limit(request.limit + look_ahead)
    )


def render(logs: DataFrame) -> DataFrame:
    """The columns of a returned record; the id is text, as it may exceed 2**53."""
    attributes = F.coalesce(F.col("attributes"), variants.empty_object())
    return logs.select(
        F.col("id").cast("string").alias("id"),
        iso_millis(F.col("timestamp")).alias("timestamp"),
        "level",
        "service",
        "message",
        attributes.alias("attributes"),
    )


def _collect(rows: DataFrame) -> list[dict]:
    rendered = render(rows).withColumn("attributes", F.to_json("attributes"))
    records = [row.asDict() for row in rendered.collect()]
    for record in records:
        record["attributes"] = json.loads(record["attributes"])
    return records


def bound_by_counts(counts: DataFrame, needed: int) -> int | None:
    """Latest instant since which ``counts`` (``start, count``) add up to ``needed``.

    The earliest one if all of them together are fewer, None if there are none. The
    newest ``needed`` non-empty starts are always enough to tell, so no more than these
    are collected.
    """
    return newest_starts(counts, needed)[0]


def newest_starts(counts: DataFrame, needed: int) -> tuple[int | None, int]:
    """:func:`bound_by_counts`, and how many the counts from there on add up to."""
    total, earliest = 0, None
    for row in (
        counts.select(F.unix_millis("start").alias("ms"), "count")
        .orderBy(F.desc("ms"))
        .limit(needed)
        .collect()
    ):
        total, earliest = total + row["count"], row["ms"]
        if total >= needed:
            break
    return earliest, total


def count_by_minute(logs: DataFrame, request: ListRequest) -> DataFrame:
    """Matching rows per minute: a scan of a few columns, but only counts leave the tasks."""
    minute = F.date_trunc("minute", F.col("timestamp"))
    return (
        matching(logs, request)
        .groupBy(minute.alias("start"))
        .agg(F.count(F.lit(1)).alias("count"))
    )


def request_end(request: ListRequest) -> int | None:
    """First instant after everything the request can return."""
    end = request.span.until
    if request.after is not None:
        past_cursor = request.after.timestamp + 1
        end = past_cursor if end is None else min(end, past_cursor)
    return end


def fetch_page(
    request: ListRequest,
    scan: Callable[[TimeRange], DataFrame],
    lower_bounds: Iterable[int | None] = (None,),
) -> Page:
    """Collect one page (at most ``MAX_LIMIT + 1`` rows).

    ``scan`` returns the rows that may lie in a range. ``lower_bounds`` are instants
    to try, latest first: if the rows since one of them already fill the page, all
    older data stays unread. None is the request's own bound; without any bound to
    try there are no rows.
    """
    end, since = request_end(request), request.span.since
    records: list[dict] = []
    tried: list[int | None] = []
    for bound in lower_bounds:
        lower = since if bound is None or (since is not None and bound < since) else bound
        if lower in tried:
            continue
        tried.append(lower)
        narrowed = replace(request, span=TimeRange(lower, request.span.until))
        records = _collect(top_rows(scan(TimeRange(lower, end)), narrowed))
        if len(records) > request.limit:
            break
    page = records[: request.limit]
    if len(records) <= request.limit:
        return Page(page, None)
    last = page[-1]
    position = Position(parse_instant(last["timestamp"]), int(last["id"]))
    return Page(page, encode_cursor(position))


def narrowed(logs: DataFrame, request: ListRequest) -> ListRequest:
    """The same request, begun where counts say its page begins.

    This reads the few columns the filters need once, and then whole rows only of the
    minutes on the page, instead of a heap of whole rows in every task.
    """
    bound = bound_by_counts(count_by_minute(logs, request), request.limit + 1)
    since = request.span.since
    if bound is None or (since is not None and bound <= since):
        return request
    return replace(request, span=TimeRange(bound, request.span.until))


def list_logs(logs: DataFrame, params: Mapping[str, object] | None = None) -> Page:
    """One page of any DataFrame with the log columns."""
    request = parse_list_request(params or {})
    return fetch_page(narrowed(logs, request), lambda _: logs)


def walk(list_page: Callable[[dict], Page], params: Mapping[str, object]) -> Iterator[Page]:
    """All pages of a listing; for a bulk export, :func:`export` is one job instead."""
    params = dict(params)
    while True:
        page = list_page(params)
        yield page
        if page.next_cursor is None:
            return
        params["cursor"] = page.next_cursor


def cursor_of(timestamp: Column, row_id: Column) -> Column:
    """:func:`encode_cursor` as an expression."""
    fields = ('{"timestamp":"', iso_millis(timestamp), '","id":"', row_id.cast("string"), '"}')
    text = F.concat(*[F.lit(part) if isinstance(part, str) else part for part in fields])
    return F.translate(F.base64(text), "+/=", "-_")


def page_keys(logs: DataFrame, params: Mapping[str, object]) -> DataFrame:
    """``page, timestamp, id, next_cursor`` of the last row of every page but the last.

    All cursors of a listing at once, so that pages can be read side by side: one sort of
    the keys of the matching rows, in place of one round for every page.
    """
    request = parse_list_request(params)
    keys = matching(logs, request).select("timestamp", "id")
    placed, total = numbered(keys, *newest_first(), name="position")
    ends = placed.where((F.col("position") % request.limit == 0) & (F.col("position") < total))
    return ends.select(
        (F.col("position") / request.limit).cast("long").alias("page"),
        "timestamp",
        "id",
        cursor_of(F.col("timestamp"), F.col("id")).alias("next_cursor"),
    )


def export(logs: DataFrame, params: Mapping[str, object]) -> DataFrame:
    """Every matching row, rendered, in the order the pages have."""
    request = parse_list_request({k: v for k, v in params.items() if k != "limit"})
    return render(matching(logs, request).orderBy(*newest_first()))
