"""Counts per time bucket anchored at the start of the range."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom import schema as S
from logloom.errors import InvalidRequest
from logloom.functions.timestamps import bucket_start, iso_millis
from logloom.operators.filters import (
    LogFilter,
    TimeRange,
    filter_condition,
    parse_filters,
    parse_time_range,
    time_condition,
)


@dataclass(frozen=True)
class AggregateRequest:
    filters: LogFilter
    span: TimeRange
    width_seconds: int
    group_by: str | None


def parse_aggregate_request(params: Mapping[str, object]) -> AggregateRequest:
    filters = parse_filters(params)
    span = parse_time_range(params, required=True)
    bucket = params.get("bucket")
    if bucket is None:
        raise InvalidRequest("bucket is required")
    if not isinstance(bucket, str) or bucket not in S.BUCKET_SECONDS:
        raise InvalidRequest(f"bucket must be one of: {', '.join(S.BUCKET_SECONDS)}")
    group_by = params.get("group_by")
    if group_by is not None and group_by not in S.GROUP_COLUMNS:
        raise InvalidRequest(f"group_by must be one of: {', '.join(S.GROUP_COLUMNS)}")
    return AggregateRequest(filters, span, S.BUCKET_SECONDS[bucket], group_by)


def _group_column(request: AggregateRequest):
    if request.group_by is None:
        return F.lit(None).cast("string")
    return F.col(request.group_by)


def count_rows(logs: DataFrame, request: AggregateRequest) -> DataFrame:
    """``start, group, count`` by scanning rows; empty buckets do not appear."""
    start = bucket_start(F.col("timestamp"), request.span.since, request.width_seconds)
    return (
        logs.where(time_condition(request.span) & filter_condition(request.filters))
        .groupBy(start.alias("start"), _group_column(request).alias("group"))
        .agg(F.count(F.lit(1)).alias("count"))
        .orderBy("start", "group")
    )


def answers_from_minutes(request: AggregateRequest) -> bool:
    """True if counts per (minute, service, level) decide the result exactly."""
    aligned = request.span.since % 60000 == 0 and request.span.until % 60000 == 0
    return aligned and request.filters.q is None and not request.filters.attributes


def matching_minutes(minutes: DataFrame, span: TimeRange, filters: LogFilter) -> DataFrame:
    """``start, service, level, count`` of the minutes in a range."""
    rows = minutes.withColumnRenamed("minute", "timestamp")
    return rows.where(time_condition(span) & filter_condition(filters)).withColumnRenamed(
        "timestamp", "start"
    )


def count_minutes(minutes: DataFrame, request: AggregateRequest) -> DataFrame:
    """The same result from additive counts per (minute, service, level)."""
    start = bucket_start(F.col("start"), request.span.since, request.width_seconds)
    return (
        matching_minutes(minutes, request.span, request.filters)
        .groupBy(start.alias("start"), _group_column(request).alias("group"))
        .agg(F.sum("count").alias("count"))
        .orderBy("start", "group")
    )


def render(buckets: DataFrame) -> DataFrame:
    return buckets.select(iso_millis(F.col("start")).alias("start"), "group", "count")


def aggregate_logs(logs: DataFrame, params: Mapping[str, object]) -> DataFrame:
    """Bucket counts of any DataFrame with the log columns."""
    return count_rows(logs, parse_aggregate_request(params))
