"""Filters shared by listing and counting, as arguments and as predicates.

Arguments come as a mapping of parameter names to values: a string, or a list for a
parameter given more than once. Every function that reads them raises
:class:`InvalidRequest` on a bad value, before any job starts.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from logloom import schema as S
from logloom.errors import InvalidRequest
from logloom.functions import variants
from logloom.functions.text import contains_ignoring_case
from logloom.functions.timestamps import day_of_ms, instant, parse_instant

ATTRIBUTE_PREFIX = "attr."


@dataclass(frozen=True)
class LogFilter:
    service: str | None = None
    level: str | None = None
    q: str | None = None
    attributes: Mapping[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class TimeRange:
    """``since`` inclusive, ``until`` exclusive, in milliseconds since the epoch."""

    since: int | None = None
    until: int | None = None


def parse_filters(params: Mapping[str, object]) -> LogFilter:
    service = params.get("service")
    if service is not None and (not isinstance(service, str) or not service):
        raise InvalidRequest("service must be a single non-empty string")
    level = params.get("level")
    if level is not None:
        if not isinstance(level, str):
            raise InvalidRequest("level must be a single string")
        if level not in S.LEVELS:
            raise InvalidRequest(f"invalid level: '{level}'")
    q = params.get("q")
    if q is not None and not isinstance(q, str):
        raise InvalidRequest("q must be a single string")
    attributes = {}
    for name, value in params.items():
        if not name.startswith(ATTRIBUTE_PREFIX):
            continue
        key = name.removeprefix(ATTRIBUTE_PREFIX)
        if not key:
            raise InvalidRequest("attribute filter key must not be empty")
        if not isinstance(value, str):
            raise InvalidRequest(f"attr.{key} must be a single string")
        attributes[key] = value
    return LogFilter(service, level, q, attributes)


def parse_time(params: Mapping[str, object], name: str, required: bool = False) -> int | None:
    value = params.get(name)
    if value is None:
        if required:
            raise InvalidRequest(f"{name} is required")
        return None
    if not isinstance(value, str):
        raise InvalidRequest(f"{name} must be a single string")
    ms = parse_instant(value)
    if ms is None:
        raise InvalidRequest(f"invalid timestamp for {name}: '{value}'")
    return ms


def parse_time_range(params: Mapping[str, object], required: bool = False) -> TimeRange:
    since = parse_time(params, "since", required)
    until = parse_time(params, "until", required)
    if since is not None and until is not None and until < since:
        raise InvalidRequest("until must not be earlier than since")
    return TimeRange(since, until)


def all_of(conditions: Iterable[Column]) -> Column:
    return functools.reduce(operator.and_, conditions, F.lit(True))


def filter_condition(wanted: LogFilter) -> Column:
    conditions = []
    if wanted.service is not None:
        conditions.append(F.col("service") == F.lit(wanted.service))
    if wanted.level is not None:
        conditions.append(F.col("level") == F.lit(wanted.level))
    if wanted.q is not None:
        conditions.append(contains_ignoring_case(F.col("message"), wanted.q))
    for key, text in wanted.attributes.items():
        conditions.append(variants.equals_text(F.col("attributes"), key, text))
    return all_of(conditions)


def time_condition(span: TimeRange) -> Column:
    conditions = []
    if span.since is not None:
        conditions.append(F.col("timestamp") >= instant(span.since))
    if span.until is not None:
        conditions.append(F.col("timestamp") < instant(span.until))
    return all_of(conditions)


def day_condition(first_ms: int | None, last_ms: int | None) -> Column:
    """Partitions that can hold instants of a range; ``default`` can hold any."""
    bounds = []
    if first_ms is not None:
        bounds.append(F.col("log_day") >= F.lit(day_of_ms(first_ms)))
    if last_ms is not None:
        bounds.append(F.col("log_day") <= F.lit(day_of_ms(last_ms)))
    if not bounds:
        return F.lit(True)
    return (F.col("log_day") == F.lit(S.DEFAULT_DAY)) | all_of(bounds)
