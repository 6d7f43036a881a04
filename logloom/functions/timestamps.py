"""ISO 8601 instants: parsing, rendering, days and anchored buckets.

Instants have millisecond precision. A date-time without an offset is UTC.
A day past the end of a short month (February 30) rolls into the next month.
"""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The usual form, for which a cast does if the day exists.
_PLAIN = (
    r"^\d{4}-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])"
    r"T([01]\d|2[0-3]):[0-5]\d:[0-5]\d(\.\d{1,6})?Z\z"
)
# Groups: year, month, day, hour, minute, second, fraction, offset.
_GENERAL = (
    r"^(\d{4})(?:-(0[1-9]|1[0-2])(?:-(0[1-9]|[12]\d|3[01]))?)?"
    r"(?:(?:[Tt]|(?<=-\d\d-\d\d) )(?:([01]\d|2[0-3]|24(?=:00(?::00(?:\.0+)?)?(?:[Zz+-]|\z)))"
    r":([0-5]\d)(?::([0-5]\d)(?:\.(\d+))?)?)"
    r"([Zz]|[+-](?:[01]\d|2[0-3]):?[0-5]\d)?)?\z"
)
_GENERAL_ON_DRIVER = re.compile(_GENERAL.replace(r"\z", r"\Z"), re.ASCII)

RENDERED = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"


def let(name: str, value: str, body: str) -> str:
    """SQL that binds ``value`` to ``name`` once and uses it several times in ``body``."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def _piece(group: int, fallback: str) -> str:
    return f"coalesce(nullif(regexp_extract(t, r'{_GENERAL}', {group}), ''), '{fallback}')"


def _number(group: int, fallback: str) -> str:
    return f"CAST({_piece(group, fallback)} AS BIGINT)"


# Offset from UTC in minutes.
_OFFSET = let(
    "zone",
    _piece(8, "Z"),
    """IF(length(zone) < 5, 0L,
        IF(left(zone, 1) = '-', -1, 1)
        * (CAST(substr(zone, 2, 2) AS BIGINT) * 60 + CAST(right(zone, 2) AS BIGINT)))""",
)
_GENERAL_MICROS = f"""
    ( ( unix_date(make_date(CAST({_piece(1, "0")} AS INT), CAST({_piece(2, "01")} AS INT), 1))
        + {_number(3, "01")} - 1 ) * 86400L
      + {_number(4, "00")} * 3600 + {_number(5, "00")} * 60 + {_number(6, "00")}
      - {_OFFSET} * 60 ) * 1000000
    + CAST(rpad(left({_piece(7, "000")}, 3), 3, '0') AS BIGINT) * 1000"""


def parse_iso(text: str) -> Column:
    """The instant a text column names, cut to milliseconds; NULL if it names none."""
    general = let(
        "t", text, f"IF(t RLIKE r'{_GENERAL}', timestamp_micros({_GENERAL_MICROS}), NULL)"
    )
    plain = f"timestamp_millis(unix_millis(try_cast({text} AS TIMESTAMP)))"
    return F.expr(f"coalesce(IF({text} RLIKE r'{_PLAIN}', {plain}, NULL), {general})")


def iso_millis(instant: Column) -> Column:
    """Render an instant as UTC with three fraction digits."""
    return F.date_format(instant, RENDERED)


def day_of(instant: Column) -> Column:
    return F.to_date(instant).cast("string")


def bucket_start(instant: Column, anchor_ms: int, width_seconds: int) -> Column:
    """Start of the fixed-width bucket of ``instant``, counted from the anchor."""
    width = F.lit(width_seconds * 1000000).cast("long")
    micros = F.unix_micros(instant)
    return F.timestamp_micros(
        micros - F.pmod(micros - F.lit(anchor_ms * 1000).cast("long"), width)
    )


# --- the same on the driver, for the few instants given as arguments ---------

_EPOCH = dt.date(1970, 1, 1)
_DAY_MS = 86400000
# Python dates cover the years 1 to 9999 only, but the calendar repeats every 400
# years, so dates near either end are worked out one cycle away.
_CYCLE_YEARS = 400
_CYCLE_DAYS = 146097


def _days_since_epoch(year: int, month: int) -> int:
    if year < 5000:
        return (dt.date(year + _CYCLE_YEARS, month, 1) - _EPOCH).days - _CYCLE_DAYS
    return (dt.date(year - _CYCLE_YEARS, month, 1) - _EPOCH).days + _CYCLE_DAYS


def _date_text(days: int) -> str:
    shift = 1 if days < 0 else -1
    date = _EPOCH + dt.timedelta(days=days + shift * _CYCLE_DAYS)
    return f"{date.year - shift * _CYCLE_YEARS:04d}-{date:%m-%d}"


def parse_instant(text: str) -> int | None:
    """Milliseconds since the epoch of an ISO 8601 instant, or None."""
    match = _GENERAL_ON_DRIVER.match(text)
    if match is None:
        return None
    year, month, day, hour, minute, second, fraction, zone = match.groups()
    days = _days_since_epoch(int(year), int(month or 1)) + int(day or 1) - 1
    seconds = days * 86400 + int(hour or 0) * 3600 + int(minute or 0) * 60 + int(second or 0)
    if zone and zone not in "Zz":
        offset = int(zone[1:3]) * 60 + int(zone[-2:])
        seconds -= (offset if zone[0] == "+" else -offset) * 60
    return seconds * 1000 + int((fraction or "0")[:3].ljust(3, "0"))


def render_instant(ms: int) -> str:
    days, rest = divmod(ms, _DAY_MS)
    time = (dt.datetime.min + dt.timedelta(milliseconds=rest)).time()
    return f"{_date_text(days)}T{time.isoformat('milliseconds')}Z"


def day_of_ms(ms: int) -> str:
    """Day of an instant; days past the year 9999 count as its last day."""
    return min(_date_text(ms // _DAY_MS), "9999-12-31", key=lambda text: (len(text), text))


def instant(ms: int) -> Column:
    """A timestamp literal, folded before planning so that it is pushed down."""
    return F.timestamp_millis(F.lit(ms).cast("long"))
