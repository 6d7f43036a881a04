"""Retention: keep a window of day partitions and drop the ones that are too old."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Sequence
from dataclasses import dataclass
from itertools import islice

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom import schema as S
from logloom.sources.table import LogTable

_DAY = re.compile(r"[0-9]{4}-[0-9]{2}-[0-9]{2}")
# Partitions that one statement drops.
PARTITIONS_AT_ONCE = 500


@dataclass(frozen=True)
class Sweep:
    added: list[str]
    dropped: list[str]


def check_days(value: object, label: str = "retentionDays") -> int:
    if isinstance(value, bool) or not isinstance(value, int) or value < 0:
        raise ValueError(f"{label} must be a non-negative integer, got: {value}")
    return value


def plan_sweep(existing: list[str], today: dt.date, days: int) -> Sweep:
    """Which of the existing day partitions expire and which new ones are due.

    Days from ``today - days`` on stay. Names that are not days never expire.
    """
    cutoff = (today - dt.timedelta(days=check_days(days))).isoformat()
    window = [
        (today + dt.timedelta(days=n)).isoformat() for n in range(S.ROLL_DAYS_AHEAD + 1)
    ]
    return Sweep(
        added=[day for day in window if day not in existing],
        dropped=[day for day in existing if _DAY.fullmatch(day) and day < cutoff],
    )


def run_retention(
    table: LogTable, today: dt.date, days: int = S.DEFAULT_RETENTION_DAYS
) -> Sweep:
    """One sweep over a stored table; running it again changes nothing."""
    sweep = plan_sweep(table.days(), today, days)
    table.add_days(sweep.added)
    for day in sweep.dropped:
        table.drop_day(day)
    return sweep


def quoted(name: str | Sequence[str]) -> str:
    """A table's name for SQL text: its parts, or text in which dots divide them."""
    parts = name.split(".") if isinstance(name, str) else name
    return ".".join(f"`{part.replace('`', '``')}`" for part in parts)


def catalog_partitions(spark: SparkSession, name: str | Sequence[str]) -> DataFrame:
    """``day, epoch`` of a catalog table partitioned by ``log_day, ingest_epoch``."""
    return spark.sql(f"SHOW PARTITIONS {quoted(name)}").select(
        F.regexp_extract("partition", "log_day=([^/]*)", 1).alias("day"),
        F.regexp_extract("partition", "ingest_epoch=([^/]*)", 1).try_cast("long").alias("epoch"),
    )


def run_catalog_retention(
    spark: SparkSession,
    name: str | Sequence[str],
    today: dt.date,
    days: int = S.DEFAULT_RETENTION_DAYS,
) -> Sweep:
    """The same sweep for a catalog table partitioned by ``log_day, ingest_epoch``.

    An empty day is registered with epoch -1, which no append ever uses. Only equality can
    be stated where partitions are dropped, so those of expired days go one by one, in
    statements of bounded length.
    """
    parts = catalog_partitions(spark, name)
    days_present = [row.day for row in parts.select("day").distinct().collect()]
    sweep = plan_sweep(sorted(days_present), today, days)
    for day in sweep.added:
        spark.sql(
            f"ALTER TABLE {quoted(name)} ADD IF NOT EXISTS "
            f"PARTITION (log_day='{day}', ingest_epoch=-1)"
        )
    expired = parts.where(F.col("day").isin(sweep.dropped) & F.col("epoch").isNotNull())
    found = expired.toLocalIterator()
    while group := list(islice(found, PARTITIONS_AT_ONCE)):
        specs = ", ".join(
            f"PARTITION (log_day='{row.day}', ingest_epoch={row.epoch})" for row in group
        )
        spark.sql(f"ALTER TABLE {quoted(name)} DROP IF EXISTS {specs}")
    return sweep
