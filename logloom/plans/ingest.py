"""Batch ingest: bodies to validated entries to one epoch of the table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame

from logloom.operators.validate import check_entries, summarize
from logloom.session import prepare
from logloom.sources.envelopes import explode_entries, parse
from logloom.sources.table import Commit, LogTable


def check_batches(batches: DataFrame, now: Column | None = None) -> DataFrame:
    """All entries of ``batch_id, body_bytes, body`` rows, each with its verdict."""
    prepare(batches.sparkSession)
    return check_entries(explode_entries(parse(batches)), now)


def summarize_batches(batches: DataFrame, now: Column | None = None) -> DataFrame:
    return summarize(check_batches(batches, now))


def ingest(table: LogTable, batches: DataFrame, now: Column | None = None) -> Commit:
    """Validate batches and store what is accepted."""
    return table.append(check_batches(batches, now))
