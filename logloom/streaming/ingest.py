"""Continuous ingest: the batch job on every micro-batch of an arriving folder.

The entries are validated in the streaming plan, where "now" is the micro-batch's
recorded time, so a replayed micro-batch decides every entry as it did before.
A late entry is stored and counted like any other; nothing is dropped for its age.
"""

from __future__ import annotations

import functools
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql.streaming import StreamingQuery

from logloom.plans.ingest import check_batches
from logloom.sources.table import LogTable

# Well under the 20 seconds in which an entry has to become visible.
TRIGGER = "5 seconds"


def _query_id(table: LogTable, checkpoint: str) -> str:
    """The id a stream keeps over restarts, so a new stream is never taken for it."""
    return json.loads(table.folders.read_text(f"{checkpoint}/metadata"))["id"]


def start_ingest(
    table: LogTable,
    batches: DataFrame,
    checkpoint: str,
    now: Column | None = None,
    available_now: bool = False,
) -> StreamingQuery:
    """Store a stream of batches; rejects and counts go to the table's ledger.

    A stream that ended by a failure goes on where it was if it is started again with the
    same checkpoint: what its last micro-batch may have written is replaced.
    """
    query_id = functools.cache(lambda: _query_id(table, checkpoint))

    def store(checked: DataFrame, batch: int) -> None:
        table.append(checked, query_id(), batch)

    writer = (
        check_batches(batches, now)
        .writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
    )
    trigger = {"availableNow": True} if available_now else {"processingTime": TRIGGER}
    return writer.trigger(**trigger).start()
