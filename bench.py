"""Times of the headline jobs over the tables in $BENCH_SF_DIR, as one JSON line.

Every job runs several times; ``queries`` has the median and ``first_run`` the first
time, which includes compiling its plan. ``load_logs_per_sec`` compares with the logs
per second of an ingest service, ``stored_counts_last_5_minutes`` with the time of its
aggregate; the ``stored_*`` jobs run on the table that ``ingest_batch`` made.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.operators import aggregate, listing
from logloom.plans import views
from logloom.plans.ingest import ingest
from logloom.plans.registry import QUERIES, _new_table, _now
from logloom.session import prepare, scratch_path
from logloom.sources import envelopes
from logloom.streaming.ingest import start_ingest

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
LOAD_COPIES = 10
REPEATS = int(os.environ.get("BENCH_REPEATS", "3"))

REGISTERED = [
    "agg_1h_service",
    "agg_1m_all",
    "agg_5m_level",
    "agg_filtered",
    "list_first_page",
    "list_after_cursor",
    "filter_q",
    "filter_attr_number",
    "filter_attr_multi",
    "export_all",
    "validate_reject_reasons",
    "batch_summary",
]


def run(frame: DataFrame) -> None:
    """Compute every row and column without sending them to the driver."""
    frame.write.format("noop").mode("overwrite").save()


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("bench")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", CPUS)
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    prepare(spark)
    times: dict[str, list[float]] = {}

    def measure(name, job):
        for _ in range(REPEATS):
            start = time.perf_counter()
            result = job()
            times.setdefault(name, []).append(time.perf_counter() - start)
        return result

    inbox, load = scratch_path(spark, "bench-inbox"), scratch_path(spark, "bench-load")
    lines = F.concat("batch_id", F.lit("\t"), "body").alias("value")
    batches = views.event_batches(spark, SF_DIR, faults=False)
    batches.select(lines).write.text(inbox)
    # Every batch ten times over, each time under its own id: at sf0.1 the size of the
    # data set the service was measured with.
    copies = F.explode(F.sequence(F.lit(1), F.lit(LOAD_COPIES))).alias("copy")
    copied = batches.select(copies, "batch_id", "body").withColumn(
        "batch_id", F.concat_ws("-", "copy", "batch_id")
    )
    copied.repartition(2 * int(CPUS)).select(lines).write.text(load)
    entries = views.events(spark, SF_DIR).count()

    def ingest_batch(folder=inbox):
        table = _new_table(spark)
        ingest(table, envelopes.read_lines(spark, folder), _now())
        return table

    def ingest_stream():
        table = _new_table(spark)
        stream = envelopes.stream_lines(spark, inbox)
        checkpoint = scratch_path(spark, "bench-checkpoint")
        start_ingest(table, stream, checkpoint, _now(), available_now=True).awaitTermination()
        return table

    table = measure("ingest_batch", ingest_batch)
    measure("ingest_stream", ingest_stream)
    measure("ingest_load", lambda: ingest_batch(load))

    month = {"since": "2024-01-01T00:00:00Z", "until": "2024-02-01T00:00:00Z"}
    recent = {"since": "2024-01-30T23:54:00Z", "until": "2024-01-30T23:59:00Z", "bucket": "1m"}
    by_hour = aggregate.parse_aggregate_request({**month, "bucket": "1h", "group_by": "service"})
    stored = {
        "stored_counts_last_5_minutes": lambda: table.aggregate(recent).collect(),
        "stored_counts_month_from_minutes": lambda: run(
            table.aggregate({**month, "bucket": "1h", "group_by": "service"})
        ),
        "stored_counts_month_from_rows": lambda: run(
            aggregate.count_rows(table.scan(by_hour.span), by_hour)
        ),
        "stored_first_page": lambda: table.list({}),
        "stored_page_filtered": lambda: table.list({"attr.k": "7", "level": "error"}),
        "stored_page_old": lambda: table.list({"until": "2024-01-10T00:00:00Z"}),
        "stored_attribute_filter": lambda: run(
            listing.matching(table.scan(), listing.parse_list_request({"attr.k": "7"}))
        ),
    }
    for name, job in stored.items():
        measure(name, job)
    for name in REGISTERED:
        measure(name, lambda: run(QUERIES[name](spark, SF_DIR)))

    medians = {name: round(statistics.median(runs), 3) for name, runs in times.items()}
    print(
        json.dumps(
            {
                "metric": "total time of the headline jobs",
                "value": round(sum(medians.values()), 3),
                "unit": "sec",
                "queries": medians,
                "first_run": {name: round(runs[0], 3) for name, runs in times.items()},
                "entries": entries,
                "ingest_logs_per_sec": round(entries / medians["ingest_batch"]),
                "load_logs_per_sec": round(entries * LOAD_COPIES / medians["ingest_load"]),
                "stream_logs_per_sec": round(entries / medians["ingest_stream"]),
                "sf": SF_DIR.rstrip("/").rsplit("sf", 1)[-1],
                "cpus": int(CPUS),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
