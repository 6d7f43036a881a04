import datetime as dt
from pathlib import Path

import pytest
from pyarrow import parquet
from pyspark.sql import functions as F

from conftest import NOW, TODAY, batches, body, entry
from logloom.errors import StoreFailed
from logloom.functions.timestamps import parse_instant
from logloom.operators import aggregate, listing
from logloom.operators.filters import LogFilter, TimeRange, filter_condition
from logloom.plans.ingest import check_batches, ingest
from logloom.sources import envelopes
from logloom.sources.table import Commit, LogTable, route_day


def at(day, time="11:00:00.000"):
    return f"{day}T{time}Z"


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_create_seeds_days_around_today(table):
    assert table.days() == [(TODAY + dt.timedelta(days=n)).isoformat() for n in range(-3, 5)]
    assert table.scan().count() == 0
    assert table.ledger().count() == 0
    assert table.list() == listing.Page([], None)
    table.drop_day("2026-07-17")
    table.create(TODAY)
    assert "2026-07-17" not in table.days(), "creating an existing table changes nothing"


def test_rows_go_to_their_day_or_to_default(spark, table, now):
    days = ["2026-07-20", "2026-07-17", "2026-07-16", "1999-12-31", "2026-07-19"]
    ingest(table, batches(spark, body(*[entry(timestamp=at(d)) for d in days])), now)
    found = {
        row["day"]: row["log_day"]
        for row in table.scan().select(F.to_date("timestamp").cast("string").alias("day"), "log_day").collect()
    }
    assert found == {
        "2026-07-20": "2026-07-20",
        "2026-07-19": "2026-07-19",
        "2026-07-17": "2026-07-17",
        "2026-07-16": "default",
        "1999-12-31": "default",
    }


def test_every_range_reads_default(spark, table, now):
    ingest(table, batches(spark, body(entry(timestamp=at("2026-01-05")))), now)
    span = {"since": "2026-01-05T00:00:00Z", "until": "2026-01-06T00:00:00Z"}
    assert len(table.list(span).logs) == 1
    assert table.aggregate({**span, "bucket": "1h"}).count() == 1
    assert table.aggregate({**span, "bucket": "1h", "q": "order"}).count() == 1


def test_a_batch_without_accepted_entries_still_commits(spark, table, now):
    first = ingest(table, batches(spark, body(5), "nonsense", body()), now)
    assert first == Commit(0, 1)
    assert table.ledger().count() == 3 and table.rejects().count() == 1
    second = ingest(table, batches(spark, body(entry())), now)
    assert [row.id for row in table.scan().collect()] == [second.next_id - 1]
    assert second.epoch == 1 and second.next_id > 1


def test_ids_are_unique_and_rise(spark, table, now):
    bodies = [body(*[entry(message=f"{b} {n:03d}") for n in range(40)]) for b in range(30)]
    for part in (bodies[:20], bodies[20:]):
        ingest(table, batches(spark, *part).repartition(6), now)
    rows = table.scan().select("id", "message", "ingest_epoch").collect()
    assert len({row.id for row in rows}) == 1200 and min(row.id for row in rows) >= 1
    by_batch = {}
    for row in sorted(rows, key=lambda row: row.id):
        by_batch.setdefault((row.ingest_epoch, row.message.split()[0]), []).append(row.message)
    assert all(messages == sorted(messages) for messages in by_batch.values())
    epochs = {e: [r.id for r in rows if r.ingest_epoch == e] for e in (0, 1)}
    assert max(epochs[0]) < min(epochs[1])


def test_a_failed_attempt_is_invisible_and_replaced(spark, table, now, monkeypatch):
    good = batches(spark, body(entry(), entry(timestamp=at("2026-07-18"))))
    ingest(table, good, now)

    def fail(*args):
        raise RuntimeError("executor lost")  # stands for any failure of a job

    other = batches(spark, body(*[entry(timestamp=at(d)) for d in ("2026-07-17", "2020-01-01")]))
    with monkeypatch.context() as patch:
        patch.setattr(table, "_write_ledger", fail)
        with pytest.raises(StoreFailed, match="^internal error while storing logs$"):
            ingest(table, other, now)
    assert spark.read.parquet(table.logs_path).count() == 4, "the attempt did write rows"
    assert table.scan().count() == 2 and table.ledger().count() == 1
    assert table.minutes().agg(F.sum("count")).first()[0] == 2
    assert table.aggregate({"since": "2020-01-01", "until": "2026-08-01", "bucket": "1d"}).agg(F.sum("count")).first()[0] == 2

    ingest(table, good, now)
    assert table.scan().count() == 4
    assert spark.read.parquet(table.logs_path).count() == 4, "nothing of the attempt is left"
    assert [tuple(r) for r in table.reconcile().orderBy("ingest_epoch").collect()] == [
        (0, 2, 2, 0),
        (1, 2, 2, 0),
    ]


def test_a_replayed_micro_batch_is_stored_once(spark, table, now):
    checked = check_batches(batches(spark, body(entry(), entry())), now)
    first = table.append(checked, "stream-a", 0)
    assert table.append(checked, "stream-a", 0) == first
    assert table.append(checked, "stream-b", 0).epoch == 1
    assert table.append(checked, "stream-a", 1).epoch == 2
    assert table.append(checked, "stream-b", 0).epoch == 2
    assert table.append(checked).epoch == 3
    assert table.scan().count() == 8
    assert len(table.folders.children(table.commits_path)) == 3


def test_instants_of_any_age_are_stored(spark, table, now):
    ages = ["0001-01-01T00:00:00.000Z", "1582-10-10T00:00:00.001Z", "1969-12-31T23:59:59.999Z"]
    ingest(table, batches(spark, body(*[entry(timestamp=t) for t in ages])), now)
    assert [record["timestamp"] for record in table.list().logs] == ages[::-1]
    total = table.aggregate({"since": "0001-01-01", "until": "1970-01-01", "bucket": "1d"})
    assert [row["count"] for row in aggregate.render(total).collect()] == [1, 1, 1]


def test_reconcile_finds_what_is_missing(spark, table, now):
    ingest(table, batches(spark, body(entry(), entry(timestamp=at("2026-07-18")))), now)
    table.drop_day("2026-07-18")
    assert tuple(table.reconcile().first()) == (0, 2, 1, 1)


@pytest.fixture(scope="module")
def busy(spark, tmp_path_factory):
    """Three days of rows and some in default, in two epochs."""
    table = LogTable(spark, str(tmp_path_factory.mktemp("busy"))).create(TODAY)
    now = F.timestamp_millis(F.lit(parse_instant(NOW)).cast("long"))
    start = parse_instant("2026-07-18T00:00:00Z")
    for part in range(2):
        rows = spark.range(part * 600, part * 600 + 600).select(
            F.timestamp_millis(F.lit(start) + F.col("id") * 977 * 1000 % 200000000).alias("t"),
            "id",
        )
        one = F.to_json(
            F.struct(
                F.when(F.col("id") % 50 == 0, "2019-05-05T05:05:05.555Z")
                .otherwise(F.date_format("t", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))
                .alias("timestamp"),
                F.when(F.col("id") % 3 == 0, "warn").otherwise("info").alias("level"),
                F.when(F.col("id") % 7 == 0, "rare").otherwise("common").alias("service"),
                F.concat(F.lit("row "), "id").alias("message"),
                F.struct(F.col("id").alias("n"), (F.col("id") % 2 == 0).alias("even")).alias("attributes"),
            )
        )
        packed = rows.groupBy((F.col("id") % 10).alias("batch")).agg(
            F.concat(F.lit('{"logs":['), F.array_join(F.collect_list(one), ","), F.lit("]}")).alias("body")
        )
        ingest(table, envelopes.from_column(packed, "batch", "body"), now)
    return table


REQUESTS = [
    {},
    {"limit": "1000"},
    {"service": "rare", "limit": "25"},
    {"level": "warn", "until": "2026-07-18T12:34:56.789Z", "limit": "50"},
    {"since": "2026-07-18T06:00:30Z", "until": "2026-07-19T00:00:00.001Z", "limit": "77"},
    {"attr.even": "true", "limit": "100"},
    {"q": "ROW 11", "limit": "10"},
    {"attr.n": "600"},
    {"until": "2020-01-01T00:00:00Z", "limit": "10"},
    {"service": "nobody"},
]


@pytest.mark.parametrize("params", REQUESTS, ids=str)
def test_table_pages_equal_one_sorted_read(busy, params):
    everything = busy.scan().cache()
    pages = list(listing.walk(busy.list, params))
    whole = [row["id"] for row in listing.export(everything, params).collect()]
    assert [record["id"] for page in pages for record in page.logs] == whole
    first = listing.list_logs(everything, params)
    assert pages[0] == first
    assert [row["id"] for row in busy.export(params).collect()] == whole
    everything.unpersist()


@pytest.mark.parametrize("bucket", ["1m", "1h", "1d"])
@pytest.mark.parametrize("extra", [{}, {"level": "warn", "group_by": "service"}, {"service": "rare", "group_by": "level"}])
def test_minute_counts_equal_row_counts(busy, bucket, extra):
    for span in (
        {"since": "2026-07-18T05:03:00Z", "until": "2026-07-19T20:01:00Z"},
        {"since": "2019-01-01", "until": "2027-01-01"},
    ):
        request = aggregate.parse_aggregate_request({**span, "bucket": bucket, **extra})
        assert aggregate.answers_from_minutes(request)
        by_minute = busy.aggregate({**span, "bucket": bucket, **extra})
        assert "minutes/log_day" in plan_of(by_minute)
        by_row = aggregate.count_rows(busy.scan(request.span), request)
        assert by_minute.collect() == by_row.collect()


def test_scans_read_the_days_columns_and_rows_they_need(busy):
    span = TimeRange(parse_instant("2026-07-19T00:00:00Z"), parse_instant("2026-07-19T01:00:00Z"))
    frame = busy.scan(span).where("service = 'rare'").select("service")
    plan = plan_of(frame)
    assert "log_day=2026-07-18" not in plan and "log_day=2026-07-17" not in plan
    assert "log_day#" in plan.split("PartitionFilters")[1].split("PushedFilters")[0]
    assert "ingest_epoch#" in plan.split("PartitionFilters")[1].split("PushedFilters")[0]
    pushed = plan.split("PushedFilters")[1]
    assert "GreaterThanOrEqual(timestamp" in pushed and "EqualTo(service,rare)" in pushed
    assert "message" not in plan.split("ReadSchema")[1]


def test_the_day_of_a_row_is_never_null(spark):
    frame = spark.range(1).select(route_day(F.current_timestamp(), []).alias("log_day"))
    assert not frame.schema["log_day"].nullable


def test_files_are_sorted_and_have_bounds_to_skip_by(busy):
    for path in Path(busy.logs_path).glob("log_day=2026*/*/*.parquet"):
        file = parquet.ParquetFile(path)
        column = file.schema.names.index("timestamp")
        stats = file.metadata.row_group(0).column(column).statistics
        stamps = file.read(["timestamp"])["timestamp"].to_pylist()
        assert stats.has_min_max and stamps == sorted(stamps)


def test_attribute_filters_read_one_attribute(busy):
    wanted = filter_condition(LogFilter(attributes={"n": "600"}))
    plan = plan_of(busy.scan().where(wanted).select("message"))
    assert "attributes:struct<" in plan.split("ReadSchema")[1]
    assert busy.scan().where(wanted).count() == 1


def test_a_filled_page_leaves_older_data_unread(busy, monkeypatch):
    spans = []
    scan = busy.scan
    monkeypatch.setattr(busy, "scan", lambda span=TimeRange(): spans.append(span) or scan(span))
    page = busy.list({"limit": "5"})
    assert len(page.logs) == 5
    assert all(span.since is not None and span.since >= parse_instant("2026-07-20") for span in spans)


def test_output_files_follow_the_size_of_a_day(spark, busy):
    files = spark.read.parquet(busy.logs_path).select(
        F.col("_metadata.file_path").alias("file"), "log_day", "ingest_epoch"
    ).distinct().groupBy("log_day", "ingest_epoch").count()
    assert files.agg(F.max("count")).first()[0] == 1


def test_two_handles_see_the_same_table(spark, busy):
    other = LogTable(spark, busy.root)
    assert other.scan().count() == 1200 and other.last_commit() == busy.last_commit()


def test_a_hot_day_is_split_over_tasks_and_files(spark, table, now):
    """Nearly all rows on one day: the writer splits the day instead of one long task."""
    packed = spark.range(40, numPartitions=8).select(
        F.col("id").alias("batch"),
        F.concat(
            F.lit('{"logs":['),
            F.array_join(
                F.transform(
                    F.sequence(F.lit(1), F.lit(300)),
                    lambda n: F.concat(
                        F.lit('{"timestamp":"2026-07-20T10:'),
                        F.lpad(F.pmod(n, F.lit(60)).cast("string"), 2, "0"),
                        F.lit(':00Z","level":"info","service":"hot","message":"'),
                        F.sha2(F.concat_ws("-", "id", n.cast("string")), 512),
                        F.lit('"}'),
                    ),
                ),
                ",",
            ),
            F.lit("]}"),
        ).alias("body"),
    )
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "200KB")
    try:
        ingest(table, envelopes.from_column(packed, "batch", "body"), now)
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    assert table.scan().select("id").distinct().count() == 12000
    files = spark.read.parquet(table.logs_path).select("_metadata.file_path").distinct().count()
    assert files > 2


def test_commit_during_a_listing_stays_unseen(spark, table, now, monkeypatch):
    """A reader whose file list is older than a commit sees nothing of that epoch."""
    ingest(table, batches(spark, body(entry())), now)
    read = table._read

    def read_then_commit(path, schema, parts):
        frame = read(path, schema, parts)
        monkeypatch.setattr(table, "_read", read)
        ingest(table, batches(spark, body(entry(), entry())), now)
        return frame

    monkeypatch.setattr(table, "_read", read_then_commit)
    assert table.scan().count() == 1
    assert table.scan().count() == 3


def test_failure_after_the_mark_is_not_a_failed_store(spark, table, now, monkeypatch):
    def fail(*_):
        raise OSError("no")

    monkeypatch.setattr(table, "_tidy", fail)
    ingest(table, batches(spark, body(entry())), now)
    ingest(table, batches(spark, body(entry())), now)
    assert table.scan().count() == 2
