import datetime as dt

import pytest
from pyspark.sql import functions as F

from conftest import TODAY, batches, body, entry
from logloom.errors import ReadFailed, StoreFailed
from logloom.operators.retention import run_retention
from logloom.plans.ingest import ingest
from logloom.sources.table import LogTable, Merge

DAY, OTHER, OPEN = "2026-07-18", "2026-07-19", "2026-07-20"
LATER = dt.date(2026, 7, 20)


def some(spark, number):
    """Entries of two closed days, of today and of a day without a partition."""
    days = (DAY, OTHER, OPEN, "2001-01-01")
    return batches(
        spark,
        *[
            body(
                *[
                    entry(timestamp=f"{day}T0{hour}:00:0{number}.000Z", message=f"{number} {hour}")
                    for hour in range(5)
                ]
            )
            for day in days
        ],
    )


@pytest.fixture
def fed(spark, table, now):
    for number in range(4):
        ingest(table, some(spark, number), now)
    return table


def content(table):
    rows = table.scan().withColumn("attributes", F.to_json("attributes"))
    return sorted(map(tuple, rows.select("id", "timestamp", "message", "attributes", "log_day", "ingest_epoch").collect()))


def counts(table):
    params = {"since": "2000-01-01", "until": "2027-01-01", "bucket": "1h", "group_by": "service"}
    return list(map(tuple, table.aggregate(params).collect()))


def files(table, day):
    paths = table.scan().where(F.col("log_day") == day).select(F.input_file_name().alias("f"))
    return sorted(row.f for row in paths.distinct().collect())


def test_merged_days_hold_the_same_rows_in_few_files(fed):
    rows, buckets, epochs = content(fed), counts(fed), fed.reconcile().collect()
    assert len(files(fed, DAY)) == 4
    assert fed.days_to_merge(LATER) == [DAY, OTHER, "default"]
    done = fed.merge(fed.days_to_merge(LATER))
    assert done == [Merge(day, 3, 1) for day in (DAY, OTHER, "default")]
    for _ in range(2):
        assert content(fed) == rows and counts(fed) == buckets
        assert sorted(fed.reconcile().collect()) == sorted(epochs)
        assert [len(files(fed, day)) for day in (DAY, OTHER, OPEN)] == [1, 1, 4]
        fed.clean(grace_seconds=0)
    assert fed.folders.children(f"{fed.logs_path}/log_day={DAY}") == []
    assert len(fed.folders.children(f"{fed.logs_path}/log_day={OPEN}")) == 4
    keys = fed.minutes().where(F.col("log_day") == DAY).groupBy("minute", "service", "level").count()
    assert keys.where("count > 1").count() == 0
    assert fed.days_to_merge(LATER) == []


def test_a_reader_from_before_sees_every_row_once(fed):
    before, whole = fed.scan(), content(fed)
    planned = before.select("id")
    planned._jdf.queryExecution().executedPlan()
    fed.merge([DAY, OTHER])
    fed.clean()  # well within the grace period
    assert sorted(row.id for row in planned.collect()) == sorted(row[0] for row in whole)
    assert content(fed) == whole


def test_late_rows_join_a_merged_day_and_are_merged_with_it(spark, fed, now):
    fed.merge([DAY])
    ingest(fed, some(spark, 5), now)
    rows, buckets = content(fed), counts(fed)
    assert fed.days_to_merge(LATER, least_epochs=1)[0] == DAY
    assert fed.merge([DAY]) == [Merge(DAY, 4, 2)]
    assert content(fed) == rows and counts(fed) == buckets
    fed.clean(grace_seconds=0)
    assert content(fed) == rows and counts(fed) == buckets
    assert fed.folders.children(f"{fed.merged_path}/logs/log_day={DAY}") == ["merge=2"]
    assert [m for m in fed._merge_marks()] == [Merge(DAY, 4, 2)]


@pytest.mark.parametrize("broken", ["minutes", "count"])
def test_a_failed_merge_changes_nothing_and_can_be_tried_again(fed, monkeypatch, broken):
    rows, buckets = content(fed), counts(fed)
    write = LogTable._write_merged

    def fail(self, frame, data, *rest):
        if data == "minutes" and broken == "minutes":
            raise ConnectionError("lost")
        seen = write(self, frame, data, *rest)
        return {**seen, "counted": seen["counted"] + 1} if data == "minutes" else seen

    monkeypatch.setattr(LogTable, "_write_merged", fail)
    with pytest.raises(StoreFailed):
        fed.merge([DAY])
    assert fed.merges() == {} and content(fed) == rows and counts(fed) == buckets
    monkeypatch.undo()
    assert fed.merge([DAY]) == [Merge(DAY, 3, 1)]
    assert content(fed) == rows and counts(fed) == buckets


def test_large_days_are_cut_into_files_that_do_not_overlap(fed):
    fed.merge([DAY], file_bytes=fed.folders.size(f"{fed.logs_path}/log_day={DAY}") // 3)
    rows = fed.scan().where(F.col("log_day") == DAY)
    spans = rows.groupBy(F.input_file_name().alias("f")).agg(
        F.min("timestamp").alias("first"), F.max("timestamp").alias("last")
    )
    spans = sorted((row.first, row.last) for row in spans.select("first", "last").collect())
    assert len(spans) > 1
    assert all(one[1] <= other[0] for one, other in zip(spans, spans[1:]))


def test_a_merged_day_expires_like_any_other(fed):
    fed.merge([DAY, OTHER])
    days = {row[4] for row in content(fed)}
    run_retention(fed, TODAY, 1)
    assert {row[4] for row in content(fed)} == days - {DAY}
    assert list(fed.merges()) == [OTHER]
    assert sum(row[2] for row in counts(fed)) == len(content(fed))


def test_merging_nothing(table):
    assert table.merge([]) == [] and table.merge([DAY]) == []
    assert table.days_to_merge(LATER) == []
    table.clean(grace_seconds=0)


def test_pages_of_a_merged_table(fed):
    before = [fed.list({"limit": "7", "until": f"{OTHER}T03:00:02Z"}), fed.list({"q": "3 4"})]
    fed.merge([DAY, OTHER, "default"])
    fed.clean(grace_seconds=0)
    assert [fed.list({"limit": "7", "until": f"{OTHER}T03:00:02Z"}), fed.list({"q": "3 4"})] == before


def test_a_page_that_cannot_be_read_says_so(fed):
    for name in fed.folders.children(f"{fed.logs_path}/log_day={OPEN}"):
        fed.folders.remove(f"{fed.logs_path}/log_day={OPEN}/{name}")
    lost = LogTable.scan
    try:
        LogTable.scan = lambda self, span=None: fed.spark.read.parquet(f"{fed.root}/nowhere")
        with pytest.raises(ReadFailed, match="please retry"):
            fed.list({})
    finally:
        LogTable.scan = lost


# --- how much a listing reads ---------------------------------------------------------


def test_a_page_begins_at_the_newest_minute_not_at_midnight(spark, table, now, monkeypatch):
    for day, hour in (("2026-07-17", "03"), ("2026-07-18", "09")):
        rows = [entry(timestamp=f"{day}T{hour}:{minute}:00.000Z") for minute in range(10, 56)]
        ingest(table, batches(spark, body(*rows)), now)
    read = {"scan": [], "minutes": []}
    for name in read:
        usual = getattr(LogTable, name)
        monkeypatch.setattr(
            LogTable,
            name,
            lambda self, span, name=name, usual=usual: read[name].append(span) or usual(self, span),
        )
    page = table.list({"limit": "10"})
    assert page.logs[0]["timestamp"] == "2026-07-18T09:55:00.000Z" and len(page.logs) == 10
    assert len(read["scan"]) == 1 and len(read["minutes"]) == 1
    day = dt.datetime(2026, 7, 18, tzinfo=dt.timezone.utc).timestamp() * 1000
    assert read["minutes"][0].since == day, "one day's counts"
    assert read["scan"][0].since == day + (9 * 60 + 45) * 60000
    whole = list(read["scan"])
    assert len(table.list({"limit": "60", "level": "info"}).logs) == 60
    assert len(read["scan"]) == len(whole) + 1
    assert table.list({"limit": "200"}).next_cursor is None


def test_listing_of_a_range_that_begins_and_ends_within_a_minute(spark, table, now):
    rows = [entry(timestamp=f"2026-07-18T09:00:{second:02}.500Z") for second in range(0, 60, 5)]
    ingest(table, batches(spark, body(*rows)), now)
    span = {"since": "2026-07-18T09:00:10Z", "until": "2026-07-18T09:00:30Z"}
    assert [r["timestamp"][17:19] for r in table.list(span).logs] == ["25", "20", "15", "10"]
    found = table.list({**span, "until": "2026-07-18T09:01:00Z", "limit": "2"})
    assert [r["timestamp"][17:19] for r in found.logs] == ["55", "50"]
    assert table.list({"until": "2026-07-18T09:00:00Z"}).logs == []
