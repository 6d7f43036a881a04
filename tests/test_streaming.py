import json

import pytest
from pyspark.sql import functions as F

from conftest import TODAY, body, entry
from logloom import schema as S
from logloom.plans.ingest import ingest
from logloom.sources import envelopes
from logloom.sources.table import LogTable
from logloom.streaming.ingest import start_ingest


def run(table, source, checkpoint, now):
    query = start_ingest(table, source, str(checkpoint), now, available_now=True)
    query.awaitTermination()
    return query


def content(table):
    rows = table.scan().select(
        "timestamp", "level", "service", "message", F.to_json("attributes").alias("a"), "log_day"
    )
    return sorted(map(tuple, rows.collect()))


def bodies(first, count):
    return [
        body(
            entry(message=f"{b} first"),
            entry(level="loud"),
            entry(message=f"{b} second", timestamp="2001-02-03"),
            b,
        )
        for b in range(first, first + count)
    ]


def write(folder, first, count):
    folder.mkdir(exist_ok=True)
    for number, text in enumerate(bodies(first, count), first):
        (folder / f"{number}.json").write_text(text)


def test_stream_of_files_equals_batch(spark, tmp_path, table, now):
    inbox = tmp_path / "inbox"
    write(inbox, 0, 6)
    (inbox / "bad.json").write_text("{")
    (inbox / "large.json").write_text(" " * (S.MAX_BODY_BYTES + 1))
    source = envelopes.stream_files(spark, str(inbox), maxFilesPerTrigger=3)
    run(table, source, tmp_path / "checkpoint", now)
    assert table.last_commit().epoch >= 1, "more than one micro-batch"

    whole = LogTable(spark, str(tmp_path / "whole")).create(TODAY)
    ingest(whole, envelopes.read_files(spark, str(inbox)), now)
    assert content(table) == content(whole) and len(content(table)) == 12

    def outcome(t):
        return sorted((r.batch_id, r.error, r.accepted, r.rejected) for r in t.ledger().fillna("").collect())

    assert outcome(table) == outcome(whole)
    assert table.rejects().count() == 12
    assert table.reconcile().where("difference <> 0").count() == 0

    write(inbox, 6, 2)
    run(table, envelopes.stream_files(spark, str(inbox)), tmp_path / "checkpoint", now)
    assert len(content(table)) == 16
    ids = [row.id for row in table.scan().collect()]
    assert len(ids) == len(set(ids))


def test_a_crash_between_writing_and_committing_loses_and_repeats_nothing(
    spark, tmp_path, table, now, monkeypatch
):
    inbox = tmp_path / "inbox"
    write(inbox, 0, 4)
    with monkeypatch.context() as patch:
        patch.setattr(LogTable, "_commit", lambda *args: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(Exception, match="lost"):
            run(table, envelopes.stream_files(spark, str(inbox)), tmp_path / "checkpoint", now)
    assert content(table) == []
    table.add_days(["2001-02-03"])  # the replay routes some rows to another partition
    run(table, envelopes.stream_files(spark, str(inbox)), tmp_path / "checkpoint", now)
    assert len(content(table)) == 8
    assert spark.read.parquet(table.logs_path).count() == 8


def test_a_batch_committed_here_but_not_in_the_checkpoint_is_not_repeated(
    spark, tmp_path, table, now
):
    inbox, checkpoint = tmp_path / "inbox", tmp_path / "checkpoint"
    write(inbox, 0, 3)
    run(table, envelopes.stream_files(spark, str(inbox)), checkpoint, now)
    for mark in (checkpoint / "commits").iterdir():
        mark.unlink()
    run(table, envelopes.stream_files(spark, str(inbox)), checkpoint, now)
    assert len(content(table)) == 6 and table.last_commit().epoch == 0


def test_another_stream_is_not_taken_for_a_replay(spark, tmp_path, table, now):
    for name in ("a", "b"):
        write(tmp_path / name, 0, 2)
        run(table, envelopes.stream_files(spark, str(tmp_path / name)), tmp_path / f"c-{name}", now)
    assert len(content(table)) == 8


def test_stream_of_lines(spark, tmp_path, table, now):
    inbox = tmp_path / "inbox"
    inbox.mkdir()
    lines = [f"batch-{n}\t{text}" for n, text in enumerate(bodies(0, 5))]
    (inbox / "part").write_text("\n".join(lines))
    query = run(table, envelopes.stream_lines(spark, str(inbox)), tmp_path / "checkpoint", now)
    assert len(content(table)) == 10
    counts = query.lastProgress.observedMetrics["entries"].asDict()
    assert counts == {"received": 20, "accepted": 10, "rejected": 10}
    assert {r.batch_id for r in table.ledger().collect()} == {f"batch-{n}" for n in range(5)}


def test_now_is_the_time_of_the_micro_batch(spark, tmp_path, table):
    """Without a fixed clock, entries of this moment pass and those an hour ahead fail."""
    inbox = tmp_path / "inbox"
    inbox.mkdir()
    stamp = spark.sql(
        "SELECT date_format(current_timestamp(), \"yyyy-MM-dd'T'HH:mm:ss.SSS'Z'\") AS now,"
        " date_format(current_timestamp() + INTERVAL 1 HOUR, \"yyyy-MM-dd'T'HH:mm:ss.SSS'Z'\") AS later"
    ).first()
    (inbox / "one.json").write_text(json.dumps({"logs": [entry(timestamp=stamp.now), entry(timestamp=stamp.later)]}))
    run(table, envelopes.stream_files(spark, str(inbox)), tmp_path / "checkpoint", None)
    assert [tuple(r)[1:] for r in table.rejects().collect()] == [(1, S.TIMESTAMP_IN_FUTURE)]
