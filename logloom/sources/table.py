"""The stored log table: Parquet partitioned by day and by ingest epoch.

Layout under the table's root::

    logs/log_day=2026-07-20/ingest_epoch=12/...   accepted entries
    minutes/log_day=.../ingest_epoch=.../...      counts per minute, same partitions
    ledger/ingest_epoch=12/...                    one row per received batch
    commits/epoch=12.next_id=...                  marks the epoch as complete
    merged/logs/log_day=.../merge=3/...           a day's entries of many epochs
    merged/minutes/log_day=.../merge=3/...        its counts, one row per key
    commits/merged=2026-07-20.epoch=12.merge=3    these stand for all epochs up to 12

A day's folder under ``logs`` *is* its partition: rows of days without one go to
``log_day=default``. Every append is one epoch. Its commit mark is created last, so
a reader that goes by the mark sees all accepted entries of a batch or none, and
whatever a failed attempt left behind is removed before the epoch is written again.
One writer at a time is assumed; readers need no coordination.

Many small epochs of a day can be merged into few files. The files merged stay for those
who found them before the mark, until ``clean`` removes them.
"""

from __future__ import annotations

import datetime as dt
import logging
import re
from collections.abc import Iterable, Iterator, Mapping
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logloom import schema as S
from logloom.errors import ReadFailed, StoreFailed
from logloom.functions.timestamps import day_of, day_of_ms, parse_instant
from logloom.operators import aggregate, listing, validate
from logloom.operators.filters import LogFilter, TimeRange, day_condition, time_condition
from logloom.operators.ordering import falls
from logloom.session import prepare
from logloom.sources.folders import Folders

_DAY = re.compile(r"log_day=([0-9]{4}-[0-9]{2}-[0-9]{2})")
_LOG = logging.getLogger(__name__)
_MARK = re.compile(
    r"epoch=(?P<epoch>[0-9]+)\.next_id=(?P<next_id>[0-9]+)"
    r"(\.source=(?P<source>[A-Za-z0-9-]+)\.batch=(?P<batch>[0-9]+))?"
)
_MERGE_MARK = re.compile(
    r"merged=(?P<day>default|[0-9]{4}-[0-9]{2}-[0-9]{2})"
    r"\.epoch=(?P<epoch>[0-9]+)\.merge=(?P<number>[0-9]+)"
)
# Pages' worth of rows a listing reads before it counts what its filters leave.
_WIDER = (1, 64)

# Size that merged files are cut to.
MERGED_FILE_BYTES = 128 * 1024 * 1024
# How long files that were merged stay for readers that have found them.
GRACE_SECONDS = 3600.0

# Where a task number ends and a row number begins in Spark's per-task row ids.
_ROW_BITS = 33

# Names the epoch that is being written.
_STARTED = "started="


@dataclass(frozen=True)
class Commit:
    epoch: int = -1
    next_id: int = 1


@dataclass(frozen=True)
class Merge:
    """A day's rows of all epochs up to one, rewritten under a number of their own."""

    day: str
    epoch: int
    number: int

    @property
    def mark(self) -> str:
        return f"merged={self.day}.epoch={self.epoch}.merge={self.number}"


def _newest(marks: list[re.Match]) -> Commit:
    found = [Commit(int(mark["epoch"]), int(mark["next_id"])) for mark in marks]
    return max(found, key=lambda commit: commit.epoch, default=Commit())


def assign_ids(rows: DataFrame, first_id: int) -> DataFrame:
    """Give rows unique ids from ``first_id`` on, rising with input order in a task.

    The n-th row of task t of T gets ``first_id + n * T + t``: no counting pass, no
    order through a single task, and no limit on the rows of a task. The number of
    tasks is checked where the ids are made, so a wrong one fails instead of clashing.
    """
    tasks = rows.select().rdd.getNumPartitions()
    numbered = rows.withColumn("task_row", F.monotonically_increasing_id())
    task = F.shiftright("task_row", _ROW_BITS)
    row = F.col("task_row").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    known_task = F.when(task < tasks, task).otherwise(
        F.raise_error(F.lit("more tasks than counted")).cast("long")
    )
    row_id = F.lit(first_id).cast("long") + row * F.lit(tasks) + known_task
    return numbered.withColumn("id", row_id).drop("task_row")


def route_day(instant: Column, days: Iterable[str]) -> Column:
    """The partition of an instant: its day if that has one, else ``default``."""
    day = day_of(instant)
    # Never null, so the writer keeps the order rows are sorted in.
    return F.coalesce(F.when(day.isin(*days), day), F.lit(S.DEFAULT_DAY))


def seed_days(today: dt.date) -> list[str]:
    """Days that get a partition when a table is first set up."""
    offsets = range(-S.SEED_DAYS_BACK, S.SEED_DAYS_AHEAD + 1)
    return [(today + dt.timedelta(days=n)).isoformat() for n in offsets]


class LogTable:
    def __init__(self, spark: SparkSession, root: str):
        self.spark = prepare(spark)
        self.root = root.rstrip("/")
        self.logs_path = f"{self.root}/logs"
        self.minutes_path = f"{self.root}/minutes"
        self.ledger_path = f"{self.root}/ledger"
        self.commits_path = f"{self.root}/commits"
        self.merged_path = f"{self.root}/merged"
        self.folders = Folders(spark)

    # --- days -----------------------------------------------------------------

    def create(self, today: dt.date) -> LogTable:
        """Set the table up; on an existing table, nothing changes."""
        if not self.folders.exists(self._day_path(S.DEFAULT_DAY)):
            self.add_days(seed_days(today))
            self.folders.create(self._day_path(S.DEFAULT_DAY))
        return self

    def _day_path(self, day: str, data: str | None = None) -> str:
        return f"{data or self.logs_path}/log_day={day}"

    def days(self) -> list[str]:
        """Days that have a partition, oldest first; never ``default``."""
        names = map(_DAY.fullmatch, self.folders.children(self.logs_path))
        return [match.group(1) for match in names if match]

    def add_days(self, days: Iterable[str]) -> None:
        for day in days:
            self.folders.create(self._day_path(day))

    def drop_day(self, day: str) -> None:
        """Remove a day's partition without reading it."""
        if not re.fullmatch(r"[0-9]{4}-[0-9]{2}-[0-9]{2}", day):
            raise ValueError(f"not a day: {day}")
        for merge in self._merge_marks():
            if merge.day == day:
                self.folders.remove(f"{self.commits_path}/{merge.mark}")
        for data in ("minutes", "logs"):
            self.folders.remove(self._day_path(day, f"{self.merged_path}/{data}"))
            self.folders.remove(self._day_path(day, f"{self.root}/{data}"))

    # --- commits --------------------------------------------------------------

    def _marks(self) -> list[re.Match]:
        names = map(_MARK.fullmatch, self.folders.children(self.commits_path))
        return [match for match in names if match]

    def last_commit(self) -> Commit:
        return _newest(self._marks())

    def _begin(self, epoch: int) -> None:
        """Note that an epoch is being written; clear what an earlier try has left."""
        note = f"{self.commits_path}/{_STARTED}{epoch}"
        if self.folders.exists(note):
            self._clear_epoch(epoch)
        self.folders.create(note)

    def _commit(
        self, commit: Commit, older: list[re.Match], source: str | None, batch: int | None
    ) -> None:
        name = f"epoch={commit.epoch}.next_id={commit.next_id}"
        if source is not None:
            name += f".source={source}.batch={batch}"
        self.folders.create(f"{self.commits_path}/{name}")
        # From here on the epoch is stored; what is left over does no harm.
        try:
            self._tidy(older, source)
        except Exception:
            _LOG.warning("old marks could not be removed", exc_info=True)

    def _tidy(self, older: list[re.Match], source: str | None) -> None:
        """Keep the newest mark of every stream, so that the list stays short."""
        for mark in older:
            if mark["source"] is None or mark["source"] == source:
                self.folders.remove(f"{self.commits_path}/{mark.group(0)}")
        for note in self.folders.children(self.commits_path):
            if note.startswith(_STARTED):
                self.folders.remove(f"{self.commits_path}/{note}")

    def _clear_epoch(self, epoch: int) -> None:
        """Remove what an attempt that never committed may have left."""
        for data in (self.logs_path, self.minutes_path):
            for name in self.folders.children(data):
                self.folders.remove(f"{data}/{name}/ingest_epoch={epoch}")
        self.folders.remove(f"{self.ledger_path}/ingest_epoch={epoch}")

    # --- writing --------------------------------------------------------------

    def append(
        self, checked: DataFrame, source: str | None = None, batch: int | None = None
    ) -> Commit:
        """Store the accepted entries of validated batches as one epoch.

        ``source`` and ``batch`` identify a micro-batch of a stream; one that is
        already committed is not stored again.
        """
        marks = self._marks()
        last = _newest(marks)
        stored = [int(mark["batch"]) for mark in marks if source and mark["source"] == source]
        if stored and batch <= max(stored):
            return last
        epoch = last.epoch + 1
        self._begin(epoch)
        # Entries are parsed, validated and routed once for the three outputs.
        log_day = route_day(F.col("timestamp"), self.days())
        checked = checked.withColumn("log_day", log_day)
        checked = checked.withColumn("ingest_epoch", F.lit(epoch).cast("long"))
        checked = checked.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            next_id = self._write_epoch(checked, epoch, last.next_id)
            commit = Commit(epoch, next_id)
            self._commit(commit, marks, source, batch)
        except Exception as error:
            raise StoreFailed(S.STORE_FAILED) from error
        finally:
            checked.unpersist()
        return commit

    def _write_epoch(self, checked: DataFrame, epoch: int, first_id: int) -> int:
        """Write the three outputs side by side; returns the next free id."""
        # This job fills the cache, which the writers then share.
        has_rows = checked.where(validate.is_accepted()).count() > 0
        with ThreadPoolExecutor(max_workers=3) as writers:
            ledger = writers.submit(self._write_ledger, checked, epoch)
            if has_rows:
                minutes = writers.submit(self._write_minutes, checked)
                logs = writers.submit(self._write_logs, checked, first_id)
        ledger.result()
        if not has_rows:
            return first_id
        minutes.result()
        return logs.result()

    def _write_logs(self, checked: DataFrame, first_id: int) -> int:
        seen = Observation()
        rows = assign_ids(checked.where(validate.is_accepted()), first_id)
        rows = rows.observe(seen, F.max("id").alias("last_id"))
        # Rebalancing sizes the output files: a day with most of the rows is split
        # over many tasks, and a day with a few late rows gets one file. Sorting
        # makes the min/max of row groups narrow, so time bounds skip most of them.
        (
            rows.select(S.LOGS.fieldNames())
            .hint("rebalance", "log_day")
            .sortWithinPartitions("log_day", "ingest_epoch", "timestamp", "id")
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("log_day", "ingest_epoch")
            .parquet(self.logs_path)
        )
        return seen.get["last_id"] + 1

    def _write_minutes(self, checked: DataFrame) -> None:
        minute = F.timestamp_micros(
            F.unix_micros("timestamp") - F.pmod(F.unix_micros("timestamp"), F.lit(60000000))
        )
        (
            checked.where(validate.is_accepted())
            .groupBy("log_day", "ingest_epoch", minute.alias("minute"), "service", "level")
            .agg(F.count(F.lit(1)).alias("count"))
            .select(S.MINUTE_COUNTS.fieldNames())
            .hint("rebalance", "log_day")
            .sortWithinPartitions("log_day", "ingest_epoch", "minute")
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("log_day", "ingest_epoch")
            .parquet(self.minutes_path)
        )

    def _write_ledger(self, checked: DataFrame, epoch: int) -> None:
        (
            validate.summarize(checked)
            .withColumn("ingest_epoch", F.lit(epoch).cast("long"))
            .select(S.LEDGER.fieldNames())
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("ingest_epoch")
            .parquet(self.ledger_path)
        )

    # --- merging --------------------------------------------------------------

    def _merge_marks(self) -> list[Merge]:
        found = map(_MERGE_MARK.fullmatch, self.folders.children(self.commits_path))
        return [
            Merge(mark["day"], int(mark["epoch"]), int(mark["number"])) for mark in found if mark
        ]

    def merges(self) -> dict[str, Merge]:
        """The merge that counts, for every day that has one."""
        return {merge.day: merge for merge in sorted(self._merge_marks(), key=lambda m: m.number)}

    def _unmerged(self, day: str) -> int:
        """How many epochs of a day are not in its merged files."""
        merge = self.merges().get(day)
        names = self.folders.children(self._day_path(day))
        epochs = [int(name.partition("=")[2]) for name in names if name.startswith("ingest_epoch=")]
        return sum(merge is None or epoch > merge.epoch for epoch in epochs)

    def days_to_merge(self, today: dt.date, least_epochs: int = 2) -> list[str]:
        """Closed days and ``default``, if so many of their epochs are not merged yet."""
        closed = [day for day in self.days() if day < today.isoformat()]
        return [
            day for day in [*closed, S.DEFAULT_DAY] if self._unmerged(day) >= least_epochs
        ]

    def merge(self, days: Iterable[str], file_bytes: int = MERGED_FILE_BYTES) -> list[Merge]:
        """Rewrite the epochs of days as few files, and their counts as one row per key.

        One job for all days: rows are dealt by ranges of (day, timestamp, id), so files
        have about ``file_bytes`` and do not overlap in time, however large a day is. A
        day's mark is set last. Until then, and for all who read the marks before it,
        nothing changes; an attempt that fails leaves files that nobody reads. Epochs may
        be appended meanwhile.
        """
        days = sorted(set(days))
        committed, known = self.last_commit().epoch, self.merges()
        days = [day for day in days if self._unmerged(day) or day in known]
        if not days:
            return []
        number = 1 + max((merge.number for merge in self._merge_marks()), default=0)
        size = sum(self._bytes(day, known.get(day)) for day in days)
        files = len(days) + size // file_bytes
        rows = self._of_days("logs", S.LOGS, days, known, committed)
        minutes = self._of_days("minutes", S.MINUTE_COUNTS, days, known, committed)
        keys = ("log_day", "minute", "service", "level")
        summed = minutes.groupBy(*keys).agg(F.sum("count").alias("count"))
        try:
            stored = self._write_merged(rows, "logs", number, files, "timestamp", "id")
            counted = self._write_merged(
                summed.withColumn("ingest_epoch", F.lit(committed).cast("long")),
                "minutes", number, len(days), "minute", "service", "level",
            )
            if stored["rows"] != counted["counted"]:
                raise ValueError(f"{stored['rows']} rows, counted as {counted['counted']}")
            done = [Merge(day, committed, number) for day in days]
            for merge in done:
                self.folders.create(f"{self.commits_path}/{merge.mark}")
        except Exception as error:
            raise StoreFailed(S.STORE_FAILED) from error
        return done

    def _bytes(self, day: str, merge: Merge | None) -> int:
        merged = 0 if merge is None else self.folders.size(self._merged_day("logs", merge))
        return merged + self.folders.size(self._day_path(day))

    def _merged_day(self, data: str, merge: Merge) -> str:
        return f"{self._day_path(merge.day, f'{self.merged_path}/{data}')}/merge={merge.number}"

    def _write_merged(
        self, rows: DataFrame, data: str, number: int, files: int, *order: str
    ) -> dict:
        """Write days to ``merged``; returns how many rows, and what their counts add up to."""
        seen = Observation()
        counted = F.sum("count") if "count" in rows.columns else F.lit(None)
        totals = [
            F.count(F.lit(1)).alias("rows"), F.coalesce(counted, F.lit(0)).alias("counted")
        ]
        (
            rows.withColumn("merge", F.lit(number))
            .repartitionByRange(files, "log_day", *order)
            .observe(seen, *totals)  # above, the sampling of ranges would be counted too
            .sortWithinPartitions("log_day", "merge", *order)
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("log_day", "merge")
            .parquet(f"{self.merged_path}/{data}")
        )
        return seen.get

    def clean(self, grace_seconds: float = GRACE_SECONDS) -> None:
        """Remove files whose rows are in merged files since longer than the grace period.

        A read that began before a merge and lasts longer than that fails, as it does when
        its day is dropped.
        """
        current = self.merges()
        old = [
            merge
            for merge in current.values()
            if self.folders.age_seconds(f"{self.commits_path}/{merge.mark}") >= grace_seconds
        ]
        marked = self._merge_marks()
        for merge in old:
            for data in ("logs", "minutes"):
                day = self._day_path(merge.day, f"{self.root}/{data}")
                for name in self.folders.children(day):
                    if int(name.partition("=")[2]) <= merge.epoch:
                        self.folders.remove(f"{day}/{name}")
                day = self._day_path(merge.day, f"{self.merged_path}/{data}")
                for name in self.folders.children(day):
                    if int(name.partition("=")[2]) < merge.number:
                        self.folders.remove(f"{day}/{name}")
            for other in marked:
                if other.day == merge.day and other.number < merge.number:
                    self.folders.remove(f"{self.commits_path}/{other.mark}")

    # --- reading --------------------------------------------------------------

    def _read(self, path: str, schema: T.StructType, parts: list[str]) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", path).parquet(*parts)

    def _of_days(
        self,
        data: str,
        schema: T.StructType,
        days: Iterable[str],
        merges: Mapping[str, Merge],
        committed: int,
    ) -> DataFrame:
        """Rows of some days' partitions: the merged ones, and epochs that came later."""
        path = f"{self.root}/{data}"
        present = set(self.folders.children(path))
        parts = [f"{path}/log_day={day}" for day in days if f"log_day={day}" in present]
        rows = self._read(path, schema, parts).where(F.col("ingest_epoch") <= committed)
        own = [merges[day] for day in days if day in merges]
        if not own:
            return rows
        last = F.create_map(*[F.lit(x) for merge in own for x in (merge.day, merge.epoch)])
        later = F.col("ingest_epoch") > F.coalesce(F.try_element_at(last, F.col("log_day")), F.lit(-1))
        path = f"{self.merged_path}/{data}"
        numbered = T.StructType([*schema.fields, T.StructField("merge", T.IntegerType())])
        merged = self._read(path, numbered, [self._merged_day(data, merge) for merge in own])
        return rows.where(later).unionByName(merged.drop("merge"))

    def _read_days(self, data: str, schema: T.StructType, span: TimeRange) -> DataFrame:
        """Committed rows of the days that a range touches, and of ``default``.

        Only those days' folders are listed; the same bound is stated on ``log_day``.
        """
        # Marks come before the listing: an epoch committed in between may be missing
        # from the files found, so it must not count as committed. A merge holds no epoch
        # that was not committed before it, so merges are read first.
        merges, committed = self.merges(), self.last_commit().epoch
        first = "" if span.since is None else day_of_ms(span.since)
        last = "9999-12-31" if span.until is None else day_of_ms(span.until)
        days = [day for day in self.days() if first <= day <= last]
        rows = self._of_days(data, schema, [*days, S.DEFAULT_DAY], merges, committed)
        return rows.where(day_condition(span.since, span.until))

    def scan(self, span: TimeRange = TimeRange()) -> DataFrame:
        """Committed log rows of a time range."""
        return self._read_days("logs", S.LOGS, span).where(time_condition(span))

    def minutes(self, span: TimeRange = TimeRange()) -> DataFrame:
        """Additive counts per minute, service and level (several rows per minute)."""
        return self._read_days("minutes", S.MINUTE_COUNTS, span)

    def ledger(self) -> DataFrame:
        """One row per received batch: how many entries, which were refused and why."""
        committed = self.last_commit().epoch
        present = [self.ledger_path] if self.folders.exists(self.ledger_path) else []
        return self._read(self.ledger_path, S.LEDGER, present).where(
            F.col("ingest_epoch") <= committed
        )

    def rejects(self) -> DataFrame:
        """Refused entries, one row each."""
        return self.ledger().select("batch_id", F.inline("rejected"))

    def day_counts(self) -> DataFrame:
        """``log_day, rows`` of every partition, those without rows included."""
        days = self.spark.createDataFrame(
            [(day,) for day in [*self.days(), S.DEFAULT_DAY]], "log_day string"
        )
        counts = self.minutes().groupBy("log_day").agg(F.sum("count").alias("rows"))
        return days.join(counts, "log_day", "left").fillna(0, "rows")

    def id_disorder(self) -> DataFrame:
        """Rows whose id does not exceed all ids of earlier epochs, or is there twice."""
        rows = self.scan().select("ingest_epoch", "id")
        return falls(rows, "id", F.col("ingest_epoch"), F.col("id"))

    def reconcile(self) -> DataFrame:
        """Per epoch, entries acknowledged and entries visible; they must be equal.

        Dropping an old day removes entries that were acknowledged, so this is for
        epochs whose days are all still there. An epoch that only one side knows has a row
        too. Look at each epoch's difference: a sum of them may cancel.
        """
        acknowledged = self.ledger().groupBy("ingest_epoch").agg(
            F.sum("accepted").alias("accepted")
        )
        visible = self.scan().groupBy("ingest_epoch").agg(F.count(F.lit(1)).alias("visible"))
        count = {"accepted": 0, "visible": 0}
        return (
            acknowledged.join(visible, "ingest_epoch", "full_outer")
            .fillna(count)
            .withColumn("difference", F.col("accepted") - F.col("visible"))
        )

    # --- queries --------------------------------------------------------------

    def _recent_spans(self, span: TimeRange) -> Iterator[TimeRange]:
        """A range in pieces, latest first: one day that holds rows, then two, four, ...

        The last piece has whatever is older than all days, which ``default`` may hold.
        """
        first = "" if span.since is None else day_of_ms(span.since)
        last = "9999-12-31" if span.until is None else day_of_ms(span.until)
        merges = self.merges()
        end, size, found = span.until, 1, 0
        for day in reversed(self.days()):
            if not first <= day <= last:
                continue
            if day not in merges and not self.folders.children(self._day_path(day)):
                continue
            found += 1
            if found == size:
                begin = parse_instant(f"{day}T00:00Z")
                if span.since is not None:
                    begin = max(begin, span.since)
                yield TimeRange(begin, end)
                end, size, found = begin, 2 * size, 0
        if span.since is None or end is None or end > span.since:
            yield TimeRange(span.since, end)

    def _minutes_bound(self, span: TimeRange, filters: LogFilter, needed: int) -> int | None:
        """Latest whole minute since which so many rows match, by the counts per minute.

        The earliest minute with a match if there are fewer, None if there is none. Days
        are read newest first and no more of them than it takes.
        """
        bound = None
        for piece in self._recent_spans(span):
            counts = aggregate.matching_minutes(self.minutes(piece), piece, filters)
            earliest, total = listing.newest_starts(counts, needed)
            if earliest is not None:
                bound, needed = earliest, needed - total
            if needed <= 0:
                break
        return bound

    def _lower_bounds(self, request: listing.ListRequest) -> Iterator[int | None]:
        """Instants since which a listing may find its page, latest first.

        The counts per minute know service and level. A request that filters by nothing
        else begins where they say, and is done after that one scan. For others they tell
        how far back a page must reach at least, which often is enough or nearly so; then
        the matching rows themselves are counted per minute. So no attempt ever sends
        many rows from many tasks.
        """
        end = listing.request_end(request)
        # Only whole minutes before the end count, so a bound errs to the early side. The
        # first minute counts as a whole: a bound in it is the request's own.
        since = None if request.span.since is None else request.span.since // 60000 * 60000
        whole = None if end is None else end // 60000 * 60000
        span, needed = TimeRange(since, whole), request.limit + 1
        known = replace(request.filters, q=None, attributes={})
        if known == request.filters:
            bound = self._minutes_bound(span, known, needed)
            # Without a whole minute that matches, only the begun one is left.
            if bound is not None or end != whole:
                yield whole if bound is None else bound
            return
        for pages in _WIDER:
            bound = self._minutes_bound(span, known, pages * needed)
            if bound is not None:
                yield bound
        counts = listing.count_by_minute(self.scan(TimeRange(request.span.since, end)), request)
        bound = listing.bound_by_counts(counts, needed)
        if bound is not None:
            yield bound

    def list(self, params: Mapping[str, object] | None = None) -> listing.Page:
        """One page, reading the newest rows first and older days only if needed."""
        request = listing.parse_list_request(params or {})
        try:
            return listing.fetch_page(request, self.scan, self._lower_bounds(request))
        except Exception as error:
            raise ReadFailed(S.READ_FAILED) from error

    def export(self, params: Mapping[str, object]) -> DataFrame:
        """Every matching row, rendered and in page order, as one distributed sort."""
        request = listing.parse_list_request({k: v for k, v in params.items() if k != "limit"})
        span = TimeRange(request.span.since, listing.request_end(request))
        return listing.export(self.scan(span), params)

    def aggregate(self, params: Mapping[str, object]) -> DataFrame:
        """Bucket counts, from the counts per minute wherever these are enough."""
        request = aggregate.parse_aggregate_request(params)
        if aggregate.answers_from_minutes(request):
            return aggregate.count_minutes(self.minutes(request.span), request)
        return aggregate.count_rows(self.scan(request.span), request)
