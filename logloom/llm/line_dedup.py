"""Lines that many documents share, kept in one document only.

An index of line hashes in levels: documents come in batches, those with the greatest ids
first. A batch's lines are counted by hash and merge-anti-joined with the sorted runs so
far. Hashes no run knows form a new run, and the batch holds their lines; for the known
ones only a count is logged, as an earlier batch has a greater id. Runs of one level are
merged into one of the next when there are enough of them, so that a batch meets few runs.
At the end, runs and counts together say which lines are common and who keeps them.

Hashes are two 64-bit ones of different seeds. All steps are DataFrame functions, and
every table between steps is written to the shared folder.

A null or empty text is one empty line. Every row counts as a document of its own unless
id and text are both equal. A null id is less than every other. Further columns are kept
out of the way and, by :func:`without_common_lines`, returned as they are.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.llm.tables import stored
from logloom.session import scratch_path
from logloom.sources.folders import Folders

#: Keys of fewer code points are never common.
LEAST_CHARS = 40
#: In so many documents a line is common.
LEAST_DOCUMENTS = 5
#: Batches the documents of one call are dealt into.
BATCHES = 4
#: Runs of one level that are merged into one of the next.
FANOUT = 3

_WHITE = " \t\n\x0b\x0c\r"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_HASH = ("hash", "check")


def _key(line: Column) -> Column:
    """A line as it is compared: without white space around it, A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(_WHITE)), _UPPER, _UPPER.lower())


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


# --- the index --------------------------------------------------------------------


@dataclass(frozen=True)
class _Run:
    level: int
    path: str


class LineRuns:
    """Sorted runs of line hashes in levels, under a folder all executors share.

    ``add`` takes ``hash, check, documents, holder`` of one batch, a row per hash; no id
    of a later batch may be greater than one of an earlier batch. Runs never share a hash.
    """

    def __init__(self, spark: SparkSession, fanout: int = FANOUT) -> None:
        self._spark = spark
        self._fanout = fanout
        self._root = scratch_path(spark, "line-runs")
        self._folders = Folders(spark)
        self._runs: list[_Run] = []
        self._counts: list[str] = []
        self._written = 0

    def _path(self) -> str:
        self._written += 1
        return f"{self._root}/{self._written}"

    def levels(self) -> list[int]:
        """The level of every run."""
        return [run.level for run in self._runs]

    def runs(self) -> DataFrame | None:
        """Every hash with the greatest id that holds it; None before the first batch."""
        return self._read([run.path for run in self._runs])

    def _read(self, paths: list[str]) -> DataFrame | None:
        return self._spark.read.parquet(*paths) if paths else None

    def add(self, batch: DataFrame) -> None:
        """Merge a batch in: new hashes become a run, for known ones counts are kept."""
        known = self.runs()
        if known is None:
            marked = batch.withColumn("known", F.lit(False))
        else:
            known = known.select(*_HASH, F.lit(True).alias("known"))
            marked = batch.join(known, list(_HASH), "left").withColumn(
                "known", F.coalesce("known", F.lit(False))
            )
        path = self._path()
        (
            marked.select(*_HASH, "documents", "holder", "known")
            .sortWithinPartitions("known", *_HASH)
            .write.partitionBy("known")
            .parquet(path)
        )
        names = self._folders.children(path)
        if "known=false" in names:
            self._runs.append(_Run(0, f"{path}/known=false"))
        if "known=true" in names:
            self._counts.append(f"{path}/known=true")
        self._compact()

    def _compact(self) -> None:
        """Merge the runs of a level as long as one has enough of them."""
        level = 0
        while self._runs and level <= max(run.level for run in self._runs):
            own = [run for run in self._runs if run.level == level]
            if len(own) >= self._fanout:
                path = self._path()
                (
                    self._read([run.path for run in own])
                    .hint("rebalance", *_HASH)
                    .sortWithinPartitions(*_HASH)
                    .write.parquet(path)
                )
                self._runs = [run for run in self._runs if run not in own]
                self._runs.append(_Run(level + 1, path))
                for run in own:  # read by nobody any more
                    self._folders.remove(run.path)
            level += 1

    def common(self, least: int = LEAST_DOCUMENTS) -> DataFrame | None:
        """``hash, check, holder`` of lines in at least ``least`` documents."""
        runs = self.runs()
        if runs is None:
            return None
        again = self._read(self._counts)
        if again is None:
            return runs.where(F.col("documents") >= least).select(*_HASH, "holder")
        later = again.groupBy(*_HASH).agg(F.sum("documents").alias("later"))
        found = runs.join(later, list(_HASH), "left")
        total = F.col("documents") + F.coalesce("later", F.lit(0))
        return found.where(total >= least).select(*_HASH, "holder")


# --- documents --------------------------------------------------------------------


def _long_lines(documents: DataFrame, id: str, text: str) -> DataFrame:
    """``id, own, place, hash, check``: all lines long enough to be common, one row each.

    ``own`` tells texts under one id apart.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    lines = documents.select(
        F.col(id).alias("id"),
        F.xxhash64(body).alias("own"),
        F.posexplode(F.transform(_lines(F.col(text)), _key)).alias("place", "key"),
    )
    return lines.where(F.length("key") >= LEAST_CHARS).select(
        "id",
        "own",
        "place",
        F.xxhash64("key").alias("hash"),
        F.xxhash64(F.lit(_HASH[1]), "key").alias("check"),
    )


def _batch(id: Column, bounds: list) -> Column:
    """Number of the batch of an id, the greatest ids first, no id last."""
    above = [F.when(id < bound, 1).otherwise(0) for bound in bounds]
    count = functools.reduce(lambda a, b: a + b, above, F.lit(0))
    return F.when(id.isNull(), len(bounds)).otherwise(count)


def common_lines(
    documents: DataFrame, id: str = "doc_id", text: str = "text", batches: int = BATCHES
) -> tuple[DataFrame, DataFrame | None]:
    """All long lines, and the hashes of the common ones with the id that keeps them.

    Ids are dealt to batches at estimated quantiles; where these lie decides no result.
    """
    spark = documents.sparkSession
    steps = [(step + 1) / batches for step in range(batches - 1)]
    bounds = []
    if steps:
        quantiles = F.percentile_approx(F.col(id), F.array(*map(F.lit, steps)), 1000)
        bounds = sorted(set(documents.select(quantiles.alias("q")).first().q or []))
    lines = stored(_long_lines(documents, id, text), "lines")
    index = LineRuns(spark)
    for number in range(len(bounds) + 1):
        own = lines.where(_batch(F.col("id"), bounds) == number)
        each = own.select("id", "own", *_HASH).distinct()
        index.add(
            each.groupBy(*_HASH).agg(
                F.count(F.lit(1)).alias("documents"), F.max("id").alias("holder")
            )
        )
    return lines, index.common()


def drop_common_lines(
    documents: DataFrame, id: str = "doc_id", text: str = "text", batches: int = BATCHES
) -> DataFrame:
    """``id, text, kept_text, n_lines, n_dropped``: every text without its common lines.

    The document with the greatest id that holds a common line keeps it, as often as it
    has it; in all others each such line goes. Rows of that id all keep it.
    """
    lines, common = common_lines(documents, id, text, batches)
    body = F.coalesce(F.col(text), F.lit(""))
    texts = documents.select(F.col(id).alias("id"), body.alias("text")).withColumn(
        "own", F.xxhash64("text")
    )
    if common is None:
        marked = texts.withColumn("gone", F.array().cast("array<int>"))
    else:
        common = stored(common, "common-lines")
        places = (
            lines.join(common, list(_HASH))
            .where(~F.col("id").eqNullSafe(F.col("holder")))
            .groupBy("id", "own")
            .agg(F.collect_set("place").alias("gone"))
            .select(F.col("id").alias("gone_id"), F.col("own").alias("gone_own"), "gone")
        )
        same = F.col("id").eqNullSafe(F.col("gone_id")) & (F.col("own") == F.col("gone_own"))
        marked = texts.join(places, same, "left").drop("gone_id", "gone_own")
    return marked.select(
        "id",
        "text",
        F.when(F.col("gone").isNull(), F.col("text")).otherwise(_without("text", "gone")).alias("kept_text"),
        F.size(F.split("text", "\n", -1)).cast("long").alias("n_lines"),
        F.coalesce(F.array_size("gone"), F.lit(0)).cast("long").alias("n_dropped"),
    )


def _without(text: str, gone: str) -> Column:
    """A text without the lines at some places.

    The difference of two arrays of numbers is found by hashing, so the cost follows the
    number of lines even where thousands go.
    """
    return F.expr(
        f"""array_join(get(transform(array(split({text}, '\\n', -1)), l ->
              transform(array_except(sequence(0, size(l) - 1), {gone}), p -> get(l, p))), 0), '\\n')"""
    )


def digests(documents: DataFrame) -> DataFrame:
    """One row per document: lines before, lines dropped, digest of what is kept."""
    return drop_common_lines(documents).select(
        "id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256")
    )


ORACLE = f"""WITH lines AS (
  SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS place
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)),
keyed AS (
  SELECT doc_id, place, line, translate(
    trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    '{_UPPER}', '{_UPPER.lower()}') AS key
  FROM lines),
common AS (
  SELECT key, max(doc_id) AS holder FROM keyed WHERE length(key) >= {LEAST_CHARS}
  GROUP BY key HAVING count(DISTINCT doc_id) >= {LEAST_DOCUMENTS}),
marked AS (
  SELECT k.doc_id, place, line, holder IS NOT NULL AND holder <> k.doc_id AS gone
  FROM keyed k LEFT JOIN common c ON k.key = c.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id"""
