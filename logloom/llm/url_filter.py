"""URL filter: a block list as a sorted array of 64-bit digests that tasks map into memory.

The list is written once, as one file in the shared folder: sorted xxhash64 digests, then
the full names. Spark hands the file to every executor, where tasks map it and probe it
with binary searches for a whole batch; a digest that is found counts only if the name
stored beside it is the same. Rules for hosts and paths go before the list.
"""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from logloom.session import scratch_path

#: Names in a list that is handed to every executor; a longer one is joined.
MAPPED_NAMES = 20_000_000

#: Verdict, host and path of the rules.
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)


def host(url: str) -> Column:
    """After the first ``://``, up to ``/ ? #`` or the end, A-Z in lower case; else empty."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://([^/?#]*)", 1)
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(found, capitals, capitals.lower())


def path(url: str) -> Column:
    """After the host, up to ``? #`` or the end; empty without ``://``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def rule(rules: Iterable[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits columns ``host`` and ``path``."""
    ordered = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for decision, domain, start in reversed(ordered):
        fits = (
            (F.col("host") == domain) | F.col("host").endswith(f".{domain}")
        ) & F.col("path").startswith(start)
        name = F.when(fits, f"{domain}{start}").otherwise(name)
        verdict = F.when(fits, decision).otherwise(verdict)
    return name, verdict


def parents(name: str) -> list[str]:
    """A host and the domains it lies in, the longest first."""
    labels = name.split(".")
    return [".".join(labels[start:]) for start in range(len(labels))]


class DigestArray:
    """A sorted digest array in a file: count, digests, offsets of the names, names."""

    def __init__(self, file: str) -> None:
        count = int(np.memmap(file, "<i8", "r", shape=(1,))[0])
        self._digests = np.memmap(file, "<u8", "r", 8, (count,)) if count else np.zeros(0, "<u8")
        self._starts = np.memmap(file, "<i8", "r", 8 + 8 * count, (count + 1,))
        begin = 16 + 16 * count
        size = int(self._starts[-1])
        self._names = np.memmap(file, "u1", "r", begin, (size,)) if size else np.zeros(0, "u1")

    @staticmethod
    def pack(names: Iterable[str]) -> bytes:
        rows = sorted((xxhash.xxh64_intdigest(raw), raw) for raw in {n.encode() for n in names})
        sizes = np.cumsum([0, *(len(raw) for _, raw in rows)])
        return b"".join(
            (
                np.array([len(rows)], "<i8").tobytes(),
                np.array([digest for digest, _ in rows], "<u8").tobytes(),
                sizes.astype("<i8").tobytes(),
                *(raw for _, raw in rows),
            )
        )

    def contains(self, names: list[str]) -> np.ndarray:
        """Whether each name is in the list."""
        raw = [name.encode() for name in names]
        digests = np.array([xxhash.xxh64_intdigest(name) for name in raw], np.uint64)
        place = np.searchsorted(self._digests, digests)
        end = np.searchsorted(self._digests, digests, side="right")
        found = np.zeros(len(names), bool)
        for number in np.flatnonzero(place < end):
            for slot in range(place[number], end[number]):
                name = self._names[self._starts[slot] : self._starts[slot + 1]]
                found[number] |= name.tobytes() == raw[number]
        return found


def _shared_file(spark: SparkSession, data: bytes) -> str:
    """Writes the file to the shared folder and has Spark hand it to the executors."""
    target = f"{scratch_path(spark, 'digests')}.bin"
    where = spark._jvm.org.apache.hadoop.fs.Path(target)
    out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where)
    out.write(data)
    out.close()
    spark.sparkContext.addFile(target)
    return os.path.basename(target)


def listed(urls: DataFrame, names: DataFrame, mapped: int = MAPPED_NAMES) -> DataFrame:
    """Adds ``listed``: whether the column ``host`` or a domain it lies in is in ``names``.

    ``names`` has one column of host names. Up to ``mapped`` of them go into the digest
    array; more are joined with the distinct hosts, with the same result.
    """
    spark = urls.sparkSession
    names = names.toDF("name").where("name IS NOT NULL").distinct()
    if names.count() > mapped:
        hosts = urls.select("host").distinct()
        labels = F.split("host", r"\.")
        domains = F.transform(
            F.sequence(F.lit(1), F.size(labels)),
            lambda start: F.array_join(F.slice(labels, start, F.size(labels)), "."),
        )
        found = (
            hosts.select("host", F.explode(domains).alias("name"))
            .join(names, "name", "left_semi")
            .select("host", F.lit(True).alias("listed"))
            .distinct()
        )
        return urls.join(found, "host", "left").withColumn(
            "listed", F.coalesce("listed", F.lit(False))
        )
    file = _shared_file(spark, DigestArray.pack(row["name"] for row in names.toLocalIterator()))
    columns = urls.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        array = DigestArray(SparkFiles.get(file))
        for batch in batches:
            hosts = batch.column(columns.index("host")).dictionary_encode()
            own = [parents(name) for name in hosts.dictionary.to_pylist()]
            flat = array.contains([name for names in own for name in names])
            sizes = np.cumsum([0, *map(len, own)])
            by_host = [bool(flat[a:b].any()) for a, b in zip(sizes[:-1], sizes[1:])]
            flags = pc.take(pa.array(by_host, pa.bool_()), hosts.indices)
            yield pa.RecordBatch.from_arrays([*batch.columns, flags], [*columns, "listed"])

    schema = StructType([*urls.schema, StructField("listed", BooleanType())])
    return urls.mapInArrow(run, schema)


def judge(
    pages: DataFrame, names: DataFrame, id: str = "page_id", url: str = "url",
    mapped: int = MAPPED_NAMES,
) -> DataFrame:
    """``id, host, path, rule, verdict`` of every url.

    The longest rule that fits decides; without one, a host in ``names`` or under one is
    blocked and any other allowed. A null url and one without ``://`` have an empty host
    and path and are allowed. Repeated rows stay; other columns are not read; an empty
    table gives no rows.
    """
    parts = pages.select(F.col(id).alias("id"), host(url).alias("host"), path(url).alias("path"))
    name, verdict = rule()
    by_list = F.when(F.col("listed"), "block").otherwise("allow")
    return listed(parts, names, mapped).select(
        "id", "host", "path", name.alias("rule"), F.coalesce(verdict, by_list).alias("verdict")
    )


# --- the list of the registered query ------------------------------------------------

#: Words that name a host's trade; a host is listed for any of them.
TRADES = ("spam", "casino", "adult", "pills", "bets", "ads")


def listed_hosts(pages: DataFrame, url: str = "url") -> DataFrame:
    """Hosts of the table that have such a word between dots and dashes."""
    words = F.split("name", r"[.-]")
    trades = F.array(*map(F.lit, TRADES))
    return (
        pages.select(host(url).alias("name")).distinct().where(F.arrays_overlap(words, trades))
    )


ORACLE = r"""
WITH parts AS (
  SELECT page_id,
         CASE WHEN contains(url, '://') THEN translate(regexp_extract(
           substr(url, strpos(url, '://') + 3), '^[^/?#]*'),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
         CASE WHEN contains(url, '://') THEN regexp_extract(
           substr(url, strpos(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM pages),
ruled AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%'
      THEN 'example.net/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%'
      THEN 'example.com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule
  FROM parts)
SELECT page_id, host, path, rule, CASE
  WHEN rule IN ('net/', 'example.com/de/') THEN 'block'
  WHEN rule IS NOT NULL THEN 'allow'
  WHEN list_has_any(regexp_split_to_array(host, '[.-]'),
                    ['spam', 'casino', 'adult', 'pills', 'bets', 'ads']) THEN 'block'
  ELSE 'allow' END AS verdict
FROM ruled
"""
