"""Exact duplicates by an extendible-hash index on shared files.

Texts are keyed by a 64-bit hash of their bytes without white space. The index has one
entry per distinct text, made before any row is shuffled by its key, so a text that a
third of all rows share is one entry. A directory over the leading bits of the keys
doubles until no bucket is overfull, unless all its keys are equal; the index is written
in key ranges, each owned by a task. Entries with one key are a chain. Every row takes its
bucket from the directory, meets the entries of its key there and walks the chain to its
own. Where an entry stands for several rows, their bytes are compared with the bytes of one
of them; rows that differ after all become entries of their own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logloom.llm.tables import stored

#: White space that does not count in a comparison.
WHITE = r"[\x20\x09-\x0D]+"
Key = Callable[[Column], Column]
#: Leading bits that the directory can use.
DEPTH = 62
#: Entries per bucket before it splits.
BUCKET = 100_000


def normalised(text: str | Column) -> Column:
    """The text without white space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, "")


def _leading(key: str | Column, bits: int | Column) -> Column:
    """The leading bits of a 64-bit key, from 0 on."""
    # Two steps, as a shift by all 64 bits would be none.
    half = F.call_function("shiftrightunsigned", key if isinstance(key, Column) else F.col(key), F.lit(1))
    return F.call_function("shiftrightunsigned", half, (F.lit(63) - bits).cast("int"))


def directory(entries: DataFrame, bucket: int = BUCKET) -> tuple[DataFrame, int]:
    """``cell, bucket`` for the leading bits of all keys, and how many bits these are.

    ``entries`` has ``key``. The directory doubles while a cell holds more than ``bucket``
    entries whose keys differ. Cells that need not be told apart share a bucket: that of the
    fewest leading bits with which it isn't overfull. Buckets are numbered by these bits
    behind a one. The driver gets counts; cells are about twice ``entries / bucket`` in number.
    """

    def full(rows: DataFrame) -> Column:
        return (F.col("n") > bucket) & (F.col("least") < F.col("most"))

    def counted(depth: int) -> DataFrame:
        return entries.groupBy(_leading("key", F.lit(depth)).alias("cell")).agg(
            F.count("*").alias("n"), F.min("key").alias("least"), F.max("key").alias("most")
        )

    depth = min((entries.count() // bucket).bit_length(), DEPTH)
    cells = stored(counted(depth), "cells")
    while depth < DEPTH and not cells.where(full(cells)).isEmpty():
        depth += 1
        cells = stored(counted(depth), "cells")

    above = cells.select(
        "*", F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("bits")
    ).select("*", F.call_function("shiftrightunsigned", "cell", F.lit(depth) - F.col("bits")).alias("prefix"))
    sums = above.groupBy("bits", "prefix").agg(
        F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most")
    )
    fitting = sums.where(~full(sums) | (F.col("bits") == depth)).select("bits", "prefix")
    number = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bits")) + F.col("prefix")
    found = (
        above.select("cell", "bits", "prefix")
        .join(fitting, ["bits", "prefix"])
        .groupBy("cell")
        .agg(F.min_by(number, "bits").alias("bucket"))
    )
    return stored(found, "directory"), depth


def build_index(rows: DataFrame, bucket: int = BUCKET) -> tuple[DataFrame, DataFrame, int]:
    """One entry per distinct text, ``bucket, key, chain, sha256, rows, head``; the directory.

    ``rows`` has ``id, n_chars, key, sha256``; ``head`` orders rows by what stays. ``chain``
    numbers the entries of one key from 1 on.
    """
    entries = stored(
        rows.groupBy("key", "sha256").agg(F.count("*").alias("rows"), F.min(_order()).alias("head")),
        "entries",
    )
    cells, depth = directory(entries, bucket)
    chained = entries.withColumn(
        "chain", F.row_number().over(Window.partitionBy("key").orderBy("sha256"))
    )
    index = _placed(chained, cells, depth)
    index = stored(
        index.repartitionByRange("bucket", "key").sortWithinPartitions("bucket", "key", "chain"),
        "index",
    )
    return index, cells, depth


def _placed(rows: DataFrame, cells: DataFrame, depth: int) -> DataFrame:
    """Rows with the ``bucket`` that the directory names for their ``key``."""
    return rows.withColumn("cell", _leading("key", F.lit(depth))).join(cells, "cell").drop("cell")


def _order() -> Column:
    """Least for the row that stays: most code points, then the least id that is not null."""
    return F.struct(
        (-F.col("n_chars")).alias("fewer"), F.col("id").isNull().alias("unnamed"), "id"
    )


def exact_duplicates(
    documents: DataFrame, id: str = "doc_id", text: str = "text", key: Key = F.xxhash64,
    bucket: int = BUCKET,
) -> DataFrame:
    """Every row with the row that stays of its equals.

    Returns ``id, text_key, keep_id, group_size, kept, text_sha256``: a hash of the original
    text, the id of the row that stays, how many rows are equal, whether this one stays
    (its id is ``keep_id``) and the digest of the text without white space. Null, empty and
    blank texts are equal to each other. Repeated rows are kept or not together. A row
    without an id stays only if no equal row as long has one. Texts of any length are
    compared whole; other columns are not read; an empty table gives no rows. ``key`` hashes
    the bare text to 64 bits, ``bucket`` is how many entries a bucket holds before it splits;
    neither changes the result.
    """
    whole = documents.select(
        F.col(id).alias("id"),
        F.xxhash64(text).alias("text_key"),
        F.length(F.coalesce(text, F.lit(""))).cast("long").alias("n_chars"),
        normalised(text).alias("bare"),
    ).select("*", key(F.col("bare")).alias("key"), F.sha2("bare", 256).alias("sha256"))
    rows = stored(whole.drop("bare"), "keyed")
    index, cells, depth = build_index(rows, bucket)

    def probed(frame: DataFrame, entries: DataFrame) -> DataFrame:
        """Rows with their own entry: bucket by the directory, then key, then the chain."""
        chains = entries.withColumnRenamed("sha256", "own")
        return (
            _placed(frame, cells, depth)
            .join(chains, ["bucket", "key"])
            .where(F.col("own") == F.col("sha256"))
            .drop("own")
        )

    single = probed(rows, index.where("rows = 1").select("bucket", "key", "sha256", "chain", "rows", "head"))

    entry = ["bucket", "key", "chain"]
    members = stored(probed(whole, index.where("rows > 1").select(*entry, "sha256")), "members")
    # Heads and groups are read from files, so that a join can split the rows of one entry.
    first = stored(members.groupBy(*entry).agg(F.min("bare").alias("first")), "heads")
    compared = members.join(first, entry).select(
        "id", "text_key", "n_chars", *entry, "sha256",
        F.when(F.col("bare") != F.col("first"), F.col("bare")).alias("other"),
    )
    compared = stored(compared, "compared")
    groups = compared.groupBy(*entry, "other").agg(
        F.count("*").alias("rows"), F.min(_order()).alias("head")
    )
    groups = stored(groups.withColumnsRenamed({name: f"its_{name}" for name in [*entry, "other"]}), "groups")
    equal = F.col("other").eqNullSafe(F.col("its_other"))
    for name in entry:
        equal = (F.col(name) == F.col(f"its_{name}")) & equal
    several = compared.join(groups, equal)

    columns = ["id", "text_key", "sha256", "rows", "head"]
    return (
        single.select(columns)
        .unionByName(several.select(columns))
        .select(
            "id",
            "text_key",
            F.col("head.id").alias("keep_id"),
            F.col("rows").alias("group_size"),
            F.col("id").eqNullSafe(F.col("head.id")).alias("kept"),
            F.col("sha256").alias("text_sha256"),
        )
    )


def without_exact_duplicates(
    documents: DataFrame, id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """The rows of ``documents`` that stay, all columns as they are, whatever they are called."""
    dropped = exact_duplicates(documents, id, text).where("NOT kept")
    dropped = dropped.select("id", "text_key").distinct().alias("dropped")
    rows = documents.alias("rows")
    same = F.col(f"rows.`{id}`").eqNullSafe(F.col("dropped.id")) & (
        F.xxhash64(F.col(f"rows.`{text}`")) == F.col("dropped.text_key")
    )
    return rows.join(dropped, same, "left_anti")


#: The same rows by window functions.
ORACLE = r"""
WITH bare AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_chars,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS bare
  FROM documents),
heads AS (
  SELECT doc_id, bare, count(*) OVER (PARTITION BY bare) AS group_size,
         first_value(doc_id) OVER (PARTITION BY bare ORDER BY n_chars DESC, doc_id) AS keep_id
  FROM bare)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(bare) AS text_sha256
FROM heads
"""
