"""Quality by perplexity: an interpolated modified Kneser-Ney model of trusted text.

The model predicts a byte from the four before it. Counts of trusted five-grams and all
that follows from them (lower orders, discounts, back-off weights, shares) are tables joined
by n-gram, as large as the texts make them. Texts are scored by a join with those tables:
they are put into blocks, a block asks for each of its distinct n-grams once, however often
it holds them, and the answers come back to the block. So an n-gram that fills a third of
all texts is still one row of a block.

Two thirds of the trusted texts are counted. A text's surprise per byte is held against a
quantile among the others, which the model has not seen, in its language.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.llm.slices import MARK, buffers, joined, text_bytes
from logloom.llm.tables import bucketed, sent_if_small, stored

#: Bytes of an n-gram, the predicted one included. With its order above them they are its key.
ORDER = 5
KEY_BITS = 8 * ORDER
#: Texts are put into blocks of about so many bytes; a longer text is its own block.
BLOCK_BYTES = 32 << 20
#: Its n-grams are counted in parts of about so many.
PART_BYTES = 1 << 20
#: How hard texts are compressed while they wait for answers.
LEVEL = 12
#: Logarithms travel in steps of 1/1024 bit; ``NONE`` stands for null.
FINE, NONE = 1024, 0xFFFF
#: Quantiles of the trusted texts of a language between which a text stays. A surprise far
#: below that of any prose means endless repetition.
QUANTILES = (0.0005, 0.995)
#: One in so many trusted texts is not counted and gives the upper quantile.
HELD_OUT = 3
#: So many bytes of the language's mean surprise are added to every text, as a short
#: text's own mean says little.
PRIOR_BYTES = 100


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams that end in a byte of a text or in the mark after it, and where each
    text's own begin, then the end. Before a text there are only marks."""
    data, begins = joined(texts)
    data = data[:-4].astype(np.int64)
    codes, after = data[1:].copy(), data[:-1]
    for step in range(1, ORDER):
        codes |= after << 8 * step
        before = np.concatenate(([MARK] * step, data[: -step - 1]))
        after = np.where(after == MARK, MARK, before)
    return codes, begins - 1


def _suffix(codes: np.ndarray, size: int) -> np.ndarray:
    """Keys of the last ``size`` bytes."""
    return codes & ((1 << 8 * size) - 1) | size << KEY_BITS


def _context(codes: np.ndarray, size: int) -> np.ndarray:
    """Keys of the ``size`` bytes before the last one."""
    return _suffix(codes >> 8, size)


def _packed(keys: np.ndarray) -> bytes:
    """Sorted n-grams as compressed steps from one to the next."""
    return zstandard.compress(np.diff(keys, prepend=0).tobytes())


def _unpacked(keys: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zstandard.decompress(keys), np.int64))


# --- blocks ----------------------------------------------------------------------


def blocks(documents: DataFrame) -> DataFrame:
    """One row per block: its texts, compressed, their ids, and its distinct n-grams, sorted,
    with how often they occur in texts to count.

    ``documents`` has ``id, text_key, lang, trusted, counted, text``.
    """
    columns = ["id", "text_key", "lang", "trusted"]
    kinds = [documents.schema[name].dataType.simpleString() for name in columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held: list[pa.RecordBatch] = []
        texts: list[bytes] = []
        size = 0

        def block() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held).combine_chunks()
            counted = rows.column("counted").to_pylist()
            distinct, counts = [], []
            for part in buffers(texts, PART_BYTES):
                codes, begins = grams(texts[part])
                kinds_here = np.unique(codes)
                seen = np.repeat(np.array(counted[part], bool), np.diff(begins))
                own, times = np.unique(codes[seen], return_counts=True)
                each = np.zeros(len(kinds_here), np.int64)
                each[np.searchsorted(kinds_here, own)] = times
                distinct.append(kinds_here)
                counts.append(each)
            keys, place = np.unique(np.concatenate(distinct), return_inverse=True)
            times = np.bincount(place, np.concatenate(counts), len(keys)).astype(np.int64)
            lists = [
                pa.ListArray.from_arrays([0, len(rows)], rows.column(name).combine_chunks())
                for name in columns
            ]
            body = zstandard.compress(bytes([MARK]).join(texts), LEVEL)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([number], pa.int64()),
                    *lists,
                    pa.array([body], pa.binary()),
                    pa.array([_packed(keys)], pa.binary()),
                    pa.array([zstandard.compress(times.tobytes())], pa.binary()),
                ],
                ["block", *columns, "texts", "keys", "counts"],
            )

        for batch in batches:
            own = text_bytes(batch.column("text"))
            slim = batch.drop_columns(["text"])
            for part in buffers(own, PART_BYTES):
                held.append(slim.slice(part.start, part.stop - part.start))
                texts += own[part]
                size += sum(map(len, own[part]))
                if size >= BLOCK_BYTES:
                    yield block()
                    number += 1
                    held, texts, size = [], [], 0
        if texts:
            yield block()

    lists = ", ".join(f"{name} array<{kind}>" for name, kind in zip(columns, kinds))
    schema = f"block bigint, {lists}, texts binary, keys binary, counts binary"
    return documents.select(*columns, "counted", "text").mapInArrow(run, schema)


def count_grams(held: DataFrame) -> DataFrame:
    """``key, n`` of the n-grams of texts to count, over all blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, counts in zip(*(column.to_pylist() for column in batch.columns)):
                codes = _unpacked(keys)
                times = np.frombuffer(zstandard.decompress(counts), np.int64)
                seen = times > 0
                yield pa.RecordBatch.from_arrays(
                    [pa.array(_suffix(codes[seen], ORDER)), pa.array(times[seen])], ["key", "n"]
                )

    counts = held.select("keys", "counts").mapInArrow(run, "key bigint, n bigint")
    return counts.groupBy("key").agg(F.sum("n").alias("n"))


def asked(held: DataFrame) -> DataFrame:
    """``block, key``: every n-gram and every context, of each order, that a block needs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, keys in zip(*(column.to_pylist() for column in batch.columns)):
                codes = _unpacked(keys)
                wanted = [np.zeros(1, np.int64), _suffix(codes, ORDER)]
                for size in range(1, ORDER):
                    both = np.concatenate((_suffix(codes, size), _context(codes, size)))
                    wanted.append(np.unique(both))
                for part in wanted:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(part), block)), pa.array(part)], ["block", "key"]
                    )

    return held.select("block", "keys").mapInArrow(run, "block bigint, key bigint")


# --- the model -------------------------------------------------------------------


def discounts(counts: DataFrame) -> list[float]:
    """What to take off counts of one, two and more, from how many counts are 1 to 4."""
    times = {row["n"]: row["count"] for row in counts.where("n <= 4").groupBy("n").count().collect()}
    one, two, three, four = (times.get(n, 0) for n in (1, 2, 3, 4))
    if not (one and two and three and four):
        return [0.5, 0.75, 0.9]
    share = one / (one + 2 * two)
    raw = [1 - 2 * share * two / one, 2 - 3 * share * three / two, 3 - 4 * share * four / three]
    return [min(max(value, 0.05), limit) for value, limit in zip(raw, (0.95, 1.95, 2.95))]


def _cut(key: str, size: int, skip: int = 0) -> Column:
    """Key of the last ``size`` bytes but the last ``skip``."""
    bytes_ = F.shiftright(F.col(key), 8 * skip).bitwiseAND((1 << 8 * size) - 1)
    return bytes_.bitwiseOR(F.lit(size << KEY_BITS))


def train(counts: DataFrame) -> DataFrame:
    """``key, p, rest`` from ``key, n`` of the longest n-grams.

    ``p`` is the probability of the n-gram's last byte after the others, null where it was
    never seen there; ``rest`` the weight of the next shorter context after the whole
    n-gram, null where nothing was seen after it. Lower orders count in how many
    contexts a byte was seen, as Kneser-Ney asks. Key 0 has the uniform share.
    """
    spark = counts.sparkSession
    by_order = {ORDER: counts}
    for size in range(ORDER - 1, 0, -1):
        shorter = by_order[size + 1].groupBy(_cut("key", size).alias("key"))
        by_order[size] = stored(shorter.agg(F.count("*").alias("n")), f"grams{size}")

    levels = []
    below = spark.range(1).select(F.col("id").alias("key"), F.lit(1 / 256).alias("p"))
    for size in range(1, ORDER + 1):
        own = by_order[size]
        taken = F.element_at(
            F.array(*map(F.lit, discounts(own))), F.least("n", F.lit(3)).cast("int")
        )
        own = own.withColumn("context", _cut("key", size - 1, 1))
        contexts = own.groupBy("context").agg(
            F.sum("n").alias("total"), (F.sum(taken) / F.sum("n")).alias("rest")
        )
        weights = contexts.select(F.col("context").alias("key"), "rest")
        levels.append(below.join(weights, "key", "full"))
        shorter = below.select(F.col("key").alias("suffix"), F.col("p").alias("shorter"))
        share = F.greatest(F.col("n") - taken, F.lit(0.0)) / F.col("total")
        below = stored(
            own.join(contexts, "context")
            .withColumn("suffix", _cut("key", size - 1))
            .join(shorter, "suffix")
            .select("key", (share + F.col("rest") * F.col("shorter")).alias("p")),
            f"shares{size}",
        )
    levels.append(below.withColumn("rest", F.lit(None).cast("double")))
    return reduce(DataFrame.unionByName, levels)


# --- scoring ---------------------------------------------------------------------


def answers(held: DataFrame, model: DataFrame) -> DataFrame:
    """``block, keys, p, rest``: what the model knows of a block's n-grams, many in a row.

    Shares and weights come as 16-bit logarithms.
    """

    def small(name: str) -> Column:
        bits = F.round(-F.log2(name) * FINE).cast("int")
        return F.coalesce(F.least(bits, F.lit(NONE - 1)), F.lit(NONE)).alias(name)

    def packed(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(batches)
        block, key, p, rest = (column.to_numpy() for column in rows.columns)
        order = np.lexsort((key, block))
        block, key = block[order], key[order]
        p, rest = p[order].astype(np.uint16), rest[order].astype(np.uint16)
        begins = np.flatnonzero(np.diff(block, prepend=-1))
        for begin, end in zip(begins, [*begins[1:], len(block)]):
            parts = [
                _packed(key[begin:end]),
                zstandard.compress(p[begin:end].tobytes()),
                zstandard.compress(rest[begin:end].tobytes()),
            ]
            yield pa.RecordBatch.from_arrays(
                [pa.array(block[begin : begin + 1]), *(pa.array([part]) for part in parts)],
                ["block", "keys", "p", "rest"],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size = [], 0
        for batch in batches:
            if batch.num_rows:
                waiting.append(batch)
                size += batch.num_rows
            if size >= PART_BYTES:
                yield from packed(waiting)
                waiting, size = [], 0
        if waiting:
            yield from packed(waiting)

    known = asked(held).join(model.select("key", small("p"), small("rest")), "key")
    return known.select("block", "key", "p", "rest").mapInArrow(
        run, "block bigint, keys binary, p binary, rest binary"
    )


def _bits(codes: np.ndarray, keys: np.ndarray, p: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """Surprise of each n-gram's last byte, from the model's rows sorted by key."""

    def find(wanted: np.ndarray, values: np.ndarray) -> np.ndarray:
        place = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where(keys[place] == wanted, values[place], NONE)

    bits = np.full(len(codes), 8 * FINE)
    for size in range(1, ORDER + 1):
        weight = find(_context(codes, size - 1), rest)
        longer = find(_suffix(codes, size), p)
        bits = np.where(longer < NONE, longer, bits + np.where(weight < NONE, weight, 0))
    return bits / FINE


def surprise(held: DataFrame, model: DataFrame) -> DataFrame:
    """``id, text_key, lang, trusted, n_bytes, bits``: what the model needs to spell each text."""
    kinds = {field.name: field.dataType for field in held.schema.fields}
    columns = ["id", "text_key", "lang", "trusted"]

    def run(own: pa.Table, known: pa.Table) -> pa.Table:
        row = own.combine_chunks()
        rows = known.to_pylist()  # key 0 is always answered
        keys = np.concatenate([_unpacked(part["keys"]) for part in rows])
        order = np.argsort(keys)
        p, rest = (
            np.concatenate(
                [np.frombuffer(zstandard.decompress(part[name]), np.uint16) for part in rows]
            ).astype(np.int64)[order]
            for name in ("p", "rest")
        )
        distinct = _unpacked(row.column("keys")[0].as_py())
        bits = _bits(distinct, keys[order], p, rest)
        texts = zstandard.decompress(row.column("texts")[0].as_py())
        texts = texts.split(bytes([MARK]))
        sizes, sums = [], []
        for part in buffers(texts, PART_BYTES):
            codes, begins = grams(texts[part])
            sizes.append(np.diff(begins) - 1)
            sums.append(np.add.reduceat(bits[np.searchsorted(distinct, codes)], begins[:-1]))
        lists = [row.column(name).combine_chunks().flatten() for name in columns]
        # Workers live on for later stages; what Arrow keeps for itself goes back.
        pa.default_memory_pool().release_unused()
        return pa.Table.from_arrays(
            [*lists, pa.array(np.concatenate(sizes)), pa.array(np.concatenate(sums))],
            [*columns, "n_bytes", "bits"],
        )

    schema = ", ".join(f"{name} {kinds[name].elementType.simpleString()}" for name in columns)
    both = held.drop("counts").groupBy("block").cogroup(answers(held, model).groupBy("block"))
    return both.applyInArrow(run, schema + ", n_bytes bigint, bits double")


def classify(
    documents: DataFrame,
    labels: DataFrame,
    quantiles: tuple[float, float] = QUANTILES,
    id: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
) -> DataFrame:
    """Perplexity of every text and whether it is low enough to stay.

    ``labels`` has ``doc_id, quality``; texts labelled 1 are trusted. Returns ``id, text_key,
    lang, n_bytes, perplexity, score, floor, threshold, kept``. The score is the mean surprise with
    the language's mean added as so many bytes; a text stays from ``floor``, a quantile among
    all trusted texts of the language, to ``threshold``, one among those not counted (among all
    where none was left out). A language (or null) without trusted texts takes the quantiles of
    all languages; without any trusted text nothing is rejected. Null and empty texts score
    their language's mean and stay. Repeated rows get equal results; texts are read whole; an
    empty table gives none.
    """
    trusted = (
        labels.where("quality = 1 AND doc_id IS NOT NULL")
        .select(F.col("doc_id").alias("trusted_id"))
        .distinct()
    )
    texts = documents.select(
        F.col(id).alias("id"),
        F.xxhash64(text).alias("text_key"),
        F.col(lang).alias("lang"),
        F.col(text).alias("text"),
    )
    held_out = F.pmod("text_key", F.lit(HELD_OUT)) == 0
    marked = (
        texts.join(sent_if_small(trusted), texts["id"] == F.col("trusted_id"), "left")
        .withColumn("trusted", F.col("trusted_id").isNotNull())
        .withColumn("counted", F.col("trusted") & ~held_out)
    )
    # In buckets, so that answers go to the blocks' texts and these stay where they are.
    with bucketed(blocks(marked), "block", "blocks", compression="zstd") as held:
        model = train(stored(count_grams(held), "grams"))
        scores = stored(surprise(held, model), "surprise")

    known = scores.where("trusted")
    size = F.col("n_bytes") + 1
    overall = known.agg((F.sum("bits") / F.sum(size)).alias("mean")).first()["mean"]
    means = known.groupBy(F.col("lang").alias("l")).agg((F.sum("bits") / F.sum(size)).alias("mean"))
    prior = F.coalesce("mean", F.lit(overall), F.lit(0.0)) * PRIOR_BYTES
    same_lang = F.col("lang").eqNullSafe(F.col("l"))
    scored = scores.join(means, same_lang, "left").withColumn(
        "score", (F.col("bits") + prior) / (size + PRIOR_BYTES)
    )
    scored = stored(scored.drop("l", "mean"), "scored")

    def quantile(values: Column, share: float) -> Column:
        return F.percentile_approx(values, share, 10_000)

    limits = (
        quantile(F.col("score"), quantiles[0]).alias("low"),
        F.coalesce(
            quantile(F.when(held_out, F.col("score")), quantiles[1]),
            quantile(F.col("score"), quantiles[1]),
        ).alias("high"),
    )
    known = scored.where("trusted")
    everywhere = known.agg(*limits).first()
    own = known.groupBy(F.col("lang").alias("l")).agg(*limits)
    low = F.coalesce("low", F.lit(everywhere["low"]), F.lit(-np.inf))
    high = F.coalesce("high", F.lit(everywhere["high"]), F.lit(np.inf))
    return scored.join(own, same_lang, "left").select(
        "id",
        "text_key",
        "lang",
        "n_bytes",
        F.pow(F.lit(2.0), F.col("bits") / size).alias("perplexity"),
        "score",
        low.alias("floor"),
        high.alias("threshold"),
        F.col("score").between(low, high).alias("kept"),
    )


def without_low_quality(
    documents: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """The rows of ``documents`` that are not rejected, all columns as they are, whatever
    further columns are called. Rows with a null id or text are judged like others."""
    rejected = classify(documents, labels, id=id, text=text).where("NOT kept")
    rejected = rejected.select("id", "text_key").distinct().alias("rejected")
    rows = documents.alias("rows")
    same = F.col(f"rows.`{id}`").eqNullSafe(F.col("rejected.id")) & (
        F.xxhash64(F.col(f"rows.`{text}`")) == F.col("rejected.text_key")
    )
    return rows.join(rejected, same, "left_anti")
