"""Phrases whose words come together more often than alone, mined through indexes of shards.

Texts become shards of some 800,000 words. A shard's index holds the last column of its
sorted rotations (the Burrows-Wheeler transform) and the same of the reversed shard, both
sorted as deep as the longest phrase asks for. A phrase is a pair of intervals, one in each;
a step to the right splits the reversed interval by its symbols and keeps the other in
step, a step to the left splits the forward interval. The indexes are written once. Words,
pairs and longer phrases are then counted level by level, summed over the shards by Spark.

A phrase can only be frequent if both phrases one word shorter are. Each level therefore
carries a filter of the frequent phrases of the level below into the shards: bits of a
table of fixed size (8 MB), set by hashes. A clash of hashes only lets a rare phrase
through to be counted, so the table's size affects the work and never the result.

A null text is empty, a null language is ``und``. Rows may repeat or share an id: each
counts. Empty tables give no rows. Only the columns of text and language are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.llm.slices import ranges, spread, text_bytes
from logloom.llm.tables import stored

MAX_WORDS = 3
LEAST_COUNT = 10
#: A longer phrase with at least this share (in percent) of its part's count replaces it.
ABSORBS_PERCENT = 50
TOP = 2000

#: Words and ends of pieces in a shard, about.
SHARD_WORDS = 3 << 18
#: Rows that a task hands to Python at once: a shard's row has some megabytes.
_DOCUMENTS_AT_ONCE = 500
_SHARDS_AT_ONCE = 1
#: A task counts so many together, if that leaves all cores work: fewer rows are shuffled.
_SHARDS_MERGED = 8
#: Spark's reader decodes thousands of a row group's rows at once, and its writer looks at a
#: row group's size after a hundred: each shard gets a row group, however many a task has.
_INDEX_FILES = {"compression": "zstd", "parquet.block.row.count.limit": "1"}
#: Bits of the filter, as a power of two.
_FILTER_BITS = 26
_BUCKET_BITS = 15  # Spark's bitmap functions put 2^15 bits into one row

#: Ends of pieces become line feeds, and both kinds of space between words one.
_TABLE = bytes.maketrans(b".,;:!?\x0b\x0c\r\t", b"\n" * 9 + b" ")
_END = 0


# --- the index of a shard -----------------------------------------------------------


def rotation_order(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Places in the order of the ``depth`` or more symbols from there on, in a circle."""
    keys, width = symbols.astype(np.int64), 1
    while width < depth:
        if width > 1:  # numbers of pairs of ranks must fit 64 bits
            keys = np.unique(keys, return_inverse=True)[1]
        keys = keys * (int(keys.max()) + 1) + np.roll(keys, -width)
        width *= 2
    return np.argsort(keys)


class Index:
    """Both transforms of a shard; symbol 0 ends a piece, others are words."""

    def __init__(self, forward: np.ndarray, backward: np.ndarray) -> None:
        self.forward = forward
        self.backward = backward

    @classmethod
    def build(cls, symbols: np.ndarray, max_words: int = MAX_WORDS) -> Index:
        """Phrases grow right from one word and then left, so the forward side is sorted
        by all but one of a phrase's words, and the reversed side by one."""
        ahead = rotation_order(symbols, max_words - 1)
        behind = np.argsort(symbols, kind="stable")
        return cls(symbols[ahead - 1], symbols[(behind + 1) % len(symbols)])

    def words(self, size: int) -> Phrases:
        """Phrases of one word, one for each of ``size`` symbols."""
        counts = np.bincount(self.backward, minlength=size)
        starts = np.cumsum(counts) - counts
        return Phrases(np.arange(size)[:, None], starts, counts)

    def right(self, words: Phrases, size: int) -> Phrases:
        """All pairs of neighbouring symbols, with their intervals on the forward side.

        The reversed side's interval of a word lists what follows the word. Its symbols in
        order are the parts, in order, of the word's interval on the forward side.
        """
        first = np.repeat(np.arange(size, dtype=np.int64), words.counts)
        pairs, counts = np.unique(first * size + self.backward, return_counts=True)
        starts = np.cumsum(counts) - counts
        return Phrases(np.stack([pairs // size, pairs % size], 1), starts, counts)

    def left(self, phrases: Phrases, words: np.ndarray, last: bool) -> Phrases:
        """Phrases longer by one of some ``words`` (true by symbol) to the left.

        ``phrases`` are intervals of the forward side that share no place. Those of the
        ``last`` step grow no more, so their intervals are left out.
        """
        place = ranges(phrases.starts, phrases.counts)
        owner = np.repeat(np.arange(len(phrases.counts)), phrases.counts)
        kept = words[self.forward[place]]
        place, owner = place[kept], owner[kept]
        size = len(words)
        found, counts = np.unique(owner * size + self.forward[place], return_counts=True)
        owner, symbol = found // size, found % size
        longer = np.concatenate([symbol[:, None], phrases.symbols[owner]], 1)
        starts = counts if last else self._starts(symbol, phrases.starts[owner])
        return Phrases(longer, starts, counts)

    def _starts(self, symbols: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Where rotations begin that put a symbol before those that begin at ``starts``.

        Before them come all rotations with smaller symbols, and those with the same one
        as often as it stands above ``starts`` in the transform.
        """
        size = len(self.forward)
        seen = np.sort(self.forward * np.int64(size) + np.arange(size))
        return np.searchsorted(seen, symbols * np.int64(size) + starts)


class Phrases:
    """Phrases of one length as symbols, with intervals of the forward side."""

    def __init__(self, symbols: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> None:
        self.symbols = symbols
        self.starts = starts
        self.counts = counts

    def where(self, kept: np.ndarray) -> Phrases:
        return Phrases(self.symbols[kept], self.starts[kept], self.counts[kept])


# --- shards -------------------------------------------------------------------------


class _Numbers(dict):
    """Numbers from 1 on for the words of one language, unique in the shard."""

    def __init__(self, shard: list[tuple[str, bytes]], language: str) -> None:
        super().__init__({b"\n": _END})
        self._shard = shard
        self._language = language

    def __missing__(self, word: bytes) -> int:
        self._shard.append((self._language, word))
        self[word] = number = len(self._shard)
        return number


def _shards(
    batches: Iterator[pa.RecordBatch], size: int
) -> Iterator[tuple[list[tuple[str, bytes]], np.ndarray]]:
    """The words of a shard (language and text by number) and its symbols."""
    words, numbers, symbols, held = [], {}, [np.zeros(1, np.int32)], 0
    for batch in batches:
        languages = batch.column(1).to_pylist()
        for text, language in zip(text_bytes(batch.column(0)), languages):
            language = "und" if language is None else language
            if language not in numbers:
                numbers[language] = _Numbers(words, language)
            pieces = text.lower().translate(_TABLE).replace(b"\n", b" \n ")
            own = list(map(numbers[language].__getitem__, filter(None, pieces.split(b" "))))
            own.append(_END)
            symbols.append(np.array(own, np.int32))
            held += len(own)
            if held >= size:
                yield words, np.concatenate(symbols)
                words, numbers, symbols, held = [], {}, [np.zeros(1, np.int32)], 0
    if held:
        yield words, np.concatenate(symbols)


_SHARD = "languages array<string>, words array<string>, forward binary, backward binary"


def build_indexes(
    documents: DataFrame,
    text: str = "text",
    lang: str = "lang",
    max_words: int = MAX_WORDS,
    shard_words: int = SHARD_WORDS,
) -> DataFrame:
    """One row per shard: its words by number, and the two transforms as 32-bit numbers.

    A shard's memory is bounded by ``shard_words`` and one document.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words, symbols in _shards(batches, shard_words):
            index = Index.build(symbols, max_words)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([[language for language, _ in words]], pa.list_(pa.string())),
                    pa.array([[word.decode() for _, word in words]], pa.list_(pa.string())),
                    pa.array([index.forward.astype("<i4").tobytes()], pa.binary()),
                    pa.array([index.backward.astype("<i4").tobytes()], pa.binary()),
                ],
                ["languages", "words", "forward", "backward"],
            )

    return documents.select(text, lang).mapInArrow(run, _SHARD)


# --- the filter of frequent phrases ----------------------------------------------------


def _word_codes(languages: list[str], words: list[str]) -> np.ndarray:
    return np.array(
        [
            xxhash.xxh64_intdigest(f"{language}\n{word}")
            for language, word in zip(languages, words)
        ],
        np.uint64,
    )


def _codes(words: np.ndarray) -> np.ndarray:
    """Places in the filter of phrases, given the codes of their words by column."""
    mixed = np.full(len(words), words.shape[1], np.uint64)
    for column in words.T:
        mixed = spread(mixed * np.uint64(0x9E3779B97F4A7C15) + column)
    return (mixed >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)


def _filter_of(frequent: DataFrame) -> np.ndarray:
    """The bits of all phrases, at most ``2 ** _FILTER_BITS`` of them, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            languages = batch.column(0).to_pylist()
            phrases = [phrase.split(" ") for phrase in batch.column(1).to_pylist()]
            if phrases:
                columns = [_word_codes(languages, list(words)) for words in zip(*phrases)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(_codes(np.stack(columns, 1)))], ["place"]
                )

    places = frequent.select("lang", "phrase").mapInArrow(run, "place bigint")
    bucket = F.shiftright("place", _BUCKET_BITS)
    bit = F.col("place").bitwiseAND(F.lit((1 << _BUCKET_BITS) - 1))
    rows = places.groupBy(bucket.alias("bucket")).agg(F.bitmap_construct_agg(bit).alias("bits"))
    table = np.zeros((1 << (_FILTER_BITS - _BUCKET_BITS), 1 << (_BUCKET_BITS - 3)), np.uint8)
    for row in rows.toLocalIterator():
        table[row.bucket] = np.frombuffer(row.bits, np.uint8)
    return table.ravel()


def _in_filter(table: np.ndarray, places: np.ndarray) -> np.ndarray:
    return (table[places >> 3] >> (places & 7).astype(np.uint8)) & 1 == 1


# --- counting ---------------------------------------------------------------------------


def _counts(indexes: DataFrame, length: int, filters: list) -> DataFrame:
    """``phrase, count`` of the phrases of one length, a row per shard.

    Here a phrase begins with its language and a line feed, which no word holds: one key
    is cheaper to count by than two.

    ``filters`` are the broadcast filters of the lengths below, shortest first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [filter.value for filter in filters]
        for batch in batches:
            for place in range(batch.num_rows):
                yield from _phrases_of(batch.slice(place, 1), length, tables)

    return indexes.mapInArrow(run, "phrase string, count bigint")


def _phrases_of(
    row: pa.RecordBatch, length: int, tables: list[np.ndarray]
) -> Iterator[pa.RecordBatch]:
    languages, words = row.column(0).flatten(), row.column(1).flatten()
    index = Index(*(np.frombuffer(row.column(c)[0].as_py(), "<i4") for c in (2, 3)))
    size = len(words) + 1
    phrases = index.words(size)
    if length > 1:
        own = _word_codes(languages.to_pylist(), words.to_pylist())
        codes = np.concatenate((np.zeros(1, np.uint64), own))

        def frequent(symbols: np.ndarray) -> np.ndarray:
            """Both parts one word shorter are in the filter, and no piece ends within."""
            found = (symbols != _END).all(axis=1)
            table = tables[symbols.shape[1] - 2]
            for part in (symbols[:, 1:], symbols[:, :-1]):
                rest = np.flatnonzero(found)
                found[rest] = _in_filter(table, _codes(codes[part[rest]]))
            return found

        each = np.arange(size)[:, None]
        known = _in_filter(tables[0], _codes(codes[each])) & (each[:, 0] != _END)
        phrases = index.right(phrases, size)
        phrases = phrases.where(frequent(phrases.symbols))
        for step in range(3, length + 1):
            # A phrase that isn't frequent has no frequent extension.
            kept = _in_filter(tables[phrases.symbols.shape[1] - 1], _codes(codes[phrases.symbols]))
            phrases = index.left(phrases.where(kept), known, step == length)
            phrases = phrases.where(frequent(phrases.symbols))
    else:
        phrases = phrases.where(np.arange(size) != _END)
    symbols = phrases.symbols - 1
    heads = pc.binary_join_element_wise(languages, words, "\n")
    for begin in range(0, len(symbols), 1 << 18):
        part = symbols[begin : begin + (1 << 18)]
        texts = [
            (words if place else heads).take(pa.array(column))
            for place, column in enumerate(part.T)
        ]
        yield pa.RecordBatch.from_arrays(
            [
                pc.binary_join_element_wise(*texts, " ") if length > 1 else texts[0],
                pa.array(phrases.counts[begin : begin + (1 << 18)].astype(np.int64)),
            ],
            ["phrase", "count"],
        )


def _language() -> Column:
    """What stands before the last line feed of a phrase."""
    return F.expr("substr(phrase, 1, length(phrase) - length(substring_index(phrase, '\n', -1)) - 1)")


def phrase_counts(
    documents: DataFrame,
    text: str = "text",
    lang: str = "lang",
    max_words: int = MAX_WORDS,
    least: int = LEAST_COUNT,
    shard_words: int = SHARD_WORDS,
) -> tuple[DataFrame, list[DataFrame]]:
    """Words in all by language (``lang, n``), and for each length ``lang, phrase, count``.

    Phrases lie within a piece; overlapping ones count each. Those in a language fewer than
    ``least`` times are left out, at every length.
    """
    spark = documents.sparkSession
    indexes = build_indexes(documents, text, lang, max_words, shard_words)
    indexes = stored(indexes, "phrase-indexes", _DOCUMENTS_AT_ONCE, **_INDEX_FILES)
    tasks = -(-indexes.count() // _SHARDS_MERGED)
    indexes = indexes.coalesce(max(tasks, 2 * spark.sparkContext.defaultParallelism))
    filters, levels = [], []
    totals = None
    for length in range(1, max_words + 1):
        counted = _counts(indexes, length, filters)
        counts = counted.groupBy("phrase").agg(F.sum("count").alias("count"))
        if length == 1:
            counts = stored(counts, "word-counts", _SHARDS_AT_ONCE)
            totals = counts.groupBy(_language().alias("lang")).agg(F.sum("count").alias("n"))
        frequent = counts.where(F.col("count") >= least).select(
            _language().alias("lang"),
            F.substring_index("phrase", "\n", -1).alias("phrase"),
            "count",
        )
        if length > 1:
            frequent = stored(frequent, f"phrases-{length}", _SHARDS_AT_ONCE)
        levels.append(frequent)
        if length < max_words:
            filters.append(spark.sparkContext.broadcast(_filter_of(frequent)))
    return totals, levels


# --- scores -------------------------------------------------------------------------------


def _exact(column: str) -> Column:
    return F.col(column).cast("decimal(19,0)")


def _parts(phrase: str, cut: int) -> tuple[Column, Column]:
    """The first ``cut`` words of a phrase, and the rest."""
    first = F.substring_index(phrase, " ", cut)
    return first, F.expr(f"substr({phrase}, length(substring_index({phrase}, ' ', {cut})) + 2)")


def _scored(levels: list[DataFrame], length: int) -> DataFrame:
    """Candidates of one length with the cut that scores lowest, the first of equal ones."""
    found = levels[length - 1].withColumnRenamed("count", "a")
    options = []
    for cut in range(1, length):
        head, tail = _parts("phrase", cut)
        for name, part, size in (("l", head, cut), ("r", tail, length - cut)):
            side = levels[size - 1].select(
                F.col("lang").alias(f"{name}_lang"),
                F.col("phrase").alias(f"{name}_phrase"),
                F.col("count").alias(f"{name}{cut}"),
            )
            same = (F.col("lang") == F.col(f"{name}_lang")) & (part == F.col(f"{name}_phrase"))
            found = found.join(side, same).drop(f"{name}_lang", f"{name}_phrase")
        # A whole number that never passes 1,000,000, as no part is rarer than the phrase.
        score = F.expr(
            f"""(CAST(1000000 AS DECIMAL(7)) * (CAST(a AS DECIMAL(15)) * CAST(a AS DECIMAL(15))))
                div (CAST(l{cut} AS DECIMAL(19)) * CAST(r{cut} AS DECIMAL(19)))"""
        )
        options.append(
            F.struct(
                score.alias("score"),
                F.lit(cut).alias("cut"),
                F.col(f"l{cut}").alias("l"),
                F.col(f"r{cut}").alias("r"),
            )
        )
    best = F.array_min(F.array(*options))
    return found.withColumn("best", best).select("lang", "phrase", "a", "best.l", "best.r", "best.score")


def _absorbed(levels: list[DataFrame], percent: int) -> DataFrame:
    """``lang, phrase, longest``: the greatest count of a longer candidate around a phrase."""
    parts = []
    for length in range(3, len(levels) + 1):
        for size in range(2, length):
            for skip in range(length - size + 1):
                rest = _parts("phrase", skip)[1] if skip else F.col("phrase")
                part = levels[length - 1].select("lang", rest.alias("phrase"), "count")
                parts.append(
                    part.withColumn("phrase", F.substring_index("phrase", " ", size))
                )
    if not parts:
        return levels[0].where("false").select("lang", "phrase", F.col("count").alias("longest"))
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole.groupBy("lang", "phrase").agg(F.max("count").alias("longest"))


#: Parts of a language that are ranked apart before the language is.
_SALTS = 64


def collocations(
    documents: DataFrame,
    text: str = "text",
    lang: str = "lang",
    max_words: int = MAX_WORDS,
    least: int = LEAST_COUNT,
    percent: int = ABSORBS_PERCENT,
    top: int = TOP,
    shard_words: int = SHARD_WORDS,
) -> DataFrame:
    """Each language's best phrases: ``lang, rank, phrase, a, l, r, n, score``.

    ``score`` is a million times how much of its parts' counts a phrase takes up, by its
    weakest cut. Phrases within a longer candidate that has ``percent`` of their count go.
    """
    totals, levels = phrase_counts(documents, text, lang, max_words, least, shard_words)
    found = _scored(levels, 2)
    for length in range(3, max_words + 1):
        found = found.unionByName(_scored(levels, length))
    longer = _absorbed(levels, percent)
    found = found.join(longer, ["lang", "phrase"], "left").where(
        F.col("longest").isNull()
        | (_exact("longest") * 100 < _exact("a") * percent)
    )
    ranking = "ORDER BY score DESC, a DESC, phrase"
    salted = found.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(_SALTS)))
    near = salted.withColumn(
        "rank", F.expr(f"row_number() OVER (PARTITION BY lang, salt {ranking})")
    ).where(F.col("rank") <= top)
    ranked = near.withColumn(
        "rank", F.expr(f"row_number() OVER (PARTITION BY lang {ranking})").cast("long")
    ).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select(
        "lang", "rank", "phrase", "a", "l", "r", "n", "score"
    )


ORACLE = f"""WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents),
split AS (
  SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces),
grams AS (
  SELECT lang, size, unnest(list_transform(range(1, len(w) - size + 2),
    lambda i: array_to_string(w[i : i + size - 1], ' '))) AS phrase
  FROM split, (SELECT unnest([1, 2, 3]) AS size)),
f AS (
  SELECT lang, phrase, size, count(*)::HUGEINT AS c FROM grams GROUP BY ALL),
totals AS (SELECT lang, sum(c)::BIGINT AS n FROM f WHERE size = 1 GROUP BY lang),
cuts AS (
  SELECT lang, phrase, c AS a, k,
    array_to_string(string_split(phrase, ' ')[1 : k], ' ') AS head,
    array_to_string(string_split(phrase, ' ')[k + 1 :], ' ') AS tail
  FROM f, (SELECT unnest([1, 2]) AS k) WHERE size > k AND c >= {LEAST_COUNT}),
scores AS (
  SELECT cuts.lang, cuts.phrase, a, k, h.c AS l, t.c AS r,
    (1000000::HUGEINT * a * a) // (h.c * t.c) AS score
  FROM cuts JOIN f h ON h.lang = cuts.lang AND h.phrase = head
    JOIN f t ON t.lang = cuts.lang AND t.phrase = tail),
best AS (
  SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
around AS (
  SELECT lang, part AS phrase, max(c) AS longest
  FROM (SELECT lang, c, unnest([array_to_string(string_split(phrase, ' ')[1 : 2], ' '),
                                array_to_string(string_split(phrase, ' ')[2 : 3], ' ')]) AS part
        FROM f WHERE size = 3 AND c >= {LEAST_COUNT})
  GROUP BY ALL)
SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank,
  b.phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score
FROM best b JOIN totals USING (lang)
LEFT JOIN around x ON x.lang = b.lang AND x.phrase = b.phrase
WHERE longest IS NULL OR 100 * longest < {ABSORBS_PERCENT} * a
QUALIFY rank <= {TOP}"""
