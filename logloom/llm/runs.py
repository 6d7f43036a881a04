"""Periodic runs of words: stretches that repeat their first words at least four times.

Every text is judged by itself in one task. Its words become numbers, a suffix tree of
them (and one of their reversal) is built online, and an Euler tour of each tree with
range minima answers how far two places agree in constant time. Every run has a Lyndon
root that is the longest Lyndon word at its place under one of two opposite orders, so
extending those roots to both sides finds every run once its period is smallest.

A word of a run lies in a group of five words that comes again in the same run, so only
stretches covered by such groups enter a tree; nothing else can belong to a run.

Null and empty texts have no words and no run. Memory grows with one buffer of texts (or
with the one text that is longer than a buffer) and nothing else.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.llm.slices import buffers, powers, spread, text_bytes

#: A run is at least this long, and at least this many times its period.
LEAST_WORDS = 6
LEAST_REPEATS = 4
#: Words of a group that must come again within a run: a run holds at least this many
#: beyond its first period.
_GROUP = 5
_BLOCK = 16


# --- the tree --------------------------------------------------------------------


class SuffixTree:
    """The suffix tree of a sequence whose last number occurs nowhere else in it."""

    def __init__(self, symbols: list[int]) -> None:
        self._build(symbols)
        self._walk(len(symbols))

    def _build(self, symbols: list[int]) -> None:
        """Add one symbol after the other, following suffix links (Ukkonen)."""
        size = len(symbols)
        width = max(symbols) + 1
        begin, end, link, suffix = [0], [0], [0], [-1]
        child: dict[int, int] = {}
        node = edge = along = pending = 0
        for place, symbol in enumerate(symbols):
            unlinked = 0
            pending += 1
            while pending:
                if not along:
                    edge = place
                key = node * width + symbols[edge]
                below = child.get(key)
                if below is None:
                    child[key] = len(begin)
                    begin.append(place)
                    end.append(size)
                    link.append(0)
                    suffix.append(place - pending + 1)
                    if unlinked:
                        link[unlinked] = node
                        unlinked = 0
                else:
                    top = begin[below]
                    length = end[below] - top
                    if along >= length:
                        edge += length
                        along -= length
                        node = below
                        continue
                    if symbols[top + along] == symbol:
                        if unlinked:
                            link[unlinked] = node
                        along += 1
                        break
                    middle = len(begin)
                    child[key] = middle
                    child[middle * width + symbol] = middle + 1
                    child[middle * width + symbols[top + along]] = below
                    begin += (top, place)
                    end += (top + along, size)
                    link += (0, 0)
                    suffix += (-1, place - pending + 1)
                    begin[below] = top + along
                    if unlinked:
                        link[unlinked] = middle
                    unlinked = middle
                pending -= 1
                if node:
                    node = link[node]
                elif along:
                    along -= 1
                    edge = place - pending + 1
        keys = np.fromiter(child.keys(), np.int64, len(child))
        nodes = np.fromiter(child.values(), np.int64, len(child))
        order = np.argsort(keys)  # by parent, then by the edge's first symbol
        self._children = nodes[order].tolist()
        counts = np.bincount(keys // width, minlength=len(begin))
        self._first_child = np.concatenate(([0], np.cumsum(counts))).tolist()
        self._length = (np.array(end) - np.array(begin)).tolist()
        self._suffix = suffix

    def _walk(self, size: int) -> None:
        """The Euler tour: depths of the nodes passed, and where each leaf is in it."""
        children, length, suffix = self._children, self._length, self._suffix
        ahead, stop = self._first_child[:-1], self._first_child[1:]
        depth = [0] * len(length)
        tour, leaf = [0], [0] * size
        path = [0]
        while path:
            node = path[-1]
            step = ahead[node]
            if step == stop[node]:
                path.pop()
                if path:
                    tour.append(depth[path[-1]])
                continue
            ahead[node] = step + 1
            below = children[step]
            depth[below] = depth[node] + length[below]
            if suffix[below] >= 0:
                leaf[suffix[below]] = len(tour)
                tour += (depth[below], depth[node])
            else:
                tour.append(depth[below])
                path.append(below)
        del self._children, self._first_child, self._length, self._suffix
        self._leaf = np.array(leaf, np.int64)
        self._minima = RangeMinima(np.array(tour, np.int32))
        #: The rank of every suffix among all, in the order of the symbols.
        self.rank = np.empty(size, np.int64)
        self.rank[np.argsort(self._leaf)] = np.arange(size)

    def agreement(self, one: np.ndarray, other: np.ndarray) -> np.ndarray:
        """How many symbols two different suffixes share from their starts on."""
        one, other = self._leaf[one], self._leaf[other]
        return self._minima(np.minimum(one, other), np.maximum(one, other))


class RangeMinima:
    """Least values of ranges in constant time, with memory in proportion to the values."""

    def __init__(self, values: np.ndarray) -> None:
        blocks = -(-len(values) // _BLOCK)
        padded = np.full(blocks * _BLOCK, np.iinfo(values.dtype).max, values.dtype)
        padded[: len(values)] = values
        rows = padded.reshape(blocks, _BLOCK)
        self._values = padded
        self._up_to = np.minimum.accumulate(rows, axis=1).ravel()
        self._from = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        self._levels = [rows.min(axis=1)]
        while (span := 1 << len(self._levels)) <= blocks:
            last = self._levels[-1]
            self._levels.append(np.minimum(last[: blocks - span + 1], last[span // 2 :][: blocks - span + 1]))

    def __call__(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """The least of ``values[first] ... values[last]``, for every pair of bounds."""
        low, high = first // _BLOCK, last // _BLOCK
        found = np.minimum(self._from[first], self._up_to[last])
        for place in np.flatnonzero(low == high).tolist():
            found[place] = self._values[first[place] : last[place] + 1].min()
        between = high - low - 1
        wide = np.flatnonzero(between > 0)
        level = np.floor(np.log2(between[wide])).astype(np.int64)
        for number in np.unique(level).tolist():
            own = wide[level == number]
            table = self._levels[number]
            begin, end = low[own] + 1, high[own] - (1 << number)
            found[own] = np.minimum(found[own], np.minimum(table[begin], table[end]))
        return found


# --- runs of one sequence -----------------------------------------------------------


def _next_beyond(rank: np.ndarray) -> np.ndarray:
    """For every place the next one of smaller rank; the length where there is none."""
    size = len(rank)
    found, waiting = [size] * size, []
    for place, value in enumerate(rank.tolist()):
        while waiting and waiting[-1][0] > value:
            found[waiting.pop()[1]] = place
        waiting.append((value, place))
    return np.array(found, np.int64)


def runs_of(symbols: np.ndarray) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of every run, by start and then period.

    Numbers may be any that are not negative.
    """
    size = len(symbols)
    if size < LEAST_WORDS:
        return []
    _, symbols = np.unique(symbols, return_inverse=True)
    mark = int(symbols.max()) + 1
    tree = SuffixTree([*symbols.tolist(), mark])
    starts, periods = [], []
    for rank in (tree.rank, size - tree.rank):
        beyond = _next_beyond(rank)[:size]
        root = beyond - np.arange(size)
        place = np.flatnonzero((beyond < size) & (root * LEAST_REPEATS <= size))
        starts.append(place)
        periods.append(root[place])
    start, period = np.concatenate(starts), np.concatenate(periods)
    after = tree.agreement(start, start + period)
    # A run's first root starts within its first period, so it goes on this far behind.
    long = after > (LEAST_REPEATS - 2) * period
    # With the shortest period the bound on the length is the greater one.
    long |= (period == 1) & (after + 1 >= LEAST_WORDS)
    start, period, after = start[long], period[long], after[long]
    if not len(start):
        return []
    before = np.zeros(len(start), np.int64)
    inner = np.flatnonzero(start)
    if len(inner):
        back = SuffixTree([*symbols[::-1].tolist(), mark])
        mirrored = size - start[inner]
        before[inner] = back.agreement(mirrored, mirrored - period[inner])
    length = before + period + after
    kept = (length >= LEAST_REPEATS * period) & (length >= LEAST_WORDS)
    found = zip((start - before)[kept].tolist(), length[kept].tolist(), period[kept].tolist())
    return sorted(set(found), key=lambda run: (run[0], run[2]))


# --- runs of many texts -------------------------------------------------------------


class _Numbers(dict):
    """Numbers for words, given in the order of their first use."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


def _covered(words: np.ndarray, part: np.ndarray) -> np.ndarray:
    """Which places lie in a group of words that comes again in the same part.

    Equal hashes of different groups only let more places pass.
    """
    covered = np.zeros(len(words), bool)
    count = len(words) - _GROUP + 1
    if count <= 0:
        return covered
    mixed = spread(words.astype(np.uint64) + np.uint64(1))
    factors = spread(powers(0xD1342543DE82EF95, _GROUP + 2)[1:]) | np.uint64(1)
    group = part[:count].astype(np.uint64) * factors[_GROUP]
    for step in range(_GROUP):
        group += mixed[step : step + count] * factors[step]
    whole = np.flatnonzero(part[:count] == part[_GROUP - 1 :])
    group = spread(group[whole])
    order = np.argsort(group)
    group = group[order]
    same = group[1:] == group[:-1]
    again = np.zeros(len(order), bool)
    again[1:] |= same
    again[:-1] |= same
    first = whole[order[again]]
    for step in range(_GROUP):
        covered[first + step] = True
    return covered


def runs_of_texts(texts: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """The runs of every text, given as its words."""
    numbers = _Numbers()
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    words = np.fromiter(
        (numbers[word] for text in texts for word in text), np.int64, int(sizes.sum())
    )
    begins = np.cumsum(sizes) - sizes
    text = np.repeat(np.arange(len(texts)), sizes)
    place = np.flatnonzero(_covered(words, text))
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if not len(place):
        return found
    # Again, by stretch: a run is never in two of them.
    for _ in range(2):
        breaks = (np.diff(place) > 1) | (np.diff(text[place]) > 0)
        stretch = np.concatenate(([0], np.cumsum(breaks)))
        if len(kept := np.flatnonzero(_covered(words[place], stretch))) == len(place):
            break
        place = place[kept]
        if not len(place):
            return found
    breaks = np.flatnonzero((np.diff(place) > 1) | (np.diff(text[place]) > 0)) + 1
    for own in np.split(place, breaks):
        number = int(text[own[0]])
        offset = int(own[0] - begins[number])
        found[number] += [
            (offset + start, length, period) for start, length, period in runs_of(words[own])
        ]
    return found


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words without those that follow the first period of a run, a space between."""
    if not runs:
        return b" ".join(words)
    kept = np.ones(len(words), bool)
    for start, length, period in runs:
        kept[start + period : start + length] = False
    return b" ".join(words[place] for place in np.flatnonzero(kept).tolist())


_RUN = "struct<start:bigint,length:bigint,period:bigint>"


def find_runs(documents: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``id, n_words, runs, collapsed``: every text's runs, and the text without repeats.

    ``runs`` is an array of ``start, length, period`` by start and period, counted in
    words. A null or empty text has no words, no runs and an empty ``collapsed``. Rows
    that share an id, or have none, are judged one by one; no further column is read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = text_bytes(batch.column(1))
            for part in buffers(texts):
                # Splitting bytes goes by exactly the six white-space characters.
                words = [text.split() for text in texts[part]]
                found = runs_of_texts(words)
                cuts = np.concatenate(([0], np.cumsum([len(runs) for runs in found])))
                rows = np.array([run for runs in found for run in runs], np.int64).reshape(-1, 3)
                names = ["start", "length", "period"]
                structs = pa.StructArray.from_arrays(
                    [pa.array(column) for column in rows.T.copy()], names
                )
                plain = [collapsed(*pair).decode() for pair in zip(words, found)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0)[part.start : part.stop],
                        pa.array([len(text) for text in words], pa.int64()),
                        pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), structs),
                        pa.array(plain, pa.string()),
                    ],
                    ["id", "n_words", "runs", "collapsed"],
                )

    kind = documents.schema[id].dataType.simpleString()
    return documents.select(id, text).mapInArrow(
        run, f"id {kind}, n_words bigint, runs array<{_RUN}>, collapsed string"
    )


# --- the report -----------------------------------------------------------------------


def with_planted_runs(documents: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents, the words of one in ten repeated from some word on.

    Which, from where and how often is drawn from a hash of the id; a row without an id
    stays as it is.
    """
    draw = F.crc32(F.col(id).cast("string"))
    planted = F.expr(
        f"""array_join(get(transform(array(regexp_extract_all(`{text}`, '[^\\\\x20\\\\x09-\\\\x0D]+', 0)),
          w -> get(transform(array(crc32(CAST(`{id}` AS STRING)) div 10), g ->
            get(transform(array(g % size(w)), a ->
              get(transform(array(1 + (size(w) - a) div (3 + g % 8)), p ->
                transform(w, (x, i) -> IF(i < a, x, get(w, CAST(a + (i - a) % p AS INT))))
              ), 0)), 0)), 0)), 0), ' ')"""
    )
    has_words = F.col(text).rlike("[^\\x20\\x09-\\x0D]")
    return documents.withColumn(text, F.when((draw % 10 == 0) & has_words, planted).otherwise(F.col(text)))


def _greatest(runs: str) -> Column:
    """The run that repeats most often; of equal ones the first."""
    return F.expr(
        f"""aggregate({runs}, get({runs}, 0), (best, r) ->
            IF(CAST(r.length AS DECIMAL(19)) * best.period > CAST(best.length AS DECIMAL(19)) * r.period,
               r, best))"""
    )


def report(found: DataFrame) -> DataFrame:
    """One row per row of :func:`find_runs`: how many runs, the greatest, and digests."""
    lines = F.transform(
        "runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    )
    listed = F.array_join(F.transform(lines, lambda line: F.concat(line, F.lit("\n"))), "")
    return found.withColumn("best", _greatest("runs")).select(
        "id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
