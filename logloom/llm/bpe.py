"""Byte-level BPE: texts to token ids and back, many texts at a time.

Boundaries of the pieces to be merged come from arrays, not from a regular expression:
every code point has a class, and whether a piece begins at a code point follows from the
state that the automaton of the split pattern has there. Each code point is a function
from state to state; composing such functions is associative, and for this pattern any
composition over three neighbours is constant but for one bit, "in the run that began
here", which a running scan over run starts carries. So the whole buffer is scanned with
shifted comparisons.

Pieces are hashed as slices of the buffer. Only pieces not seen before are merged, all of
them together: each round merges the pair of lowest rank in every piece.
"""

from __future__ import annotations

import base64
import hashlib
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from logloom.llm.slices import (
    MARK,
    SliceHasher,
    buffers,
    joined,
    ranges,
    same_bytes,
    text_bytes,
)

# Classes of code points.
LETTER, NUMBER, OTHER, WHITE, SPACE, EDGE, UNKNOWN = range(7)
NO_RANK = np.int64(1) << 40
#: Pieces remembered in a task before the memory starts anew.
REMEMBERED = 1_000_000


# --- vocabulary ------------------------------------------------------------------


@dataclass
class Vocabulary:
    """Tokens of a rank file as arrays: about 3 MB for 50,000 tokens."""

    blob: np.ndarray  # bytes of all tokens, by id
    starts: np.ndarray
    lengths: np.ndarray
    byte_ids: np.ndarray  # id of each single byte
    byte_pairs: np.ndarray  # rank of two bytes, at 256 * first + second
    pair_keys: np.ndarray  # sorted keys of the pairs whose joined bytes are a token
    pair_ids: np.ndarray

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        """From a file with a base64 token and its rank on each line, ranks 0 to n - 1."""
        with open(path, "rb") as lines:
            pairs = [line.split() for line in lines if line.strip()]
        ranks = {base64.b64decode(token): int(rank) for token, rank in pairs}
        return cls.of(ranks)

    @classmethod
    def of(cls, ranks: dict[bytes, int]) -> Vocabulary:
        tokens = sorted(ranks, key=ranks.get)
        if [ranks[token] for token in tokens] != list(range(len(tokens))):
            raise ValueError("ranks must be 0, 1, 2, ...")
        if any(bytes([value]) not in ranks for value in range(256)):
            raise ValueError("every single byte must have a rank")
        keys, ids = [], []
        for token in tokens:
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    keys.append(left << 32 | right)
                    ids.append(ranks[token])
        order = np.argsort(np.array(keys, np.int64))
        byte_pairs = np.full(1 << 16, NO_RANK)
        for token in tokens:
            if len(token) == 2:
                byte_pairs[token[0] << 8 | token[1]] = ranks[token]
        lengths = np.array([len(token) for token in tokens], np.int64)
        return cls(
            np.frombuffer(b"".join(tokens), np.uint8),
            np.cumsum(lengths) - lengths,
            lengths,
            np.array([ranks[bytes([value])] for value in range(256)], np.int64),
            byte_pairs,
            np.array(keys, np.int64)[order],
            np.array(ids, np.int64)[order],
        )

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Id of each joined pair, ``NO_RANK`` where it is no token."""
        keys = left << 32 | right
        place = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        if not len(self.pair_keys):
            return np.full(len(keys), NO_RANK)
        return np.where(self.pair_keys[place] == keys, self.pair_ids[place], NO_RANK)

    def decode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """Bytes of the ids, and where each id's bytes begin, then the end."""
        lengths = self.lengths[ids]
        data = self.blob[ranges(self.starts[ids], lengths)].tobytes()
        return data, np.concatenate(([0], np.cumsum(lengths)))


# --- boundaries ------------------------------------------------------------------


def _class_of(point: int) -> int:
    kind = unicodedata.category(chr(point))[0]
    if kind == "L":
        return LETTER
    if kind == "N":
        return NUMBER
    if chr(point).isspace() and not 0x1C <= point <= 0x1F:
        return SPACE if point == 0x20 else WHITE
    return OTHER


class Splitter:
    """Boundaries of the pieces of the byte-level split pattern in a joined buffer.

    The pattern: the endings 's 't 're 've 'm 'll 'd; letters, numbers or other signs with
    one space before them; white space up to the last one before a sign; white space.
    """

    def __init__(self) -> None:
        self._classes = np.full(0x110000, UNKNOWN, np.uint8)
        self._classes[:128] = [_class_of(point) for point in range(128)]

    def classes(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Class of the code point whose first byte stands at each place."""
        first = data[at]
        result = self._classes[first]
        wide = np.flatnonzero((first >= 0x80) & (first != MARK))
        lead, place = first[wide].astype(np.int64), at[wide]
        two, three, four = (data[place + step].astype(np.int64) & 63 for step in (1, 2, 3))
        points = np.where(
            lead < 0xE0,
            (lead & 31) << 6 | two,
            np.where(
                lead < 0xF0,
                (lead & 15) << 12 | two << 6 | three,
                np.minimum((lead & 7) << 18 | two << 12 | three << 6 | four, 0x10FFFF),
            ),
        )
        for point in np.unique(points[self._classes[points] == UNKNOWN]):
            self._classes[point] = _class_of(int(point))
        result[wide] = self._classes[points]
        result[first == MARK] = EDGE
        return result

    def __call__(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places where pieces begin and end; ``data`` is as ``joined`` makes it."""
        data_end = len(data) - 4
        at = np.flatnonzero((data[:data_end] & 0xC0) != 0x80)
        sign = np.concatenate((data[at], np.zeros(4, np.uint8)))
        kind = self.classes(data, at)
        white = (kind == WHITE) | (kind == SPACE)
        run = np.where(white, WHITE, kind)
        begins = np.ones(len(at) + 4, bool)
        begins[1 : len(at)] = run[1:] != run[:-1]
        # The last white space before a sign is a piece of its own or joins the sign.
        last = np.flatnonzero(white[:-1] & (run[1:] < WHITE))
        begins[last] = True
        begins[last[kind[last] == SPACE] + 1] = False
        # Endings, where a piece begins at the apostrophe.
        quote = np.flatnonzero((sign[: len(at)] == ord("'")) & begins[: len(at)])
        one, two = sign[quote + 1], sign[quote + 2]
        short = np.isin(one, np.frombuffer(b"stmd", np.uint8))
        long = np.zeros(len(quote), bool)
        for ending in (b"re", b"ve", b"ll"):
            long |= (one == ending[0]) & (two == ending[1])
        begins[quote[short | long] + 1] = False
        begins[quote[short] + 2] = True
        begins[quote[long] + 3] = True
        starts = np.flatnonzero(begins[: len(at)])
        inside = kind[starts] != EDGE
        ends = np.append(at[starts[1:]], data_end)
        return at[starts][inside], ends[inside]


# --- merging ---------------------------------------------------------------------


def _merge_one(vocabulary: Vocabulary, ids: list[int]) -> list[int]:
    """One pair at a time, lowest rank first, leftmost of equals."""
    while len(ids) > 1:
        pairs = np.array([ids[:-1], ids[1:]], np.int64)
        ranks = vocabulary.rank(*pairs)
        best = int(ranks.argmin())
        if ranks[best] == NO_RANK:
            break
        ids[best : best + 2] = [int(ranks[best])]
    return ids


def merge(vocabulary: Vocabulary, data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """Token ids of every slice, one after the other, and how many each slice has."""
    lengths = ends - starts
    raw = data[ranges(starts, lengths)]
    signs = vocabulary.byte_ids[raw]
    piece = np.repeat(np.arange(len(starts)), lengths)
    done_ids, done_piece, alone = [], [], []
    ranks = np.full(len(signs), NO_RANK)
    inner = np.flatnonzero(piece[1:] == piece[:-1])
    ranks[inner] = vocabulary.byte_pairs[raw[inner].astype(np.int64) << 8 | raw[inner + 1]]
    while len(signs):
        first = np.flatnonzero(np.append(True, piece[1:] != piece[:-1]))
        best = np.minimum.reduceat(ranks, first)
        sizes = np.diff(np.append(first, len(piece)))
        finished = np.repeat(best == NO_RANK, sizes)
        if finished.any():
            done_ids.append(signs[finished])
            done_piece.append(piece[finished])
            signs, piece, ranks = signs[~finished], piece[~finished], ranks[~finished]
            best, sizes = best[best < NO_RANK], sizes[best < NO_RANK]
            if not len(signs):
                break
        hit = np.flatnonzero(ranks == np.repeat(best, sizes))
        # Of overlapping pairs (as in "aaa") the first, third, ... are taken.
        fresh = np.append(True, np.diff(hit) > 1)
        since = np.maximum.accumulate(np.where(fresh, hit, 0))
        hit = hit[(hit - since) % 2 == 0]
        rank = ranks[hit]
        signs[hit] = rank
        keep = np.ones(len(signs), bool)
        keep[hit + 1] = False
        new_place = np.cumsum(keep) - 1
        signs, piece, ranks = signs[keep], piece[keep], ranks[keep]
        now = new_place[hit]
        for left in (now, now[now > 0] - 1):
            right = np.minimum(left + 1, len(signs) - 1)
            joins = (right > left) & (piece[left] == piece[right])
            ranks[left] = NO_RANK
            ranks[left[joins]] = vocabulary.rank(signs[left[joins]], signs[right[joins]])
        # A new pair of still lower rank would have come before the next equal pair.
        early = np.zeros(len(now), bool)
        early |= ranks[now] < rank
        early[now > 0] |= (ranks[now[now > 0] - 1] < rank[now > 0]) & (
            piece[now[now > 0] - 1] == piece[now[now > 0]]
        )
        if early.any():
            owners, counts = np.unique(piece[now], return_counts=True)
            strict = np.intersect1d(owners[counts > 1], piece[now[early]])
            if len(strict):
                alone.extend(strict.tolist())
                stay = ~np.isin(piece, strict)
                signs, piece, ranks = signs[stay], piece[stay], ranks[stay]
    for number in alone:
        alone_ids = vocabulary.byte_ids[data[starts[number] : ends[number]]]
        ids = np.array(_merge_one(vocabulary, alone_ids.tolist()), np.int64)
        done_ids.append(ids)
        done_piece.append(np.full(len(ids), number))
    if not done_ids:
        return np.zeros(0, np.int64), np.zeros(len(starts), np.int64)
    ids, piece = np.concatenate(done_ids), np.concatenate(done_piece)
    order = np.argsort(piece, kind="stable")
    return ids[order], np.bincount(piece, minlength=len(starts))


class Encoder:
    """Encodes texts, remembering the ids of pieces it has merged."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary = vocabulary
        self._split = Splitter()
        self._hash = SliceHasher()
        self._forget()

    def _forget(self) -> None:
        self._known = np.zeros(0, np.uint64)  # sorted hashes
        self._start = np.zeros(0, np.int64)
        self._count = np.zeros(0, np.int64)
        self._ids = np.zeros(0, np.int32)
        # The remembered slices themselves.
        self._data = np.zeros(0, np.uint8)
        self._from = np.zeros(0, np.int64)
        self._size = np.zeros(0, np.int64)

    def _learn(self, hashes, data, starts, ends) -> None:
        ids, counts = merge(self.vocabulary, data, starts, ends)
        begin = len(self._ids) + np.cumsum(counts) - counts
        sizes = ends - starts
        origin = len(self._data) + np.cumsum(sizes) - sizes
        self._ids = np.concatenate((self._ids, ids.astype(np.int32)))
        self._data = np.concatenate((self._data, data[ranges(starts, sizes)]))
        known = np.concatenate((self._known, hashes))
        order = np.argsort(known, kind="stable")
        self._known = known[order]
        self._start = np.concatenate((self._start, begin))[order]
        self._count = np.concatenate((self._count, counts))[order]
        self._from = np.concatenate((self._from, origin))[order]
        self._size = np.concatenate((self._size, sizes))[order]

    def _find(self, hashes):
        place = np.searchsorted(self._known, hashes)
        inside = np.minimum(place, max(len(self._known) - 1, 0))
        if not len(self._known):
            return inside, np.zeros(len(hashes), bool)
        return inside, self._known[inside] == hashes

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and where each text's ids begin, then the end."""
        data, begins = joined(texts)
        starts, ends = self._split(data)
        codes, hashes = pd.factorize(self._hash(data, starts, ends))
        first = np.empty(len(hashes), np.int64)
        first[codes[::-1]] = np.arange(len(codes))[::-1]
        order = np.argsort(hashes)  # searches for sorted hashes stay in the cache
        hashes, first = hashes[order], first[order]
        codes = np.argsort(order)[codes]
        if len(self._known) > REMEMBERED:
            self._forget()
        place, found = self._find(hashes)
        if not found.all():
            new = first[~found]
            self._learn(hashes[~found], data, starts[new], ends[new])
            place, found = self._find(hashes)
        start, count, pool = self._start[place][codes], self._count[place][codes], self._ids
        same = same_bytes(
            data, starts, ends - starts,
            self._data, self._from[place][codes], self._size[place][codes],
        )
        if not same.all():  # a hash that two slices share: merge the other one here
            other = np.flatnonzero(~same)
            extra, counts = merge(self.vocabulary, data, starts[other], ends[other])
            start[other] = len(pool) + np.cumsum(counts) - counts
            count[other] = counts
            pool = np.concatenate((pool, extra.astype(np.int32)))
        ids = pool[ranges(start, count)]
        before = np.concatenate(([0], np.cumsum(count)))
        return ids, before[np.searchsorted(starts, begins)]


def encoded(texts: list[bytes], encoder: Encoder) -> Iterator[tuple[int, np.ndarray]]:
    """Place and ids of every text, in order."""
    for part in buffers(texts):
        ids, begins = encoder.encode(texts[part])
        for place in range(part.stop - part.start):
            yield part.start + place, ids[begins[place] : begins[place + 1]]


# --- operator --------------------------------------------------------------------


def encode(documents: DataFrame, path: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Token ids of every text with the byte offset of each: ``id, ids, offsets``.

    A null text counts as empty; an empty text has no ids. Rows stay as they are, repeated
    rows and null ids included; other columns are not read. Text of any length is taken
    whole. An empty table gives an empty table.
    """
    vocabulary = documents.sparkSession.sparkContext.broadcast(vars(Vocabulary.read(path)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(Vocabulary(**vocabulary.value))
        for batch in batches:
            texts = text_bytes(batch.column(1))
            for part in buffers(texts):
                ids, begins = encoder.encode(texts[part])
                lengths = encoder.vocabulary.lengths[ids]
                offsets = np.cumsum(lengths) - lengths
                if len(ids):
                    at = np.minimum(begins[:-1], len(ids) - 1)
                    offsets -= np.repeat(offsets[at], np.diff(begins))
                lists = pa.ListArray.from_arrays
                cuts = pa.array(begins.astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0)[part.start : part.stop],
                        lists(cuts, pa.array(ids.astype(np.int32))),
                        lists(cuts, pa.array(offsets)),
                    ],
                    ["id", "ids", "offsets"],
                )

    kind = documents.schema[id].dataType.simpleString()
    return documents.select(id, text).mapInArrow(
        run, f"id {kind}, ids array<int>, offsets array<bigint>"
    )


def decode(tokens: DataFrame, path: str) -> DataFrame:
    """Bytes of every row's ids: ``id, data``. Null or empty ids give empty bytes."""
    vocabulary = tokens.sparkSession.sparkContext.broadcast(vars(Vocabulary.read(path)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Vocabulary(**vocabulary.value)
        for batch in batches:
            decoded = [
                own.decode(np.array(ids or [], np.int64))[0]
                for ids in batch.column(1).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(decoded, pa.binary())], ["id", "data"]
            )

    kind = tokens.schema["id"].dataType.simpleString()
    return tokens.select("id", "ids").mapInArrow(run, f"id {kind}, data binary")


def digests(documents: DataFrame, path: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Digests of every text's ids and of the bytes decoded from them.

    Returns ``id, n_tokens, ids_sha256`` (of the decimal ids joined by a space) and
    ``decoded_sha256``. Rows, nulls and empty texts as in ``encode``; ids and bytes stay in
    the task, so nothing but the digests is written.
    """
    vocabulary = documents.sparkSession.sparkContext.broadcast(vars(Vocabulary.read(path)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(Vocabulary(**vocabulary.value))
        decimals = [b"%d" % number for number in range(len(encoder.vocabulary.lengths))]
        for batch in batches:
            texts = text_bytes(batch.column(1))
            for part in buffers(texts):
                ids, begins = encoder.encode(texts[part])
                data, offsets = encoder.vocabulary.decode(ids)
                words = [decimals[number] for number in ids.tolist()]
                places = list(zip(begins[:-1].tolist(), begins[1:].tolist()))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0)[part.start : part.stop],
                        pa.array(np.diff(begins), pa.int64()),
                        pa.array([_sha256(b" ".join(words[a:b])) for a, b in places], pa.string()),
                        pa.array([_sha256(data[offsets[a] : offsets[b]]) for a, b in places], pa.string()),
                    ],
                    ["id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    kind = documents.schema[id].dataType.simpleString()
    return documents.select(id, text).mapInArrow(
        run, f"id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    )


def _sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()
