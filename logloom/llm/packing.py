"""Packing: token sequences of one size, filled from whole texts with little padding.

Every text is cut at multiples of the window; what is left over is a shorter piece, and a
piece that nothing complements may be cut once more to fill a gap. How
often each length occurs is a histogram with at most one bin per length, whatever the
amount of data, and the driver plans on it alone: it enumerates shallow combinations of
lengths that fill the window, finds how often to use each one by non-negative least
squares against the histogram, rounds down, and fills the rest greedily. Pieces of one
length are interchangeable, so a piece's place follows from its rank among them.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logloom.llm.bpe import Encoder, Vocabulary
from logloom.llm.slices import buffers, text_bytes
from logloom.llm.tables import stored

WINDOW = 2048
END_ID = 1
#: Pieces may be cut a second time at multiples of this.
GRID = 64
#: Pieces of one length are ranked in independent parts of about so many, at least 64 parts.
PART_ROWS = 100_000
#: Uncut pieces, and the later halves of pieces cut a second time.
UNCUT, LATER = 0, 1


# --- tokens ----------------------------------------------------------------------


def read_tokenizer(path: str) -> tuple[Vocabulary, dict[bytes, int]]:
    """Vocabulary and added tokens of a byte-level BPE in the tokenizers JSON format.

    There a byte that is no printable Latin-1 sign is written as the next free code point
    from 256 on.
    """
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [value for value in range(256) if value not in printable]
    byte_of = {chr(value): value for value in printable}
    byte_of |= {chr(256 + place): value for place, value in enumerate(hidden)}
    added = {token["content"]: token["id"] for token in spec["added_tokens"]}
    vocabulary = Vocabulary.of(
        {
            bytes(byte_of[sign] for sign in token): number
            for token, number in spec["model"]["vocab"].items()
            if token not in added
        }
    )
    return vocabulary, {token.encode(): number for token, number in added.items()}


def encode_with_added(
    encoder: Encoder, texts: list[bytes], added: dict[bytes, int]
) -> list[np.ndarray]:
    """Ids of every text; an added token in a text is one id and splits the text."""
    parts, joints = [], []  # joints: by text, the ids between its parts
    for text in texts:
        between: list[int] = []
        rest = text
        while found := min(
            ((rest.find(token), -len(token), token) for token in added if token in rest),
            default=None,
        ):
            parts.append(rest[: found[0]])
            between.append(added[found[2]])
            rest = rest[found[0] + len(found[2]) :]
        parts.append(rest)
        joints.append(between)
    ids, begins = encoder.encode(parts)
    result, part = [], 0
    for between in joints:
        if between:
            own = [ids[begins[part] : begins[part + 1]]]
            for step, number in enumerate(between, 1):
                own += [[number], ids[begins[part + step] : begins[part + step + 1]]]
            result.append(np.concatenate(own))
        else:
            result.append(ids[begins[part] : begins[part + 1]])
        part += len(between) + 1
    return result


def checksums(piece: np.ndarray) -> tuple[bytes, bytes]:
    """Checksums of what lies before and after every multiple of ``GRID`` within the piece."""
    data = memoryview(piece.tobytes())
    step = 4 * GRID
    head, heads = 0, []
    for end in range(step, len(data), step):
        head = zlib.crc32(data[end - step : end], head)
        heads.append(head)
    tails = [zlib.crc32(data[end:]) for end in range(step, len(data), step)]
    return np.array(heads, "<u4").tobytes(), np.array(tails, "<u4").tobytes()


def cut(
    documents: DataFrame, path: str, window: int = WINDOW, id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Pieces of every text's ids, each at most ``window`` long, an end id included.

    Returns ``id, start, length, ids_crc32, doc_tokens, heads, tails``; a null or empty text is
    one piece that holds the end id alone. The last two have the checksums before and after
    every multiple of ``GRID`` in a piece shorter than the window, 32 bits each.
    """
    vocabulary, added = read_tokenizer(path)
    arrays = documents.sparkSession.sparkContext.broadcast(vars(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(Vocabulary(**arrays.value))
        for batch in batches:
            texts = text_bytes(batch.column(1))
            for part in buffers(texts):
                rows = []
                encoded = encode_with_added(encoder, texts[part], added)
                for place, ids in enumerate(encoded, part.start):
                    ids = np.append(ids, END_ID).astype("<u4")
                    for start in range(0, len(ids), window):
                        piece = ids[start : start + window]
                        sums = checksums(piece) if len(piece) < window else (b"", b"")
                        rows.append((place, start, len(piece), zlib.crc32(piece), len(ids), *sums))
                place, *columns, heads, tails = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(place, pa.int64())),
                        *(pa.array(column, pa.int64()) for column in columns),
                        pa.array(heads, pa.binary()),
                        pa.array(tails, pa.binary()),
                    ],
                    ["id", "start", "length", "ids_crc32", "doc_tokens", "heads", "tails"],
                )

    kind = documents.schema[id].dataType.simpleString()
    return documents.select(id, text).mapInArrow(
        run,
        f"id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, "
        "heads binary, tails binary",
    )


# --- the plan --------------------------------------------------------------------


def combinations(lengths: np.ndarray, window: int) -> np.ndarray:
    """Shallow combinations that fill the window: rows of three lengths, 0 for none.

    All pairs, and all triples in which one length is a multiple of a 32nd of the window.
    """
    present = np.zeros(window + 1, bool)
    present[lengths] = True
    one = np.flatnonzero(present[:window])
    pairs = np.stack([np.zeros_like(one), one, window - one], 1)
    step = max(1, window // 32)
    middle = np.arange(step, window, step)
    first, second = (grid.ravel() for grid in np.meshgrid(one, middle))
    third = window - first - second
    triples = np.stack([first, second, third], 1)[third > 0]
    rows = np.unique(np.sort(np.concatenate([pairs, triples]), axis=1), axis=0)
    return rows[(present[rows] | (rows == 0)).all(1) & (rows[:, 1] > 0)]


def non_negative_least_squares(
    rows: np.ndarray, counts: np.ndarray, rounds: int = 200
) -> np.ndarray:
    """How often to use each combination so that the lengths used come near the counts.

    Accelerated projected gradient; each column has at most three entries, so a round
    costs as much as reading the combinations once.
    """
    target = counts.astype(float)
    target[0] = 0

    def used(times: np.ndarray) -> np.ndarray:
        total = sum(np.bincount(column, times, len(counts)) for column in rows.T)
        total[0] = 0
        return total

    bound = np.ones(len(rows))
    for _ in range(12):  # the largest eigenvalue, for the step
        seen = used(bound)
        bound = seen[rows].sum(1)
        size = np.linalg.norm(bound)
        bound /= size
    step = 1 / (1.05 * size)
    times = ahead = np.zeros(len(rows))
    pace = 1.0
    for _ in range(rounds):
        miss = used(ahead) - target
        better = np.maximum(0, ahead - step * miss[rows].sum(1))
        next_pace = (1 + np.sqrt(1 + 4 * pace * pace)) / 2
        ahead = better + (pace - 1) / next_pace * (better - times)
        times, pace = better, next_pace
    return times


#: A piece in a combination: its kind, its length there, and its length before the second
#: cut where only its first part is used, else the same length.
Item = tuple[int, int, int]


def _greedy(left: np.ndarray, window: int) -> Iterator[tuple[list[Item], int]]:
    """Combinations for what is left: the longest piece, then ever the longest that fits.

    A smaller power of two takes the window's place where it comes out even, since a
    sequence of such a size needs no padding. Where neither does, an uncut piece is cut so
    that its first part fills the gap; the second part joins what is left, as ``LATER``.
    """
    left = np.stack([left, np.zeros_like(left)])

    def fill(longest: int, size: int) -> tuple[list[Item], int]:
        items, room, top = [], size, longest
        while room:
            fits = np.flatnonzero(left[:, 1 : min(room, top) + 1].any(0))
            if not len(fits):
                break
            top = int(fits[-1]) + 1
            for kind in (LATER, UNCUT):
                times = min(room // top, int(left[kind, top]))
                items += [(kind, top, top)] * times
                room -= top * times
            top -= 1
        return items, room

    while left.any():
        longest = int(np.flatnonzero(left.any(0))[-1])
        items, room = fill(longest, window)
        size = window // 2
        while room and size >= longest:
            even, rest = fill(longest, size)
            if not rest:
                items, room = even, 0
            size //= 2
        first = room // GRID * GRID
        if first:
            spare = left[UNCUT].copy()
            for kind, length, _ in items:
                spare[length] -= kind == UNCUT
            whole = np.flatnonzero(spare[first + 1 :])
            if len(whole):
                items.append((UNCUT, first, first + 1 + int(whole[-1])))
        used = np.zeros_like(left)
        for kind, _, whole in items:
            used[kind, whole] += 1
        times = int((left[used > 0] // used[used > 0]).min())
        left -= used * times
        for _, length, whole in items:
            if length < whole:
                left[LATER, whole - length] += times
        yield items, times


def plan(counts: np.ndarray, window: int = WINDOW) -> list[tuple[list[Item], int]]:
    """Combinations and how often to use each; together they use every piece once.

    ``counts[n]`` pieces have length n, 0 < n <= window.
    """
    left = counts.astype(np.int64).copy()
    result = [([(UNCUT, window, window)], int(left[window]))] if left[window] else []
    left[window] = 0
    if left.any():
        rows = combinations(np.flatnonzero(left), window)
        if len(rows):
            times = non_negative_least_squares(rows, left)
            for place in np.argsort(-times, kind="stable"):
                if times[place] < 1:
                    break
                lengths = rows[place][rows[place] > 0]
                kinds, each = np.unique(lengths, return_counts=True)
                repeats = int(min(times[place], (left[kinds] // each).min()))
                if repeats:
                    left[kinds] -= each * repeats
                    result.append(([(UNCUT, n, n) for n in lengths[::-1].tolist()], repeats))
        result += _greedy(left, window)
    return result


def _slots(combined: list[tuple[list[Item], int]], window: int) -> dict[str, np.ndarray]:
    """For ranks from ``first`` on of a kind and length: the sequence of that rank, the offset,
    where the piece is cut again (0: not) and the rank of its later part among such parts."""
    taken = np.zeros((2, window + 1), np.int64)
    made = np.zeros(window + 1, np.int64)
    rows, sequence = [], 0
    for items, times in combined:
        offset = 0
        for kind, length, whole in items:
            first, later = int(taken[kind, whole]), 0
            taken[kind, whole] += times
            if length < whole:
                later = int(made[whole - length])
                made[whole - length] += times
            again = length if length < whole else 0
            rows.append((_slot_key(kind, whole, first), first, sequence, offset, again, later))
            offset += length
        sequence += times
    rows.sort()
    names = ("key", "first", "sequence", "offset", "cut", "later")
    return dict(zip(names, np.array(rows, np.int64).reshape(-1, len(names)).T))


def _slot_key(kind, length, rank):
    return kind << 60 | length << 44 | rank


# --- operator --------------------------------------------------------------------


def pack(
    documents: DataFrame, path: str, window: int = WINDOW, id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Pieces of all texts and where each stands in the sequences.

    Returns ``id, start, length, ids_crc32, doc_tokens, sequence_id, offset``. A sequence
    is padded to the window unless its pieces add up to a power of two. Null and empty
    texts are a piece with the end id alone; repeated rows are packed as often as they
    occur; other columns are not read, whatever they are called; an empty table gives no pieces.
    """
    pieces = stored(cut(documents, path, window, id, text), "pieces")
    counts = np.zeros(window + 1, np.int64)
    for row in pieces.groupBy("length").count().collect():  # at most one per length
        counts[row["length"]] = row["count"]
    slots = pieces.sparkSession.sparkContext.broadcast(_slots(plan(counts, window), window))

    parts = max(64, int(counts.max()) // PART_ROWS)
    pieces = pieces.withColumn("part", F.pmod(F.xxhash64("id", "start", "ids_crc32"), F.lit(parts)))
    in_part = Window.partitionBy("length", "part").orderBy("id", "start", "ids_crc32")
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = (
        pieces.groupBy("length", "part")
        .count()
        .select("length", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    )
    ranked = (
        pieces.withColumn("rank", F.row_number().over(in_part) - 1)
        .join(sizes, ["length", "part"])
        .select(
            "id", "start", "length", "ids_crc32", "doc_tokens", "heads", "tails",
            (F.col("rank") + F.col("before")).alias("rank"),
        )
    )

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = slots.value

        def put(frame: pd.DataFrame, kind: int, rank: np.ndarray) -> np.ndarray:
            own = _slot_key(kind, frame["length"].to_numpy(), rank)
            slot = np.searchsorted(table["key"], own, side="right") - 1
            frame["sequence_id"] = table["sequence"][slot] + rank - table["first"][slot]
            frame["offset"] = table["offset"][slot]
            return slot

        for frame in frames:
            rank = frame.pop("rank").to_numpy()
            sums = frame.pop("heads"), frame.pop("tails")
            slot = put(frame, UNCUT, rank)
            again = table["cut"][slot]
            rows = np.flatnonzero(again)
            if len(rows):
                later = frame.iloc[rows].copy()
                at = again[rows]
                head, tail = (
                    [
                        int.from_bytes(column.iat[row][4 * n - 4 : 4 * n], "little")
                        for row, n in zip(rows, at // GRID)
                    ]
                    for column in sums
                )
                later["start"] += at
                later["length"] -= at
                later["ids_crc32"] = tail
                put(later, LATER, (table["later"][slot] + rank - table["first"][slot])[rows])
                frame.iloc[rows, frame.columns.get_loc("length")] = at
                frame.iloc[rows, frame.columns.get_loc("ids_crc32")] = head
                yield later
            yield frame

    kind = documents.schema[id].dataType.simpleString()
    return ranked.mapInPandas(
        place,
        f"id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, "
        "sequence_id bigint, offset bigint",
    )
