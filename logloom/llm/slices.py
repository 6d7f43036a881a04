"""Vectorised work on many byte slices at once: numpy helpers that run inside tasks."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Between texts in a joined buffer; a byte that UTF-8 never contains.
MARK = 0xFF
#: Texts are joined into buffers of about this many bytes; a longer text gets its own.
BUFFER_BYTES = 4 << 20

#: Longer slices are hashed by themselves.
LONG = 64

_FACTOR = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_FACTOR, -1, 1 << 64)


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of every text; a null is an empty text."""
    return [text or b"" for text in column.cast(pa.binary()).to_pylist()]


def buffers(texts: list[bytes], size: int = BUFFER_BYTES) -> Iterator[slice]:
    """Ranges of neighbouring texts that together have about ``size`` bytes."""
    begin, held = 0, 0
    for place, text in enumerate(texts):
        if held and held + len(text) > size:
            yield slice(begin, place)
            begin, held = place, 0
        held += len(text) + 1
    if begin < len(texts):
        yield slice(begin, len(texts))


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts in one buffer with marks before, between and after them, and four zero
    bytes at the end; the second array has where each text begins, then the end."""
    mark = bytes([MARK])
    data = np.frombuffer(mark + mark.join(texts) + mark + bytes(4), np.uint8)
    lengths = np.fromiter((len(text) + 1 for text in texts), np.int64, len(texts))
    return data, np.concatenate(([1], 1 + np.cumsum(lengths)))


def spread(values: np.ndarray) -> np.ndarray:
    """Mix 64-bit values so that every input bit reaches every output bit."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def powers(base: int, count: int) -> np.ndarray:
    result = np.full(count, base, np.uint64)
    result[:1] = 1
    return np.cumprod(result)


class SliceHasher:
    """64-bit hashes of slices of a buffer, equal for slices with equal bytes.

    A slice's hash is a polynomial in its bytes, taken as the difference of two running
    sums over the buffer, so the cost does not depend on how many slices there are. Such
    polynomials modulo 2^64 clash for some long regular texts, whatever their factor, so
    the few slices of more than ``LONG`` bytes are hashed one by one.
    """

    def __init__(self) -> None:
        self._bytes = spread(np.arange(1, 257, dtype=np.uint64))
        self._up = powers(_FACTOR, 0)
        self._down = powers(_INVERSE, 0)

    def __call__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if len(self._up) <= len(data):
            self._up = powers(_FACTOR, len(data) + 1)
            self._down = powers(_INVERSE, len(data) + 1)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self._bytes[data] * self._up[: len(data)], out=sums[1:])
        hashes = (sums[ends] - sums[starts]) * self._down[starts]
        hashes = spread(hashes ^ (ends - starts).astype(np.uint64))
        for place in np.flatnonzero(ends - starts > LONG).tolist():
            whole = hashlib.blake2b(data[starts[place] : ends[place]], digest_size=8)
            hashes[place] = int.from_bytes(whole.digest(), "little")
        return hashes


def same_bytes(
    data: np.ndarray,
    starts: np.ndarray,
    sizes: np.ndarray,
    other: np.ndarray,
    other_starts: np.ndarray,
    other_sizes: np.ndarray,
) -> np.ndarray:
    """Which slices of one buffer equal their slices of another, byte by byte."""
    same = sizes == other_sizes
    rows = np.flatnonzero(same & (sizes > 0))
    length = sizes[rows]
    differ = data[ranges(starts[rows], length)] != other[ranges(other_starts[rows], length)]
    first = np.cumsum(length) - length
    if len(rows):
        same[rows] = np.add.reduceat(differ, first) == 0
    return same


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Places start, start + 1, ... of every range, one range after the other."""
    before = np.cumsum(lengths) - lengths
    return np.arange(int(lengths.sum())) + np.repeat(starts - before, lengths)
