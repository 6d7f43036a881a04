"""Sets of word shingles, as 64-bit hashes."""

from __future__ import annotations

import numpy as np

from logloom.llm.slices import MARK, SliceHasher, buffers, joined, powers, spread

_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E), MARK]] = True


class Shingler:
    """Shingles of ``words`` neighbouring words, white space and case A-Z set aside.

    A text with fewer words has its whole sequence as its one shingle; a text without
    words has none.
    """

    def __init__(self, words: int) -> None:
        self.words = words
        self._hash = SliceHasher()
        self._factors = spread(powers(0x2545F4914F6CDD1D, words + 1)[1:]) | np.uint64(1)

    def sets(self, texts: list[bytes]) -> list[np.ndarray]:
        """The sorted distinct shingles of every text."""
        result = []
        for part in buffers(texts):
            result += self._sets([text.lower() for text in texts[part]])
        return result

    def _sets(self, texts: list[bytes]) -> list[np.ndarray]:
        data, begins = joined(texts)
        white = _WHITE[data[:-4]]
        starts = np.flatnonzero(white[:-1] & ~white[1:]) + 1
        ends = np.flatnonzero(~white[:-1] & white[1:]) + 1
        words = self._hash(data, starts, ends)
        first = np.searchsorted(starts, begins)  # of each text's words
        width = self.words
        whole = np.zeros(len(words), np.uint64)
        for step in range(width):
            whole[: len(words) - step] += words[step:] * self._factors[step]
        whole = spread(whole)
        result = []
        for begin, end in zip(first[:-1].tolist(), first[1:].tolist()):
            if end - begin >= width:
                result.append(np.unique(whole[begin : end - width + 1]))
            elif end > begin:
                short = (words[begin:end] * self._factors[: end - begin]).sum(dtype=np.uint64)
                result.append(spread(np.array([short + np.uint64(end - begin)])))
            else:
                result.append(np.zeros(0, np.uint64))
        return result
