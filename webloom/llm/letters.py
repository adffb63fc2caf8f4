"""Words of letters and their character n-grams, for whole blocks of texts at once.

Texts are put in lower case and laid out as one array of code points.  A word is a run of letters; it is a
(start, end) pair of positions, named by a 64-bit hash of its code points, so that words and grams are found with sorted
arrays instead of Python strings.
"""

from __future__ import annotations

from functools import cache

import numpy as np

from .common import U64, mix, runs_of, span_hashes, tidy

#: Characters of a text handled at a time, cut where no letter stands.
PIECE = 1 << 18
#: Words handled at a time.
SLICE = 1 << 16
_WORD_BASE, _GRAM = 0x9E3779B97F4A7C15, U64(0xD6E8FEB86659FD93)


@cache
def _is_letter() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def _value(points: np.ndarray) -> np.ndarray:
    return mix(points.astype(U64) + U64(0x51ED270B))


def pieces(text: str) -> list[str]:
    """The text in pieces of about PIECE characters, with no word cut in two."""
    if len(text) <= PIECE:
        return [text]
    out, at = [], 0
    while at < len(text):
        to = at + PIECE
        while to < len(text) and text[to].isalpha():
            to += 1
        out.append(text[at:to])
        at = to
    return out


def blocks_of(texts: list[str], size: int = PIECE):
    """(number of each piece's text, pieces) of about `size` characters together."""
    numbers, held, n = [], [], 0
    for i, text in enumerate(texts):
        for piece in pieces(text):
            if n and n + len(piece) > size:
                yield numbers, held
                numbers, held, n = [], [], 0
            numbers.append(i)
            held.append(piece)
            n += len(piece)
    if held:
        yield numbers, held
    tidy()


class Letters:
    """Words of some texts: code points, word starts and ends, each word's hash and text number."""

    def __init__(self, texts: list[str], numbers: list[int] | None = None):
        low = [t.lower() for t in texts]
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in low], dtype=np.int64)]).astype(np.int64)
        self.points = np.frombuffer("".join(low).encode("utf-32-le"), np.uint32)
        self.starts, self.ends = runs_of(_is_letter()[self.points], offsets)
        of = np.searchsorted(offsets, self.starts, side="right") - 1
        self.texts = of if numbers is None else np.array(numbers, np.int64)[of]
        self.hashes = span_hashes(lambda a, b: _value(self.points[a:b]), self.starts, self.ends, _WORD_BASE)

    def slices(self, size: int = SLICE):
        """For every `size` words: their text numbers, the position of a first example of each distinct word, and each word's distinct one."""
        for a in range(0, len(self.starts), size):
            own = slice(a, a + size)
            _, example, distinct = np.unique(self.hashes[own], return_index=True, return_inverse=True)
            yield self.texts[own], example + a, distinct

    def padded(self, words: np.ndarray, left: int, right: int) -> tuple[np.ndarray, np.ndarray]:
        """Code points of these words, each between two border characters, one after the other; and each word's first (n + 1)."""
        size = self.ends[words] - self.starts[words] + 2
        first = np.concatenate([[0], np.cumsum(size)])
        place = np.repeat(self.starts[words] - 1 - first[:-1], size) + np.arange(first[-1])
        borders = np.zeros(first[-1], bool)
        borders[first[:-1]] = borders[first[1:] - 1] = True
        out = np.empty(first[-1], np.uint32)
        out[~borders] = self.points[place[~borders]]
        out[first[:-1]], out[first[1:] - 1] = left, right
        return out, first


def gram_hashes(points: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k code points from each position on: len(points) - k + 1."""
    n = len(points) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    value, out = _value(points), np.full(n, k, U64)
    for i in range(k):
        out *= _GRAM
        out += value[i : i + n]
    return mix(out)


def ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin, begin + 1, ... for each size, one after the other."""
    return np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())
