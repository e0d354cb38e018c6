"""Word shingles of texts as sorted sets of 64-bit hashes, computed for many texts at a time in numpy."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from parcelmint.llm.langid import texts_in

#: Bytes of text that a task shingles at a time.
_BYTES = 500_000
#: An odd multiplier for the rolling sum, and its inverse modulo 2**64.
_BASE = 0x9E3779B97F4A7C15 | 3
_INVERSE = pow(_BASE, -1, 1 << 64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@functools.lru_cache(1)
def _byte_numbers() -> np.ndarray:
    """A number for every byte, A-Z as a-z."""
    number = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
    number[65:91] = number[97:123]
    return number


#: Bytes between words: white space; and all ASCII but letters, digits and the apostrophe.
SPACE = np.isin(np.arange(256), [32, *range(9, 14)])
NOT_LETTERS = np.array([c < 128 and not (chr(c).isalnum() or c == 39) for c in range(256)])


@functools.lru_cache(2)
def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def words_in(data: np.ndarray, first: np.ndarray, size: np.ndarray, between: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The words of all texts data[first : first + size], one after another: hash, first byte and end of each, and each text's first word and end.

    Words are runs of bytes that are not `between`, A-Z lower-cased.
    """
    n = len(data)
    top = 1 << max(19, (n + 1).bit_length())
    is_word = ~between[data]
    edge = np.zeros(n + 1, bool)
    edge[first] = True
    edge[first + size] = True
    start = np.flatnonzero(is_word & (edge[:n] | ~np.concatenate([[False], is_word[:-1]])))
    end = np.flatnonzero(is_word & (edge[1:] | ~np.concatenate([is_word[1:], [False]]))) + 1
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_byte_numbers()[data] * _powers(_BASE, top)[:n], dtype=np.uint64)])
    word = mixed((sums[end] - sums[start]) * _powers(_INVERSE, top)[start] + (end - start).astype(np.uint64))
    return word, start, end, np.searchsorted(start, first), np.searchsorted(start, first + size)


def shingle_sets(data: np.ndarray, first: np.ndarray, size: np.ndarray, words: int) -> list[np.ndarray]:
    """For each text: the distinct hashes of its runs of `words` words (see words_in), sorted.

    A text with fewer words has its whole sequence as one shingle; one without words has none. Unequal shingles
    have equal hashes with odds of about 2**-57 a pair.
    """
    if not len(data):
        return [np.zeros(0, np.uint64)] * len(size)
    word, _, _, lo, hi = words_in(data, first, size)
    runs = word
    for k in range(1, words):
        runs = mixed(runs[:-1] * np.uint64(_BASE) + word[k:]) if len(runs) > 1 else runs[:0]
    out = []
    for a, b in zip(lo.tolist(), hi.tolist()):
        if b - a >= words:
            out.append(np.unique(runs[a : b - words + 1]))
        elif b > a:
            h = word[a : a + 1]
            for k in range(a + 1, b):
                h = mixed(h * np.uint64(_BASE) + word[k : k + 1])
            out.append(h + np.uint64(b - a))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def sets_in(column: pa.Array, words: int) -> Iterator[tuple[int, int, list[np.ndarray]]]:
    """Runs of a column's texts: from, to and their shingle sets."""
    for a, b, data, first, size in texts_in(column, _BYTES):
        yield a, b, shingle_sets(data, first, size, words)


def list_array(parts: list[np.ndarray]) -> pa.Array:
    """Arrays of 64-bit numbers as one column of lists of long."""
    ends = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    flat = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64)))
