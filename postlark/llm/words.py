"""Words of many texts as numpy arrays: places and 64-bit hashes, without a Python object for each word.

A word is a maximal run of ASCII letters and digits and of code points from
U+0080 on, in lower case; everything else separates.  Hashes read whole words.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

from postlark.llm.common import mix64

IS_WORD = np.zeros(256, bool)
IS_WORD[0x30:0x3A] = IS_WORD[0x41:0x5B] = IS_WORD[0x61:0x7B] = IS_WORD[0x80:] = True

#: Keeps the first n of eight little-endian bytes.
_FIRST = np.array([(1 << (8 * n)) - 1 for n in range(8)] + [2**64 - 1], np.uint64)
_ODD = np.uint64(0x9E3779B97F4A7C15)


class Words(NamedTuple):
    """Words of a batch of texts; ``bounds[i]:bounds[i + 1]`` are text i's."""

    buffer: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray
    text_starts: np.ndarray


def find_words(texts: list[str | None]) -> Words:
    """Null counts as empty.  Byte places are those of all texts in a row, one zero byte after each."""
    encoded = [(t or "").lower().encode("utf-8", "surrogatepass") for t in texts]
    buffer = np.frombuffer(b"\0".join([*encoded, b"\0" * 16]), np.uint8)
    edges = np.diff(IS_WORD[buffer].view(np.int8), prepend=np.int8(0))
    starts, ends = np.nonzero(edges == 1)[0], np.nonzero(edges == -1)[0]
    text_starts = np.cumsum([0, *(len(e) + 1 for e in encoded)])
    return Words(buffer, starts, ends, np.searchsorted(starts, text_starts), text_starts)


def _eight(buffer: np.ndarray) -> np.ndarray:
    """At each place, the eight bytes from there on as one integer."""
    return np.ndarray(len(buffer) - 7, "<u8", buffer, strides=(1,))


def hash_words(words: Words) -> np.ndarray:
    at, left, eight = words.starts.copy(), words.ends - words.starts, _eight(words.buffer)
    out = mix64(left.astype(np.uint64) + _ODD)
    rows = np.arange(len(at))
    while len(rows):
        chunk = eight[at[rows]] & _FIRST[np.minimum(left[rows], 8)]
        out[rows] = mix64(out[rows] ^ chunk) * _ODD
        at[rows] += 8
        left[rows] -= 8
        rows = rows[left[rows] > 0]
    return mix64(out)


def hash_prefixes(words: Words, size: int) -> np.ndarray:
    """Hashes of the words' first ``size`` bytes, 7 at most (shorter words whole)."""
    length = np.minimum(words.ends - words.starts, size)
    return mix64((_eight(words.buffer)[words.starts] & _FIRST[length]) + np.uint64(size))


def windows(hashes: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of ``size`` words that stay inside one text, and each run's first word."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out = (out ^ hashes[k:k + n]) * _ODD
        out ^= out >> np.uint64(29)
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    inside = np.nonzero(text[:n] == text[size - 1:])[0]
    return mix64(out[inside]), inside
