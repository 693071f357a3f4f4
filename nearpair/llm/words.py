"""Words of many texts at once, as 64-bit hashes in numpy arrays.

A word is a run of bytes other than space and \\x09-\\x0D, with A-Z lower-cased. The hash is a
polynomial over the bytes modulo 2**64, finished by a bijective mix, so equal words have equal
hashes everywhere and different ones collide with a chance near 2**-64 a pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

SEGMENT = 1 << 20  # bytes hashed at once; only a longer word makes a longer segment
CHUNK = 4 << 20  # bytes of text in one chunk; only a longer text makes a longer chunk

_BASE = 0x9E3779B97F4A7C15 | 1
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LETTERS = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])  # ends a word: punctuation too
_CODE = np.arange(1, 257, dtype=np.uint64)
_CODE[65:91] += np.uint64(32)
_TABLES: list[np.ndarray] = []


class Words(NamedTuple):
    hashes: np.ndarray  # uint64, one per word
    doc: np.ndarray  # int64, index of the text, not falling
    size: np.ndarray  # int64, bytes of the word
    wide: np.ndarray  # bool, the word has a byte above 127
    bounds: np.ndarray  # int64, words of text i are bounds[i]:bounds[i + 1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse, up to n."""
    if not _TABLES or len(_TABLES[0]) < n:
        n = max(n, SEGMENT)
        inverse = pow(_BASE, -1, 1 << 64)
        _TABLES[:] = [
            np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, b, np.uint64))])
            for b in (_BASE, inverse)
        ]
    return _TABLES


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the byte spans, which must not overlap and lie in order."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        low = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, low + SEGMENT, "right")))
        part = data[low : ends[j - 1]]
        power, inverse = _powers(len(part) + 1)
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_CODE[part] * power[: len(part)], out=sums[1:])
        s, e = starts[i:j] - low, ends[i:j] - low
        out[i:j] = (sums[e] - sums[s]) * inverse[s]
        i = j
    return mix(out + (ends - starts).astype(np.uint64))


def words_of(data: np.ndarray, offsets: np.ndarray, ends_word: np.ndarray = _SPACE) -> Words:
    """Words of the texts data[offsets[i]:offsets[i + 1]]."""
    data = data[offsets[0] : offsets[-1]]
    offsets = (offsets - offsets[0]).astype(np.int64)
    word = ~ends_word[data]
    edge = np.zeros(len(data) + 1, bool)  # a text begins here
    edge[offsets] = True
    before = np.concatenate([[False], word[:-1]]) if len(word) else word
    starts = np.flatnonzero(word & (~before | edge[:-1]))
    after = np.concatenate([word[1:], [False]]) if len(word) else word
    ends = np.flatnonzero(word & (~after | edge[1:])) + 1
    doc = np.searchsorted(offsets, starts, "right") - 1
    high = np.concatenate([[0], np.cumsum(data > 127)])
    bounds = np.searchsorted(starts, offsets)
    return Words(
        hash_spans(data, starts, ends), doc, ends - starts, high[ends] > high[starts], bounds
    )


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a text column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data or b"", np.uint8), offsets


def chunks(
    batches: Iterator[pa.RecordBatch], text: str = "text", ends_word: np.ndarray = _SPACE
) -> Iterator[tuple[pa.RecordBatch, Words]]:
    """Slices of the batches of about CHUNK bytes of text, with their words."""
    for batch in batches:
        data, offsets = text_buffer(batch.column(text))
        i, n = 0, batch.num_rows
        while i < n:
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + CHUNK, "right")) - 1)
            yield batch.slice(i, j - i), words_of(data, offsets[i : j + 1], ends_word)
            i = j


def word_hashes(words: list[str]) -> np.ndarray:
    """Hashes of single words, as in `words_of`."""
    raw = [w.encode() for w in words]
    ends = np.cumsum([len(w) for w in raw], dtype=np.int64)
    starts = ends - np.array([len(w) for w in raw], np.int64)
    return hash_spans(np.frombuffer(b"".join(raw), np.uint8), starts, ends)
