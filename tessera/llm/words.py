"""Vectorised words and n-gram hashes over whole Arrow text columns.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D; in UTF-8 that is the same as
the characters outside that set.  All functions work on the bytes of a batch of documents at
once, so that the cost of a numpy call is shared by many documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are hashed at a time; bounds the scratch memory, which stays in a core's cache.
SLICE_BYTES = 1 << 18

_U = np.uint64
_IS_WORD = np.ones(256, bool)
_IS_WORD[[0x20, *range(0x09, 0x0E)]] = False


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit values."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One hash for each ordered pair of hashes."""
    return mix(a * _U(0x9E3779B97F4A7C15) + (b ^ (b >> _U(29))) * _U(0xD6E8FEB86659FD93) + _U(0x2545F4914F6CDD1D))


_BYTE = mix(np.arange(1, 257, dtype=_U))
_BYTE_LOWER = _BYTE.copy()
_BYTE_LOWER[ord("A") : ord("Z") + 1] = _BYTE[ord("a") : ord("z") + 1]
_PLACE = mix(np.arange(10_000, 10_000 + 4096, dtype=_U)) | _U(1)


def _places(n: int) -> np.ndarray:
    return _PLACE[:n] if n <= len(_PLACE) else mix(np.arange(10_000, 10_000 + n, dtype=_U)) | _U(1)


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column (null: empty) and the n + 1 offsets of its rows in them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about `most` bytes; a longer row stands alone."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        yield a, b
        a = b


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte and end byte of every word, and the first word of each document (n + 1 values)."""
    inside = _IS_WORD[data]
    before, after = np.empty_like(inside), np.empty_like(inside)
    if len(data):
        before[0], after[-1] = False, False
        before[1:], after[:-1] = inside[:-1], inside[1:]
        cuts = offsets[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < len(data))]
        before[cuts], after[cuts - 1] = False, False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets, "left")


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, *, lower: bool) -> np.ndarray:
    """A 64-bit hash for each word; `lower` takes A-Z as a-z."""
    table, out = _BYTE_LOWER if lower else _BYTE, np.empty(len(starts), _U)
    a = 0
    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(ends, starts[a] + SLICE_BYTES, "right")))
        lengths = ends[a:b] - starts[a:b]
        first = np.cumsum(lengths) - lengths
        place = np.arange(first[-1] + lengths[-1]) - np.repeat(first, lengths)
        code = table[data[place + np.repeat(starts[a:b], lengths)]] * _places(int(lengths.max()))[place]
        out[a:b] = np.add.reduceat(code, first)
        a = b
    return mix(out)


def ngrams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n values from each place on; len(hashes) - n + 1 of them, across documents too."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.zeros(0, _U)
    done, at, power, width = None, 0, hashes, 1
    while True:
        if n & width:
            part = power[at : at + count]
            done = part if done is None else pair(done, part)
            at += width
        if width * 2 > n:
            return done if n > 1 else mix(done)
        power = pair(power[:-width], power[width:])
        width *= 2


def words_of(text: str | None) -> list[bytes]:
    """The words of one text, plainly: bytes.split() splits at just these six bytes."""
    return (text or "").encode("utf-8", "surrogatepass").split()
