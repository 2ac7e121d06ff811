"""Words and word shingles of whole Arrow batches as 64-bit hashes, in numpy.

Words are [^\\x20\\x09-\\x0D]+ after lower-casing A-Z. Two different words (or shingles) share a hash
with a chance of about 2**-64; hashes are the same in every process.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
SHINGLE = 5
#: Bytes of text that are hashed at once; bounds the working memory of a task, but for a single longer text.
BLOCK = 1_000_000


def lean(run: Callable) -> Callable:
    """run works through the batches of a task; after the last one, what its arrays have left behind goes back to the system, since Python workers stay for other tasks."""

    @functools.wraps(run)
    def whole(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (OSError, AttributeError):  # another C library
            pass

    return whole


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers (the splitmix64 finaliser)."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))
_BYTE[65:91] = _BYTE[97:123]
_SEP = np.zeros(256, bool)
_SEP[[0x20, *range(0x09, 0x0E)]] = True
_BASE = U(0xD6E8FEB86659FD93)
_PLACE = mix(np.arange(101, 101 + SHINGLE, dtype=U)) | U(1)


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, U(base))
    out[:1] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


_POW = {"up": _powers(1, int(_BASE)), "down": _powers(1, int(_BASE))}


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POW["up"]) < n:
        n = max(n, BLOCK + 4096)
        _POW["up"], _POW["down"] = _powers(n, int(_BASE)), _powers(n, pow(int(_BASE), -1, 2**64))
    return _POW["up"], _POW["down"]


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a column and each text's offsets in them; nulls are empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def word_spans(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = _SEP) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and where each text's words begin (one entry more than texts). separators: which of the 256 bytes part words."""
    sep = separators[data]
    before = np.ones(len(data) + 1, bool)
    before[1:] = sep
    before[offsets[:-1]] = True
    starts = np.flatnonzero(before[:-1] & ~sep)
    after = np.ones(len(data) + 1, bool)
    after[:-1] = sep
    after[offsets[1:]] = True
    ends = np.flatnonzero(after[1:] & ~sep) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    up, down = _tables(len(data) + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(len(data) + 1, U)
        np.cumsum(_BYTE[data] * up[: len(data)], out=total[1:])
        return mix((total[ends] - total[starts]) * down[starts])


def hash_shingles(words: np.ndarray, k: int = SHINGLE) -> np.ndarray:
    """All k-word shingles of one text, in order; of fewer words, the whole sequence as one; of none, nothing."""
    n = len(words)
    if not n:
        return words
    with np.errstate(over="ignore"):
        if n < k:
            return mix(np.array([(words * _PLACE[:n]).sum(dtype=U) + U(n)]))
        out = words[: n - k + 1] * _PLACE[0]
        for j in range(1, k):
            out += words[j : n - k + 1 + j] * _PLACE[j]
        return mix(out)


def blocks(texts: pa.Array | pa.ChunkedArray, size_of: int | None = None) -> Iterator[tuple[int, pa.Array]]:
    """Slices of a column of about BLOCK bytes (or size_of), with the number of their first row."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    size = np.asarray(pc.fill_null(pc.binary_length(texts), 0), np.int64)
    cut = np.cumsum(size) // (size_of or BLOCK)
    at = 0
    for end in [*(np.flatnonzero(np.diff(cut)) + 1), len(texts)]:
        if end > at:
            yield at, texts.slice(at, end - at)
        at = end


def texts_words(texts: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(row number, hashes of the words in order) of every text of a column."""
    for first, part in blocks(texts):
        data, offsets = text_bytes(part)
        starts, ends, at = word_spans(data, offsets)
        words = hash_words(data, starts, ends)
        for i in range(len(part)):
            yield first + i, words[at[i] : at[i + 1]]
