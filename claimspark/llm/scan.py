"""Vectorised reading of text columns inside Arrow tasks.

A text column arrives in a task as one byte buffer plus offsets.  The helpers
here find words in that buffer and hash words and word windows with numpy, a
bounded chunk of documents at a time, so that no Python code runs per word.

Hashes are 64 bits wide: polynomials over random byte values, summed with one
prefix sum per chunk and then mixed.  The functions are deterministic, so a
retried task gives the same rows.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20
POWERS_STEP = 1 << 20  # tables of powers grow by it

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_POWERS: dict[str, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every input bit over all 64 output bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(name: str, base: np.uint64, n: int) -> np.ndarray:
    """The first ``n`` powers of ``base`` modulo 2**64, kept per worker."""
    have = _POWERS.get(name)
    if have is None or len(have) < n:
        size = -(-(n - 1) // POWERS_STEP) * POWERS_STEP + 1
        have = np.full(size, base, np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if n <= 16 * CHUNK_BYTES:  # one very long text does not stay in memory
            _POWERS[name] = have
    return have[:n]


def release() -> None:
    """Gives freed memory back to the system: a reused task process would keep it for good.

    Does nothing where the C library has no ``malloc_trim``.
    """
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def byte_values(fold: bool) -> np.ndarray:
    """A random odd 64-bit value for each byte; A-Z as a-z if ``fold``."""
    values = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)
    if fold:
        values[ord("A"):ord("Z") + 1] = values[ord("a"):ord("z") + 1]
    return values


def byte_set(codes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(codes)] = True
    return table


#: Words of ASCII letters, digits and everything beyond ASCII.
ALNUM_WORDS = byte_set([*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)])
#: Words of everything but ASCII white space.
SPACED_WORDS = ~byte_set([0x20, *range(0x09, 0x0E)])


def text_chunks(col: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of runs of whole texts.

    A run holds at most ``limit`` bytes, or one text that is longer.  A null
    text has no bytes.  Behind the last run, freed memory goes back to the system.
    """
    if col.null_count:
        col = pc.fill_null(col, "")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offsets, data = col.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[col.offset:col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    lo = 0
    while lo < len(col):
        hi = int(np.searchsorted(off, off[lo] + limit, "right")) - 1
        hi = min(max(hi, lo + 1), len(col))
        yield lo, hi, raw[off[lo]:off[hi]], off[lo:hi + 1] - off[lo]
        lo = hi
    release()


def spans(data: np.ndarray, off: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): maximal runs of ``table`` bytes inside each text.

    Text d has the words first[d] to first[d + 1] - 1.
    """
    inside = table[data]
    before = np.zeros(len(data) + 1, bool)
    before[1:] = inside
    before[off] = False
    after = np.zeros(len(data) + 1, bool)
    after[:-1] = inside
    after[off] = False
    starts = np.flatnonzero(inside & ~before[:-1])
    ends = np.flatnonzero(inside & ~after[1:]) + 1
    return starts, ends, np.searchsorted(starts, off)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(values[data] * _powers("up", _BASE, len(data)), out=sums[1:])
    return mix((sums[ends] - sums[starts]) * _powers("down", _INVERSE, len(data) + 1)[starts])


def window_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each run of k words; one for each possible start."""
    n = len(words)
    if n < k:
        return np.empty(0, np.uint64)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(words * _powers("up", _BASE, n), out=sums[1:])
    return mix((sums[k:] - sums[:n - k + 1]) * _powers("down", _INVERSE, n + 1)[:n - k + 1] + np.uint64(k))


def window_starts(first: np.ndarray, k: int) -> np.ndarray:
    """Word numbers at which k words of one text start."""
    count = np.maximum(np.diff(first) - k + 1, 0)
    skip = np.repeat(first[:-1] - (np.cumsum(count) - count), count)
    return np.arange(count.sum()) + skip


def owner(first: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The text that each word belongs to."""
    return np.searchsorted(first, words, "right") - 1


def signed(h: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(h).view(np.int64))


def lists(values: pa.Array, counts: np.ndarray) -> pa.Array:
    """A list array: ``counts[i]`` values in list i."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), values)


def join_words(data: np.ndarray, off: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray,
               kept: np.ndarray) -> pa.Array:
    """Each text as its kept words, joined by one blank."""
    s, e = starts[kept], ends[kept]
    inside = np.zeros(len(data) + 1, np.int8)
    inside[s] = 1
    np.subtract.at(inside, e, 1)
    mask = np.cumsum(inside[:-1], dtype=np.int8).astype(bool)
    doc = owner(first, np.flatnonzero(kept))
    blank = s[1:][doc[1:] == doc[:-1]] - 1  # the byte before a kept word, unless the text begins with it
    out = data.copy()
    out[blank] = 0x20
    mask[blank] = True
    ends_at = np.concatenate([[0], np.cumsum(mask)])[off].astype(np.int32)
    return pa.StringArray.from_buffers(len(off) - 1, pa.py_buffer(ends_at), pa.py_buffer(out[mask].tobytes()))
