"""Splitting text into byte-level pre-tokens with numpy.

The pattern of the byte-level vocabularies is alternatives over four kinds of
characters (letter, number, white space, other).  A chunk of texts is split at
once from the kinds of its bytes; the rules below say where a pre-token starts.
The kinds come from the library whose results are to be matched, because
libraries differ in their Unicode version.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np

OTHER, LETTER, NUMBER, WHITE = 0, 1, 2, 3


def every_character() -> str:
    return "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))


def kind_table(matched: Callable[[str], str]) -> bytes:
    """The kind of each code point, packed; ``matched`` gives all characters that a pattern matches."""
    table = np.zeros(0x110000, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (WHITE, r"\s+")):
        table[np.array(sorted(set(map(ord, matched(pattern)))), np.int64)] = kind
    return zlib.compress(table.tobytes())


def unpack_kinds(packed: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(packed), np.uint8)


def _byte_kinds(data: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """The kind of the character that each byte belongs to."""
    out = kinds[:256][data]
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        size = 2 + (data[lead] >= 0xE0).astype(np.int64) + (data[lead] >= 0xF0)
        code = (data[lead] & np.array([0x1F, 0x0F, 0x07])[size - 2]).astype(np.int64)
        last = len(data) - 1
        for k in (1, 2, 3):
            more = size > k
            code = np.where(more, (code << 6) | (data[np.minimum(lead + k, last)] & 0x3F), code)
        kind = kinds[np.minimum(code, 0x10FFFF)]
        for k in (0, 1, 2, 3):
            more = (size > k) & (lead + k <= last)
            out[lead[more] + k] = kind[more]
    return out


def pre_tokens(data: np.ndarray, off: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first) of the pre-tokens of each text; they cover every byte."""
    n = len(data)
    if n == 0:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(off), np.int64)
    kind = _byte_kinds(data, kinds)
    text_start = np.zeros(n + 1, bool)
    text_start[off] = True
    run = text_start.copy()
    run[1:n] |= kind[1:] != kind[:-1]
    run[n] = True
    start = run.copy()

    # white space before another character of the same text: its last character goes on its own, a blank
    # with what follows
    after = np.flatnonzero(run[:n] & ~text_start[:n])
    after = after[(kind[after - 1] == WHITE)]
    last = after - 1
    while True:  # back to the first byte of the last character
        inner = (data[last] & 0xC0) == 0x80
        if not inner.any():
            break
        last = last - inner
    blank = data[last] == 0x20
    start[last] = True
    start[after[blank]] = False

    # an apostrophe that starts a run, not after a blank, takes a contraction's letters
    at = np.flatnonzero(run[:n] & (data == 0x27))
    at = at[text_start[at] | (data[np.maximum(at - 1, 0)] != 0x20)]
    stop = off[np.searchsorted(off, at, "right")]
    padded = np.concatenate([data, np.zeros(2, np.uint8)])
    a, b = padded[at + 1], padded[at + 2]
    one = np.isin(a, np.frombuffer(b"stmd", np.uint8)) & (at + 1 < stop)
    two = (((b == ord("e")) & ((a == ord("r")) | (a == ord("v")))) | ((a == ord("l")) & (b == ord("l")))) & (at + 2 < stop)
    for which, size in ((one, 2), (two & ~one, 3)):
        start[at[which] + 1] = False
        start[at[which] + size] = True
    starts = np.flatnonzero(start[:n])
    ends = np.append(starts[1:], n)
    return starts, ends, np.searchsorted(starts, off)


def ragged(values: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """values[begin[i]:begin[i] + size[i]] of every i, one after another."""
    total = np.cumsum(size)
    return values[np.arange(total[-1] if len(total) else 0) + np.repeat(begin - (total - size), size)]
