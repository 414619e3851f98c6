"""Operator 7: substring deduplication with difference-cover anchors.

Words that lie in a window of ``window`` words whose word sequence also starts
anywhere else are removed.  Comparing all windows would shuffle one hash per
word; instead only anchors are compared.  An anchor is a shorter run of words
that starts, counted from its document's first word, at a position whose
remainder by ``PERIOD`` is in ``COVER``.  ``COVER`` is a difference cover: for
any two positions some shift below ``PERIOD`` moves both onto it.  So two equal
windows always have an equal anchor at the same place in both.

1. Count anchors over all documents; keep those that occur twice or more.
2. Extend: every window around a repeated anchor is counted by its hash.  A
   chunk of documents sends each distinct window once, with its number there,
   and each task adds up its own before the shuffle.
3. The places of the repeated windows are looked up in a second pass over the
   texts and joined with them; a window that stands in very many documents is
   a hot key of that join alone, which adaptive execution can split.
4. Each document gets its repeated windows and drops the words they cover.
   Windows are grouped by the columns that the texts are joined by, so that
   they are shuffled once for both.

Steps 1 and 2 are written below the shared folder; their shuffle files, and
those that their filters are made by, go as soon as they are done.

The repeated anchors and the repeated windows reach the tasks as Bloom filters
of bounded size; one that is too full only lets more windows be compared.
Windows are told apart by 96 bits, so that equal hashes of different windows
are not to be expected even among 10**13 of them.

Null and empty texts have no words; texts of fewer words than a window stay
whole; repeated rows are copies of each other (both lose the words); other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimspark.llm.common import Bloom, doc_columns
from claimspark.llm.scan import (
    SPACED_WORDS, byte_values, join_words, mix, owner, signed, span_hashes, spans, text_chunks, window_hashes,
    window_starts,
)
from claimspark.plans.session import save_and_free, shuffles_freed

CHUNK_BYTES = 4 << 20  # each sends its distinct windows once, so larger chunks shuffle less
HASHED_BYTES = 1 << 20  # of a chunk at a time, as several arrays hold 8 bytes for each byte of text
WINDOW = 35
PERIOD, COVER = 21, (3, 6, 7, 12, 14)
OTHER_HASH = np.uint64(0xC2B2AE3D27D4EB4F)  # turns word hashes into others, for a second window hash


def _word_hashes(data: np.ndarray, off: np.ndarray):
    firsts, hashes, n, lo = [np.zeros(1, np.int64)], [np.empty(0, np.uint64)], 0, 0
    while lo < len(off) - 1:
        hi = max(int(np.searchsorted(off, off[lo] + HASHED_BYTES, "right")) - 1, lo + 1)
        part = data[off[lo]:off[hi]]
        starts, ends, first = spans(part, off[lo:hi + 1] - off[lo], SPACED_WORDS)
        hashes.append(span_hashes(part, starts, ends, byte_values(fold=False)))
        firsts.append(first[1:] + n)
        n, lo = n + len(starts), hi
    return np.concatenate(firsts), np.concatenate(hashes)


def _anchors(first: np.ndarray, size: int) -> np.ndarray:
    """Word numbers at which anchors of ``size`` words start."""
    on = np.zeros(PERIOD, bool)
    on[list(COVER)] = True
    at = window_starts(first, size)
    return at[on[(at - first[owner(first, at)]) % PERIOD]]


def _count_anchors(window: int):
    size = window - PERIOD + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, off in text_chunks(batch.column(0)):
                first, words = _word_hashes(data, off)
                h = window_hashes(words, size)
                h, n = np.unique(h[_anchors(first, size)] if len(h) else h, return_counts=True)
                yield pa.RecordBatch.from_arrays([signed(h), pa.array(n)], ["anchor", "n"])
    return run


def _near_windows(first: np.ndarray, words: np.ndarray, window: int, anchors: Bloom):
    """(word numbers, hashes, 32 more bits) of the windows around a repeated anchor."""
    size = window - PERIOD + 1
    h = window_hashes(words, size)
    at = _anchors(first, size) if len(h) else np.empty(0, np.int64)
    at = at[anchors.has(h[at])]
    near = np.zeros(len(words) + 1, np.int64)
    np.add.at(near, np.maximum(at - (window - size), 0), 1)
    np.subtract.at(near, at + 1, 1)
    near = np.cumsum(near) > 0
    w = window_starts(first, window)
    w = w[near[w]]
    if not len(w):
        return w, words[:0], np.empty(0, np.int32)
    more = window_hashes(mix(words ^ OTHER_HASH), window)[w] >> np.uint64(32)
    return w, window_hashes(words, window)[w], more.astype(np.uint32).view(np.int32)


def _count_windows(window: int, anchors: Bloom, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, off in text_chunks(batch.column(0), limit):
                _, h, more = _near_windows(*_word_hashes(data, off), window, anchors)
                by = np.lexsort((more, h))
                h, more = h[by], more[by]
                new = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (more[1:] != more[:-1])])[:len(h)])
                yield pa.RecordBatch.from_arrays(
                    [signed(h[new]), pa.array(more[new]), pa.array(np.diff(np.append(new, len(h))))], ["win", "more", "n"])
    return run


def _places(window: int, anchors: Bloom, repeated: Bloom, limit: int):
    """Where the windows start that pass both filters."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, _, data, off in text_chunks(batch.column(2), limit):
                first, words = _word_hashes(data, off)
                w, h, more = _near_windows(first, words, window, anchors)
                some = repeated.has(h)
                w, h, more = w[some], h[some], more[some]
                d = owner(first, w)
                ids = pa.array(d + lo)
                yield pa.RecordBatch.from_arrays(
                    [signed(h), pa.array(more), batch.column(0).take(ids), batch.column(1).take(ids),
                     pa.array((w - first[d]).astype(np.int32))], ["win", "more", "doc_id", "key", "pos"])
    return run


def _remove(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(2)
            for lo, hi, data, off in text_chunks(batch.column(1)):
                starts, ends, first = spans(data, off, SPACED_WORDS)
                own = at.slice(lo, hi - lo)
                n = own.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                s = own.flatten().to_numpy() + np.repeat(first[:-1], n)
                cover = np.zeros(len(starts) + window + 1, np.int64)
                np.add.at(cover, s, 1)
                np.subtract.at(cover, s + window, 1)
                gone = np.cumsum(cover)[:len(starts)] > 0
                removed = np.concatenate([[0], np.cumsum(gone)])[first]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(np.diff(first)), pa.array(np.diff(removed)),
                     join_words(data, off, starts, ends, first, ~gone)],
                    ["doc_id", "n_words", "n_removed", "kept"])
    return run


def dedup_substrings(docs: DataFrame, window: int = WINDOW, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the kept words joined by one blank): one row per document.

    ``window`` has to be more than ``PERIOD`` words.
    """
    if window <= PERIOD:
        raise ValueError(f"window has to be more than {PERIOD} words")
    docs = doc_columns(docs).withColumn("key", F.xxhash64("text"))
    anchors = (docs.select("text").mapInArrow(_count_anchors(window), "anchor long, n long")
               .groupBy("anchor").agg(F.sum("n").alias("n")).filter("n > 1").select("anchor"))
    anchors = save_and_free(anchors, "anchors")
    with shuffles_freed(docs.sparkSession):
        bloom = Bloom.of(anchors, "anchor")
    counted = docs.select("text").mapInArrow(_count_windows(window, bloom, chunk_bytes), "win long, more int, n long")
    counts = counted.groupBy("win", "more").agg(F.sum("n").alias("n"))
    repeated = save_and_free(counts.filter("n > 1").select("win", "more"), "windows")
    with shuffles_freed(docs.sparkSession):
        passed = Bloom.of(repeated, "win")
    found = docs.select("doc_id", "key", "text").mapInArrow(
        _places(window, bloom, passed, chunk_bytes), "win long, more int, doc_id long, key long, pos int")
    found = found.join(repeated, ["win", "more"], "left_semi")
    same = [F.coalesce("doc_id", F.lit(0)).alias("id"), F.isnull("doc_id").alias("no_id"), F.col("key")]
    places = found.groupBy(*same).agg(F.collect_set("pos").alias("at"))
    met = docs.select("doc_id", "text", *same).join(places, ["id", "no_id", "key"], "left")
    return met.select("doc_id", "text", "at").mapInArrow(
        _remove(window), "doc_id long, n_words long, n_removed long, kept string")
