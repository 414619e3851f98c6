"""Operator 1: benchmark decontamination by a prefix-filtered set join.

An item window is a set of word shingles that has to be contained whole in a
document.  Shingles are ordered by how rare they are in the documents; a
window that is contained whole must share its rarest shingle, so that one
shingle (the prefix for containment 1.0) is joined with the documents'
shingles.  A window with a shingle that no document has drops out at once.
Matches then pass a length bound (the document has as many words as the window
from there on) and a positional bound (the shingle stands far enough from the
document's start), and the words around the match are compared with the
window's own words, which makes the result exact.

Two passes read the documents: one counts the benchmark's shingles, one finds
the prefix shingles.  Both look only at shingles that pass a Bloom filter of
bounded size, so no document shingle is shuffled unless the benchmark has it.
An item sends each of its windows once, straight to a file; a window of several
items is met once for each, and put together where rows are grouped anyway, so
that small tables do not go through a shuffle of many empty partitions.

Null or empty texts have no words and are never hit; repeated rows are kept,
each judged on its own; a null item_id counts as the item "null"; other
columns are ignored.  With no items nothing is hit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimspark.llm.common import Bloom, doc_columns, doc_rows
from claimspark.llm.scan import (
    ALNUM_WORDS, byte_values, lists, owner, signed, span_hashes, spans, text_chunks, window_hashes, window_starts,
)
from claimspark.plans.session import save

WINDOW, SHINGLE = 10, 3


def _words(data: np.ndarray, off: np.ndarray):
    starts, ends, first = spans(data, off, ALNUM_WORDS)
    return starts, ends, first, span_hashes(data, starts, ends, byte_values(fold=True))


def _plain(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> str:
    """The words, A-Z lowered, joined by one blank."""
    raw = data.tobytes()
    return b" ".join(raw[a:b].lower() for a, b in zip(starts, ends)).decode("utf-8", "replace")


def _item_windows(window: int, shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items, texts = batch.column(0), batch.column(1)
            for lo, hi, data, off in text_chunks(texts):
                starts, ends, first, h = _words(data, off)
                item, win, size, shingles = [], [], [], []
                for d in range(hi - lo):
                    a, b = first[d], first[d + 1]
                    k = min(window, b - a)
                    seen = set()
                    for s in range(a, b - k + 1) if k else ():
                        text = _plain(data, starts[s:s + k], ends[s:s + k])
                        if text in seen:
                            continue
                        seen.add(text)
                        item.append(items[lo + d].as_py())
                        win.append(text)
                        size.append(k)
                        shingles.append(window_hashes(h[s:s + k], min(shingle, k)).view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(item, pa.string()), pa.array(win, pa.string()), pa.array(size, pa.int32()),
                     pa.array(shingles, pa.list_(pa.int64()))], ["item", "win", "len", "shingles"])
    return run


def _counted(bloom: Bloom, sizes: list[int]):
    """Per chunk, how often each shingle that may be the benchmark's occurs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, off in text_chunks(batch.column(0)):
                _, _, first, words = _words(data, off)
                for k in sizes:
                    h = window_hashes(words, k)[window_starts(first, k)] if len(words) >= k else words[:0]
                    h, n = np.unique(h[bloom.has(h)], return_counts=True)
                    yield pa.RecordBatch.from_arrays([signed(h), pa.array(n)], ["shingle", "n"])
    return run


def _matched(bloom: Bloom, sizes: list[int], window: int):
    """Per document its words' count and its prefix shingles, each with the words around."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, off in text_chunks(batch.column(1)):
                starts, ends, first, words = _words(data, off)
                found, at = [], []
                for k in sizes:
                    w = window_starts(first, k)
                    if len(w):
                        h = window_hashes(words, k)[w]
                        hit = bloom.has(h)
                        found.append(h[hit])
                        at.append(w[hit])
                h = np.concatenate(found) if found else words[:0]
                w = np.concatenate(at) if at else np.empty(0, np.int64)
                order = np.argsort(w, kind="stable")
                h, w = h[order], w[order]
                d = owner(first, w)
                left = np.maximum(first[d], w - window + 1)
                right = np.minimum(first[d + 1], w + window)
                around = [_plain(data[starts[a]:ends[b - 1]], starts[a:b] - starts[a], ends[a:b] - starts[a])
                          for a, b in zip(left, right)]
                hits = pa.StructArray.from_arrays(
                    [signed(h), pa.array(w - first[d]), pa.array(left - first[d]), pa.array(around, pa.string())],
                    ["shingle", "pos", "left", "around"])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), pa.array(np.diff(first)),
                     lists(hits, np.bincount(d, minlength=hi - lo))], ["doc_id", "text_hash", "n_words", "hits"])
    return run


def occurrences(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE):
    """(documents with a row key and n_words, occurrences of windows, windows with their items).

    An occurrence is row key, first word, number of words and the window's words.
    """
    docs = doc_columns(docs).withColumn("text_hash", F.xxhash64("text"))
    named = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item_id"),
                         F.col("text").cast("string"))
    wins = save(named.mapInArrow(_item_windows(window, shingle), "item string, win string, len int, shingles array<long>"),
                "windows")
    shingles = wins.select("win", "len", F.posexplode("shingles").alias("off", "shingle"))
    sizes = wins.agg(F.sort_array(F.collect_set(F.least("len", F.lit(shingle))))).first()[0]

    known = Bloom.of(shingles, "shingle")
    counts = (docs.select("text").mapInArrow(_counted(known, sizes), "shingle long, n long")
              .groupBy("shingle").agg(F.sum("n").alias("n")))
    rarest = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "shingle", "off")).alias("p")
    prefixes = save(shingles.join(counts, "shingle", "left").groupBy("win", "len").agg(rarest)
                    .filter("p.n > 0").select("win", "len", "p.shingle", "p.off"), "prefixes")

    wanted = Bloom.of(prefixes, "shingle")
    found = docs.mapInArrow(
        _matched(wanted, sizes, window),
        "doc_id long, text_hash long, n_words long, hits array<struct<shingle:long,pos:long,left:long,around:string>>")
    found = save(found.withColumn("row", F.monotonically_increasing_id()), "matches")
    start = F.col("h.pos") - F.col("off")
    same = F.array_join(F.slice(F.split("h.around", " "), (start - F.col("h.left") + 1).cast("int"), F.col("len")), " ")
    hits = (found.select("row", "n_words", F.explode("hits").alias("h"))
            .withColumn("shingle", F.col("h.shingle"))
            .join(prefixes, "shingle")
            .filter((start >= F.col("h.left")) & (start + F.col("len") <= F.col("n_words")))
            .filter(same == F.col("win"))
            .select("row", start.alias("start"), "len", "win"))
    return found.drop("hits"), save(hits, "hits"), wins.select("win", "item").distinct()


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, text_hash, n_words, n_hit, n_items, items (sorted ids), contaminated: one row per document."""
    found, hits, wins = occurrences(docs, items, window, shingle)
    earlier = Window.partitionBy("row").orderBy("start", "len", "win").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("start") + F.col("len")
    fresh = end - F.greatest(F.col("start"), F.coalesce(F.max(end).over(earlier), F.lit(0)))
    covered = hits.withColumn("fresh", F.greatest(fresh, F.lit(0))).groupBy("row").agg(F.sum("fresh").alias("n_hit"))
    named = (hits.select("row", "win").distinct().join(wins, "win")
             .groupBy("row").agg(F.sort_array(F.collect_set("item")).alias("items")))
    return (found.join(covered, "row", "left").join(named, "row", "left")
            .select("doc_id", "text_hash", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
                    F.coalesce("items", F.array().cast("array<string>")).alias("items"))
            .withColumn("n_items", F.size("items").cast("long"))
            .withColumn("contaminated", F.col("n_hit") > 0))


def keep_uncontaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows, with all their columns, of documents that hold no item window."""
    bad = decontaminate(docs, items).filter("contaminated").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"))
    rows = doc_rows(docs).withColumn("_key", F.xxhash64("text"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_hash"))
    return rows.join(bad.distinct(), same, "left_anti").select("row.*")
