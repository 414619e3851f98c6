"""Operator 3: n-gram Jaccard join with vertical partitioning.

A document's set holds the hashes of its distinct word shingles.  One global
order ranks all shingles, rarer first: by a class that grows with the number of
documents, then by hash.  The order is cut into fragments; a document's
shingles within one fragment are a segment.  For a candidate pair the common
shingles of each fragment are counted on their own, and the counts are summed
per pair, which gives the exact similarity.

Candidates come from the front of the order.  Two sets that are similar enough
share a shingle among the first |x| - min_overlap(|x|) + 1 of each, at places
that leave room for the overlap they need, and their fronts have as much in
common as the rest cannot make up for.  A group of near copies shares many
of those, so its pairs are not listed at once:

* documents with equal sets become one class first;
* then every class is compared with its neighbours in two orders and with the
  most typical class at each shared shingle (links found here join classes);
* at last all remaining pairs of classes that are still in different groups are
  compared.  Only pairs whose two ends are already joined are left out, so the
  groups are exact.

Frequencies shape the order and nothing else, so they may be a little too high:
every shingle of every class is counted, by 32 bits of its hash within one of
as many buckets as there are shuffle partitions.  Tasks get the shingles of each
frequency class as Bloom filters of bounded size; where the lowest class does
not fit, it counts as unique.  While it fits, shingles outside every filter are
in one class alone and need no shuffle.

Null and empty texts have an empty set and are linked with nothing; a text of
fewer words than a shingle is one shingle; repeated rows are equal sets; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimspark.llm.common import Bloom, doc_columns, doc_rows
from claimspark.llm.components import components
from claimspark.llm.scan import (
    SPACED_WORDS, byte_values, lists, mix, signed, span_hashes, spans, text_chunks, window_hashes,
)
from claimspark.plans.session import save

SHINGLE, PERCENT = 5, 75
CHUNK_BYTES = 1 << 20     # of text that a task works on at a time
LEVELS = (2, 16, 256)     # frequencies at which a class of the order begins
MAX_FILTERED = 1 << 23    # shingles in a Bloom filter at most
FRAGMENTS = 4             # of the unique shingles, by the top bits of the hash; every other class is one more


def min_overlap(n, percent: int = PERCENT):
    """Common shingles that a set of n needs with any set similar enough."""
    return -(-percent * n // 100)


def _sets(data: np.ndarray, off: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shingles, counts, keys): each text's distinct shingles in ascending order, their number, a hash of the set."""
    starts, ends, first = spans(data, off, SPACED_WORDS)
    words = span_hashes(data, starts, ends, byte_values(fold=True))
    windows = window_hashes(words, shingle)
    parts, counts = [], np.zeros(len(off) - 1, np.int64)
    for d in range(len(off) - 1):
        a, b = first[d], first[d + 1]
        if b - a >= shingle:
            part = np.sort(windows[a:b - shingle + 1])
            part = part[np.concatenate([[True], part[1:] != part[:-1]])]
        else:
            part = window_hashes(words[a:b], b - a) if b > a else words[:0]
        parts.append(part)
        counts[d] = len(part)
    shingles = np.concatenate(parts) if parts else words[:0]
    sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(shingles ^ np.uint64(0xA0761D6478BD642F)), dtype=np.uint64)])
    last = np.cumsum(counts)
    return shingles, counts, mix(sums[last] - sums[last - counts] + counts.astype(np.uint64))


def _distinct(shingles: np.ndarray, counts: np.ndarray, keys: np.ndarray, seen: set):
    """The non-empty sets that this task has not met yet."""
    fresh = np.zeros(len(counts), bool)
    for d in np.flatnonzero(counts):
        k = int(keys[d])
        if k not in seen:
            seen.add(k)
            fresh[d] = True
    return shingles[np.repeat(fresh, counts)], counts[fresh], keys[fresh]


def _row_hash(doc_id: pa.Array, text_hash: pa.Array) -> np.ndarray:
    ids = doc_id.fill_null(-1).to_numpy(zero_copy_only=False).view(np.uint64)
    return mix(mix(ids + np.uint64(1)) ^ text_hash.to_numpy(zero_copy_only=False).view(np.uint64))


def _describe(shingle: int):
    """Each document's set: its size and its key."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, off in text_chunks(batch.column(1), CHUNK_BYTES):
                _, counts, keys = _sets(data, off, shingle)
                doc_id, text_hash = batch.column(0).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [doc_id, text_hash, pa.array(counts), pa.array(keys.view(np.int64), mask=counts == 0),
                     signed(_row_hash(doc_id, text_hash))], ["doc_id", "text_hash", "n", "key", "row"])
    return run


def _class_sets(batches: Iterator[pa.RecordBatch], shingle: int, chosen: Bloom, wanted: Bloom | None = None):
    """The sets of the documents that stand for their classes, each once per task."""
    seen: set = set()
    for batch in batches:
        for lo, hi, data, off in text_chunks(batch.column(1), CHUNK_BYTES):
            n = hi - lo
            own = chosen.has(_row_hash(batch.column(0).slice(lo, n), batch.column(2).slice(lo, n)))
            shingles, counts, keys = _sets(data, off, shingle)
            if wanted is not None:
                own &= wanted.has(keys)
            yield _distinct(shingles[np.repeat(own, counts)], counts[own], keys[own], seen)


def _short(shingles: np.ndarray, buckets: int) -> np.ndarray:
    """A bucket and 32 more bits of each hash."""
    b = np.uint64(buckets)
    return (shingles % b) << np.uint64(32) | ((shingles // b) & np.uint64(0xFFFFFFFF))


def _deal(shingle: int, chosen: Bloom, buckets: int):
    """The short hashes of a chunk, one row for each bucket."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shingles, _, _ in _class_sets(batches, shingle, chosen):
            h = np.sort(_short(shingles, buckets))
            cut = np.searchsorted(h >> np.uint64(32), np.arange(buckets + 1, dtype=np.uint64))
            low = h.astype(np.uint32)
            some = np.flatnonzero(np.diff(cut))
            yield pa.RecordBatch.from_arrays(
                [pa.array(some.astype(np.int32)), pa.array([low[cut[k]:cut[k + 1]].tobytes() for k in some], pa.binary())],
                ["bucket", "hashes"])
    return run


def _repeated(bucket: int, hashes: list[np.ndarray]) -> pa.RecordBatch:
    h, n = np.unique(np.concatenate(hashes), return_counts=True)
    h, n = h[n > 1].astype(np.uint64), n[n > 1]
    return pa.RecordBatch.from_arrays([signed(mix(np.uint64(bucket) << np.uint64(32) | h)), pa.array(n)], ["short", "n"])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The short hashes that occur twice or more in a bucket, and how often; buckets come one after another."""
    now, met = -1, []
    for batch in batches:
        for bucket, hashes in zip(batch.column(0).to_pylist(), batch.column(1)):
            if bucket != now and met:
                yield _repeated(now, met)
                met = []
            now = bucket
            met.append(np.frombuffer(hashes.as_buffer(), np.uint32).copy())
    if met:
        yield _repeated(now, met)


class Order:
    """The classes of the global order: Bloom filters of the short hashes from each frequency on."""

    def __init__(self, counts: DataFrame, buckets: int):
        self.buckets = buckets
        ends = [F.count(F.when(F.col("n") >= k, 1)).alias(str(k)) for k in LEVELS]
        sizes = counts.agg(*ends).first()
        self.levels = [k for k in LEVELS if sizes[str(k)] <= MAX_FILTERED]
        self.filters = [Bloom.of(counts.filter(F.col("n") >= k).select("short"), "short") for k in self.levels]

    @property
    def unique_known(self) -> bool:
        """Whether class 0 holds shingles of one class of documents alone."""
        return bool(self.levels) and self.levels[0] == 2

    def classes(self, shingles: np.ndarray) -> np.ndarray:
        out = np.zeros(len(shingles), np.uint8)
        at = np.arange(len(shingles))
        h = mix(_short(shingles, self.buckets))
        for f in self.filters:
            at = at[f.has(h[at])]
            out[at] += 1
        return out


def _prefixes(shingle: int, percent: int, chosen: Bloom, order: Order):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shingles, counts, keys in _class_sets(batches, shingle, chosen):
            doc = np.repeat(np.arange(len(counts)), counts)
            classes = order.classes(shingles)
            by = np.argsort(doc * 8 + classes, kind="stable")
            place = np.arange(len(shingles)) - (np.cumsum(counts) - counts)[doc]
            front = place <= (counts - min_overlap(counts, percent))[doc]
            if order.unique_known:
                front &= classes[by] > 0
            yield pa.RecordBatch.from_arrays(
                [signed(shingles[by][front]), signed(keys[doc[front]]), pa.array(counts[doc[front]].astype(np.int32)),
                 pa.array(place[front].astype(np.int32))], ["shingle", "key", "n", "place"])
    return run


def _segments(shingle: int, chosen: Bloom, wanted: Bloom, order: Order):
    parts = FRAGMENTS + len(LEVELS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shingles, counts, keys in _class_sets(batches, shingle, chosen, wanted):
            doc = np.repeat(np.arange(len(counts)), counts)
            classes = order.classes(shingles).astype(np.int64)
            light = (shingles >> np.uint64(62)).astype(np.int64) % FRAGMENTS
            cell = doc * parts + np.where(classes > 0, FRAGMENTS - 1 + classes, light)
            by = np.argsort(cell, kind="stable")
            cells, sizes = np.unique(cell, return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [signed(keys[cells // parts]), pa.array((cells % parts).astype(np.int32)),
                 lists(signed(shingles[by]), sizes)], ["key", "fragment", "shingles"])
    return run


def _room(n, place, m, spot, percent: int):
    """Whether two sets with a first common shingle at these places can overlap enough."""
    return F.least(n - place, m - spot) >= _need(n, m, percent)


def _need(n, m, percent: int):
    """Common shingles that two sets of these sizes need."""
    return F.ceil(F.lit(percent) * (n + m) / F.lit(100 + percent))


def _promising(pairs: DataFrame, fronts: DataFrame, percent: int) -> DataFrame:
    """The pairs whose fronts, the first fragment, have enough in common.

    What is common beyond the fronts lies behind the front of the set whose
    front ends first, so it is no more than the rest of the larger set.
    """
    left = fronts.select(F.col("key").alias("a"), F.col("front").alias("x"))
    right = fronts.select(F.col("key").alias("b"), F.col("front").alias("y"))
    n, m = F.col("n"), F.col("m")
    rest = F.floor((F.lit(percent) * F.greatest(n, m) + 99) / 100) - 1
    met = pairs.join(left, "a").join(right, "b")
    return met.filter(F.size(F.array_intersect("x", "y")) + rest >= _need(n, m, percent)).select("a", "n", "b", "m")


def _overlaps(pairs: DataFrame, segments: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, n, b, m) that are similar enough; common shingles are counted by fragment and summed."""
    left = segments.select(F.col("key").alias("a"), "fragment", F.col("shingles").alias("x"))
    right = segments.select(F.col("key").alias("b"), "fragment", F.col("shingles").alias("y"))
    counted = (pairs.join(left, "a").join(right, ["b", "fragment"])
               .select("a", "b", "n", "m", "fragment", F.size(F.array_intersect("x", "y")).alias("common")))
    # a class whose document stands more than once in the table has equal segments: count one
    counted = counted.groupBy("a", "b", "n", "m", "fragment").agg(F.max("common").alias("common"))
    summed = counted.groupBy("a", "b", "n", "m").agg(F.sum("common").alias("common"))
    return summed.filter(100 * F.col("common") >= percent * (F.col("n") + F.col("m") - F.col("common"))).select("a", "b")


def _ordered(rows: DataFrame) -> DataFrame:
    """Distinct pairs with the smaller key first; rows has key, n, other, m."""
    swap = F.col("key") > F.col("other")
    return rows.select(
        F.when(swap, F.col("other")).otherwise(F.col("key")).alias("a"), F.when(swap, F.col("m")).otherwise(F.col("n")).alias("n"),
        F.when(swap, F.col("key")).otherwise(F.col("other")).alias("b"), F.when(swap, F.col("n")).otherwise(F.col("m")).alias("m"),
    ).filter("a < b").distinct()


def _near_pairs(posts: DataFrame, percent: int, seed: int) -> DataFrame:
    """At each shingle: every class with the most typical one, and with the next one in another order."""
    one = F.struct("key", "n", "place", "group")
    typical = Window.partitionBy("shingle").orderBy(F.desc("typical"), "key")
    chain = Window.partitionBy("shingle").orderBy(*(["n", "key"] if seed == 0 else [F.xxhash64("key", F.lit(seed)), "key"]))
    met = posts.withColumn("top", F.first(one).over(typical)).withColumn("last", F.lag(one).over(chain))
    met = met.select("key", "n", "place", "group", F.explode(F.array("top", "last")).alias("o"))
    met = met.filter(F.col("o").isNotNull() & (F.col("o.group") != F.col("group")))
    met = met.filter(_room(F.col("n"), F.col("place"), F.col("o.n"), F.col("o.place"), percent))
    return _ordered(met.select("key", "n", F.col("o.key").alias("other"), F.col("o.n").alias("m")))


def _rest_pairs(posts: DataFrame, percent: int) -> DataFrame:
    """All pairs of classes of different groups that share a front shingle and can overlap enough."""
    x = posts.select("shingle", "key", "n", "place", "group")
    y = posts.select("shingle", F.col("key").alias("other"), F.col("n").alias("m"), F.col("place").alias("spot"),
                     F.col("group").alias("others"))
    met = x.join(y, (x.shingle == y.shingle) & (F.col("key") < F.col("other")) & (F.col("group") != F.col("others"))
                 & _room(F.col("n"), F.col("place"), F.col("m"), F.col("spot"), percent))
    return _ordered(met.select("key", "n", "other", "m"))


def similar_groups(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, text_hash, component: one row per document.

    component_id is the smallest doc_id reachable by links of at least
    ``percent`` hundredths of common shingles; component is a key of the same
    group that also tells documents of one doc_id apart (null: an empty set).
    """
    docs = doc_columns(docs).withColumn("text_hash", F.xxhash64("text"))
    buckets = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    described = save(docs.mapInArrow(_describe(shingle), "doc_id long, text_hash long, n long, key long, row long"), "sets")
    chosen = described.filter("key is not null").groupBy("key").agg(F.min("row").alias("row")).select("row")
    chosen = Bloom.of(save(chosen, "chosen"), "row")

    dealt = docs.mapInArrow(_deal(shingle, chosen, buckets), "bucket int, hashes binary").repartition(buckets, "bucket")
    dealt = dealt.sortWithinPartitions("bucket")  # a task holds one bucket at a time
    order = Order(save(dealt.mapInArrow(_count, "short long, n long"), "repeated"), buckets)
    fronts = docs.mapInArrow(_prefixes(shingle, percent, chosen, order), "shingle long, key long, n int, place int")
    by_shingle = Window.partitionBy("shingle")
    posts = (fronts.withColumn("shared", F.min("key").over(by_shingle) != F.max("key").over(by_shingle))
             .filter("shared").drop("shared").distinct())
    posts = save(posts, "posts")
    fronts = save(posts.groupBy("key").agg(F.collect_list("shingle").alias("front")), "fronts")
    keys = posts.groupBy("key").agg((F.count(F.lit(1)) / F.max("n")).alias("typical"))
    wanted = Bloom.of(posts.select("key").distinct(), "key")
    segments = save(docs.mapInArrow(_segments(shingle, chosen, wanted, order),
                                    "key long, fragment int, shingles array<long>"), "segments")

    posts = save(posts.join(keys, "key"), "posts").withColumn("group", F.col("key"))
    links, groups = None, None
    for seed in (0, 1, None):
        pairs = _rest_pairs(posts, percent) if seed is None else _near_pairs(posts, percent, seed)
        pairs = save(_promising(pairs, fronts, percent), "pairs")
        found = save(_overlaps(pairs, segments, percent), "links")
        links = found if links is None else links.union(found)
        groups = save(components(links), "groups")
        if seed is not None:
            joined = posts.drop("group").join(groups.withColumnRenamed("node", "key"), "key", "left")
            joined = joined.withColumn("group", F.coalesce("root", "key")).drop("root")
            posts = save(joined.withColumn("open", F.min("group").over(by_shingle) != F.max("group").over(by_shingle))
                         .filter("open").drop("open"), "open-posts")
            if posts.isEmpty():  # no two groups share a front shingle any more
                break

    rows = described.select("doc_id", "text_hash", "n", "key")
    rows = rows.join(groups.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    smallest = save(rows.filter("root is not null").groupBy("root").agg(F.min("doc_id").alias("component_id")), "smallest")
    return rows.join(smallest, "root", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"),
        "text_hash", F.col("root").alias("component"))


def keep_one(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The rows, with all their columns, of one document of each group: the smallest doc_id, then text hash.

    Documents with an empty set are linked with nothing and all stay.
    """
    groups = save(similar_groups(docs, shingle, percent), "similar")
    first = F.min(F.struct("doc_id", "text_hash")).alias("k")
    kept = groups.filter("component is not null").groupBy("component").agg(first).select("k.*").distinct()
    kept = kept.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"))
    rows = doc_rows(docs).withColumn("_key", F.xxhash64("text"))
    wordless = F.coalesce(F.btrim("text", F.lit(" \t\n\x0b\x0c\r")), F.lit("")) == ""
    grouped = rows.filter(~wordless).join(kept, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_hash")), "left_semi")
    return grouped.dropDuplicates(["doc_id", "_key"]).select("row.*").union(rows.filter(wordless).select("row.*"))
