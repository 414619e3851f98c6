"""Operator 13: importance resampling towards a target distribution.

Features are runs of 1 to ``runs`` neighbouring words (A-Z lower-cased, joined
by one blank), told apart by the crc32 of their bytes modulo ``buckets``.  All
features of all documents and of all target texts are counted by bucket; a
bucket's gain is the floored thousandfold logarithm of how much likelier it is
in the target, each bucket counted once more than it is.  A document's weight
is the floored mean of its features' gains, gathered from one array (0 without
features); its score is the weight plus a Gumbel noise made of a hash of its
doc_id, so taking the highest scores draws without replacement in proportion to
the weights.

The highest scores are found by parallel sorting by regular sampling:

* every run, a partition of the scored documents, is sorted on its own;
* each run gives rows at regular places, ``RUNS`` or so; sorted together they
  give splitters that cut all rows into segments of about equal size (with as
  many samples as runs no segment is over twice its share);
* rows go to their segment, whose partition merges them in order;
* the sizes of the segments before, summed up, make a row's place in its
  segment its exact rank.

Only segments that begin within the drawn rows are exchanged; the ranks of all
others are null anyway.  At most 2 * RUNS ** 2 samples and RUNS splitters reach
the driver.  A row's run and its place there end every comparison, so equal rows,
however many, are spread over segments too.

Null and empty texts have no features and weight 0; a null doc_id is hashed as
``null`` and loses ties; repeated rows count, score and rank one by one; without
target features every gain follows from the documents' counts alone; an empty
table has no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimspark.llm.common import doc_columns
from claimspark.llm.scan import ALNUM_WORDS, spans, text_chunks
from claimspark.plans.session import save

RUN_WORDS, BUCKETS, SEED = 1, 10_000, 2024
PERCENT, MIN_WORDS = 10, 20
RUNS = 512
CHUNK_BYTES = 1 << 20

SCORED = "doc_id long, n_words long, n_features long, weight long, score long"
#: A row's place in the order: best score first, then the smallest doc_id.
ORDER = ("down", "id_null", "id", "weight", "n_features", "run", "place")


def crc_table() -> np.ndarray:
    """What the polynomial of crc32 makes of each byte."""
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, np.uint32(0xEDB88320) ^ (c >> 1), c >> 1)
    return c


_CRC = crc_table()


def _feed(state: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The crc32 register of each word after its bytes."""
    state = state.copy()
    order = np.argsort(starts - ends, kind="stable")  # longest first: the words still open come first
    size, begin, reg = (ends - starts)[order], starts[order], state[order]
    for j in range(int(size[0]) if len(size) else 0):
        n = int(np.searchsorted(-size, -j, "left"))
        reg[:n] = _CRC[(reg[:n] ^ data[begin[:n] + j]) & 0xFF] ^ (reg[:n] >> np.uint32(8))
    state[order] = reg
    return state


def features(data: np.ndarray, off: np.ndarray, runs: int, buckets: int):
    """(buckets, texts, n_words): the bucket and the text of every feature; the words of each text."""
    data = np.where((data >= 0x41) & (data <= 0x5A), data + np.uint8(32), data)
    starts, ends, first = spans(data, off, ALNUM_WORDS)
    n_words = np.diff(first)
    text = np.repeat(np.arange(len(n_words)), n_words)
    state = np.full(len(starts), 0xFFFFFFFF, np.uint32)
    found, owners = [], []
    for length in range(1, runs + 1):
        if length > 1:  # one word more, behind a blank
            same = text[length - 1:] == text[:len(text) - length + 1]
            keep = np.flatnonzero(same)
            state = _CRC[(state[keep] ^ 0x20) & 0xFF] ^ (state[keep] >> np.uint32(8))
            state_at = keep
        else:
            state_at = np.arange(len(starts))
        last = state_at + length - 1
        grown = _feed(state, data, starts[last], ends[last])
        found.append((grown ^ np.uint32(0xFFFFFFFF)) % np.uint32(buckets))
        owners.append(text[state_at])
        state = np.zeros(len(starts), np.uint32)
        state[state_at] = grown
    return np.concatenate(found).astype(np.int64), np.concatenate(owners), n_words


def bucket_counts(texts: DataFrame, runs: int, buckets: int) -> np.ndarray:
    """How many features of all texts each bucket has; at most ``buckets`` rows reach the driver."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, data, off in text_chunks(batch.column(0), CHUNK_BYTES):
                total += np.bincount(features(data, off, runs, buckets)[0], minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])
    rows = texts.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, np.int64)
    out[rows.column("bucket").to_numpy()] = rows.column("n").to_numpy()
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The floored thousandfold logarithm of (t + 1)(S + buckets) / ((s + 1)(T + buckets)) of each bucket."""
    n = len(source)
    a, b = float(source.sum() + n), float(target.sum() + n)
    return np.array([math.floor(1000 * math.log((float(t) + 1) * a / ((float(s) + 1) * b)))
                     for s, t in zip(source.tolist(), target.tolist())], np.int64)


def noise(doc_id, seed: int) -> int:
    """The floored thousandfold Gumbel noise of a doc_id."""
    h = int(hashlib.sha256(f"{seed}:{'null' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: np.ndarray, runs: int, seed: int) -> DataFrame:
    """doc_id, n_words, n_features, weight, score of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)  # one long for each bucket

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            for lo, hi, data, off in text_chunks(batch.column(1), CHUNK_BYTES):
                bucket, text, n_words = features(data, off, runs, len(table))
                n = np.bincount(text, minlength=hi - lo)
                total = np.zeros(hi - lo, np.int64)
                np.add.at(total, text, table[bucket])
                weight = np.where(n > 0, total // np.maximum(n, 1), 0)
                ids = batch.column(0).slice(lo, hi - lo)
                score = weight + np.array([noise(i, seed) for i in ids.to_pylist()], np.int64)
                yield pa.RecordBatch.from_arrays([ids, *map(pa.array, (n_words, n, weight, score))],
                                                 ["doc_id", "n_words", "n_features", "weight", "score"])
    return docs.mapInArrow(run, SCORED)


def _before(rows: list[np.ndarray], row: np.ndarray) -> np.ndarray:
    """Whether each row's key, column by column, is smaller than or equal to the one in ``row``."""
    less, equal = np.zeros(len(rows[0]), bool), np.ones(len(rows[0]), bool)
    for column, value in zip(rows, row):
        less |= equal & (column < value)
        equal &= column == value
    return less | equal


def _placed(splitters: np.ndarray):
    """Adds each row's segment: how many splitters its key is greater than."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = [batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ORDER]
            lo, hi = np.zeros(batch.num_rows, np.int64), np.full(batch.num_rows, len(splitters), np.int64)
            while (lo < hi).any():
                mid = (lo + hi) // 2
                at = splitters[np.minimum(mid, len(splitters) - 1)]
                small = _before(key, at.T) & (lo < hi)
                hi, lo = np.where(small, mid, hi), np.where(small | (lo >= hi), lo, mid + 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lo.astype(np.int32))], [*batch.schema.names, "segment"])
    return run


def ranked(rows: DataFrame, draw: int, runs: int) -> DataFrame:
    """The scored rows with their rank among all of them, null beyond ``draw``."""
    spark = rows.sparkSession
    keyed = rows.withColumns({"down": -F.col("score"), "id_null": F.col("doc_id").isNull().cast("int"),
                              "id": F.coalesce("doc_id", F.lit(0))})
    local = keyed.coalesce(runs).sortWithinPartitions(*ORDER[:5])
    local = save(local.withColumns({"run": F.spark_partition_id(), "place": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}), "runs")
    sizes = {r.run: r.n for r in local.groupBy("run").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per run
    steps = {r: max(1, n // len(sizes)) for r, n in sizes.items()}
    step = spark.createDataFrame(list(steps.items()) or [(0, 1)], "run int, step long")
    sample = local.join(F.broadcast(step), "run").filter(F.col("place") % F.col("step") == 0)
    sample = sample.orderBy(*ORDER).select(*ORDER, "step").toArrow()  # at most 2 * runs ** 2 rows
    keys = np.column_stack([sample.column(c).to_numpy().astype(np.int64) for c in ORDER]) if sample.num_rows else np.empty((0, len(ORDER)), np.int64)
    share = np.cumsum(sample.column("step").to_numpy()) * len(sizes) // max(1, int(sum(sizes.values())))
    splitters = keys[np.flatnonzero(np.diff(share) > 0)]

    schema = f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in local.schema.fields)}, segment int"
    placed = save(local.mapInArrow(_placed(splitters), schema), "segments")
    sizes = {r.segment: r.n for r in placed.groupBy("segment").agg(F.count(F.lit(1)).alias("n")).collect()}
    begin, total = [], 0
    for segment in range(len(splitters) + 1):
        begin.append(total)
        total += sizes.get(segment, 0)
    within = sum(b < draw for b in begin)  # segments that hold drawn rows: the first ones
    if not within:
        return placed.select(*rows.columns, F.lit(None).cast("long").alias("rank"))
    merged = placed.filter(F.col("segment") < within).repartitionById(within, F.col("segment")).sortWithinPartitions("segment", *ORDER)
    offsets = F.element_at(F.array(*[F.lit(b) for b in begin[:within]]), F.col("segment") + 1)
    rank = (offsets + F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) + 1).cast("long")
    merged = merged.select(*rows.columns, rank.alias("rank"))
    merged = merged.withColumn("rank", F.when(F.col("rank") <= draw, F.col("rank")))
    rest = placed.filter(F.col("segment") >= within).select(*rows.columns, F.lit(None).cast("long").alias("rank"))
    return merged.unionByName(rest)


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, runs: int = RUN_WORDS, buckets: int = BUCKETS,
             min_words: int = MIN_WORDS, seed: int = SEED, sorted_runs: int = RUNS) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank: one row per document, rank null where it is not drawn.

    ``percent`` hundredths of the documents with at least ``min_words`` words are drawn.
    """
    docs = doc_columns(docs)
    target = target.select(F.col("text").cast("string").alias("text"))
    gain = gains(bucket_counts(docs, runs, buckets), bucket_counts(target, runs, buckets))
    rows = save(scored(docs, gain, runs, seed), "scored")
    able = rows.filter(F.col("n_words") >= min_words)
    rest = rows.filter(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("long"))
    return ranked(able, able.count() * percent // 100, sorted_runs).unionByName(rest)
