"""Operator 5: shards by extendible hashing.

A directory maps prefixes of a document's hash bits to buckets.  It starts with
one bucket; every bucket over the byte limit is split on its next bit, and only
those, so buckets differ in depth.  A bucket is a shard once it fits, or holds a
single document.  Byte sums are aggregated for ``STEP`` bits at a time, so the
sizes are read once for each ``STEP`` levels and the documents' texts once.

The bits are those of a hash of doc_id, then of the text, then of a row number:
repeated doc_ids, and after them repeated rows, are split too, whatever their
number.  A document over the limit is a shard of its own.

The rows are saved once with their hashes and row numbers, and written from
there with all their columns, so that nothing links rows by doc_id.

All steps are DataFrame operations.  A null text has 0 bytes; a null doc_id
hashes as "null"; an empty table has no shards; other columns do not matter.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimspark.plans.session import save, scratch_path

LIMIT = 1 << 20  # bytes of text in a shard
STEP = 16
WIDTH = 60       # bits taken from each hash


def _hash(value: Column) -> Column:
    return F.conv(F.substring(F.md5(F.coalesce(value.cast("string"), F.lit("null"))), 1, WIDTH // 4), 16, 10).cast("long")


def _path() -> Column:
    return F.concat(*[F.lpad(F.bin(F.col(f"h{k}")), WIDTH, "0") for k in range(3)])


def directory(sizes: DataFrame, limit: int) -> DataFrame:
    """prefix (text of bits), bytes, n_docs of each shard; sizes has n_bytes and the hashes."""
    leaves, reached, still = [], 0, sizes
    while True:
        cells = (still.groupBy(F.substring(_path(), 1, reached + STEP).alias("cell"))
                 .agg(F.sum("n_bytes").alias("bytes"), F.count(F.lit(1)).alias("n_docs")))
        depths = F.sequence(F.lit(reached), F.lit(reached + STEP))
        levels = cells.select("bytes", "n_docs", F.explode(F.transform(depths, lambda d: F.substring("cell", F.lit(1), d))).alias("prefix"))
        levels = levels.groupBy("prefix").agg(F.sum("bytes").alias("bytes"), F.sum("n_docs").alias("n_docs"))
        levels = save(levels.withColumn("fits", (F.col("bytes") <= limit) | (F.col("n_docs") == 1)), "levels")
        split = levels.filter("not fits").select(F.col("prefix").alias("parent"))
        fits = levels.filter("fits").drop("fits")
        if reached == 0:
            leaves.append(fits.filter("prefix = ''"))
        below = fits.filter("prefix <> ''").withColumn("parent", F.expr("left(prefix, length(prefix) - 1)"))
        leaves.append(below.join(split, "parent", "left_semi").drop("parent"))
        deepest = split.filter(F.length("parent") == reached + STEP)
        reached += STEP
        if reached + STEP > 3 * WIDTH or deepest.isEmpty():
            break
        still = still.withColumn("parent", F.substring(_path(), 1, reached)).join(deepest, "parent", "left_semi").drop("parent")
    return save(reduce(DataFrame.unionByName, leaves), "directory")


def _placed(docs: DataFrame, carried: Column, limit: int) -> DataFrame:
    """carried, n_bytes, prefix, bytes and n_docs: one row per document; what is carried is saved with its row number."""
    rows = docs.select(
        carried.alias("carried"), F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)).cast("long").alias("n_bytes"),
        _hash(F.col("doc_id")).alias("h0"), _hash(F.col("text")).alias("h1"), _hash(F.monotonically_increasing_id()).alias("h2"))
    path = scratch_path(docs.sparkSession, "rows")
    rows.write.option("compression", "zstd").parquet(path)
    rows = docs.sparkSession.read.schema(rows.schema).parquet(path)
    shards = directory(rows.drop("carried"), limit)
    depths = sorted(r.d for r in shards.select(F.length("prefix").alias("d")).distinct().collect())  # at most 181
    if not depths:
        depths = [0]
    prefixes = F.array(*[F.substring(_path(), 1, d) for d in depths])
    return rows.select("carried", "n_bytes", F.explode(prefixes).alias("prefix")).join(shards, "prefix")


def shard(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, depth, shard (its prefix), shard_bytes, shard_docs: one row per document."""
    return _placed(docs, F.col("doc_id").cast("long"), limit).select(
        F.col("carried").alias("doc_id"), "n_bytes", F.length("prefix").alias("depth"), F.col("prefix").alias("shard"),
        F.col("bytes").alias("shard_bytes"), F.col("n_docs").alias("shard_docs"))


def write_shards(docs: DataFrame, folder: str, limit: int = LIMIT) -> DataFrame:
    """Writes the rows, with all their columns, below ``folder``, one folder for each shard; returns what is read back.

    The folders' column is ``shard``; a column of that name, in any case, would be lost and raises.
    """
    if "shard" in map(str.lower, docs.columns):
        raise ValueError("the rows have a column 'shard', the name of the folders' column: rename it first")
    placed = _placed(docs, F.struct("*"), limit).select("carried.*", F.concat(F.lit("s"), F.col("prefix")).alias("shard"))
    placed.repartition("shard").write.option("compression", "zstd").partitionBy("shard").parquet(folder)
    return docs.sparkSession.read.schema(placed.schema).parquet(folder)


def written_shards(rows: DataFrame) -> DataFrame:
    """The columns of ``shard``, from the rows that ``write_shards`` has written."""
    own = Window.partitionBy("shard")
    sizes = rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0))
                        .cast("long").alias("n_bytes"), F.expr("substring(shard, 2)").alias("shard"))
    return sizes.select("doc_id", "n_bytes", F.length("shard").alias("depth"), "shard", F.sum("n_bytes").over(own).alias("shard_bytes"),
                        F.count(F.lit(1)).over(own).alias("shard_docs"))
