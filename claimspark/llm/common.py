"""Shared pieces of the training-data operators."""

from __future__ import annotations

import io
import os
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

import claimspark
from claimspark.plans.session import scratch_path

_SHIPPED: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def tokenizer_file(name: str) -> str:
    """A vocabulary file of the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path(name)


def ship(spark: SparkSession) -> None:
    """Give the executors this package, through Spark's own file server."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    top = os.path.dirname(os.path.abspath(claimspark.__file__))
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        for folder, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, os.path.dirname(top)))
    target = f"{scratch_path(spark, 'package')}/claimspark.zip"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(target)
    out = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).create(hadoop)
    out.write(bytearray(packed.getvalue()))
    out.close()
    sc.addPyFile(target)
    _SHIPPED.add(sc.applicationId)


def doc_columns(docs: DataFrame) -> DataFrame:
    """doc_id and text; other columns are not read."""
    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def doc_rows(docs: DataFrame) -> DataFrame:
    """doc_id, text and row, a struct of all columns as they are, whatever their names."""
    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                       F.struct("*").alias("row"))


def map_docs(docs: DataFrame, run, schema: str) -> DataFrame:
    """``mapInArrow``; columns after doc_id and text are passed on behind the ones that ``run`` makes.

    ``run`` gets (doc_id, text) batches and yields (number of rows, made columns)
    for one run of rows after the other.
    """
    made_schema = T.StructType.fromDDL(schema)

    def batches(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in given:
            lo = 0
            for n, made in run(batch):
                rest = [c.slice(lo, n) for c in batch.columns[2:]]
                yield pa.RecordBatch.from_arrays([*made, *rest], [*made_schema.names, *batch.schema.names[2:]])
                lo += n
    return docs.mapInArrow(batches, T.StructType(made_schema.fields + docs.schema.fields[2:]))


@dataclass
class Bloom:
    """A Bloom filter over 64-bit hashes, never over ``MAX_BITS`` bits (16 MB).

    It only spares work: what passes is always checked exactly afterwards, so
    a filter that is too full costs time and changes no result.
    """

    bits: np.ndarray  # uint64 words
    log2: int
    MAX_LOG2 = 27

    def _places(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mask = np.uint64((1 << self.log2) - 1)
        return h & mask, (h >> np.uint64(64 - self.log2)) & mask

    def has(self, h: np.ndarray) -> np.ndarray:
        six, low = np.uint64(6), np.uint64(63)
        a, b = self._places(h)
        found = (self.bits[a >> six] >> (a & low)) & np.uint64(1)
        at = np.flatnonzero(found)
        b = b[at]
        out = np.zeros(len(h), bool)
        out[at] = ((self.bits[b >> six] >> (b & low)) & np.uint64(1)).astype(bool)
        return out

    @classmethod
    def of(cls, hashes: DataFrame, column: str) -> "Bloom":
        """Built by Spark: each word of the bit array is one aggregated row.

        At most 2**21 rows of two longs reach the driver, whatever the input.
        """
        n = hashes.count()
        log2 = int(min(cls.MAX_LOG2, max(10, np.ceil(np.log2(max(n, 1) * 16)))))
        h, mask = F.col(column), (1 << log2) - 1
        place = F.explode(F.array(h.bitwiseAND(F.lit(mask)), F.shiftrightunsigned(h, 64 - log2).bitwiseAND(F.lit(mask))))
        words = (
            hashes.select(place.alias("p"))
            .groupBy(F.shiftrightunsigned("p", 6).alias("w"))
            .agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("b"))
            .toArrow()
        )
        bits = np.zeros(1 << (log2 - 6), np.uint64)
        bits[words.column("w").to_numpy()] = words.column("b").to_numpy().view(np.uint64)
        return cls(bits, log2)
