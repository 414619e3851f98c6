"""Operator 2: token ids in Arrow files of equal-length sequences.

Format.  A folder holds ``part-NNNNN.arrow`` files (Arrow IPC files) and
``index`` (Parquet).  A file's record batches have two fixed-size-list columns
of ``SEQUENCE`` items: ``tokens`` (uint16 if the vocabulary fits, else uint32)
and ``mask`` (one bit each, set for a real id).  The ids of a file's documents, each with the end id 0 appended, run
through its sequences without a break; only the last sequence is filled up, with
mask 0.  Sequence k of a file is therefore at a fixed place and can be sliced
from a memory map without a copy.  The index has one row per document: its
file, its first id within the file and its number of ids.

Files follow ascending doc_id: Spark range-partitions and sorts the documents,
and each task writes the file of its partition, under a name of its own first
and then renamed, so that a task that runs again leaves one whole file.

Ids come from the tokenizers library.  A byte-level vocabulary treats each
pre-token on its own, so the library encodes each distinct pre-token once per
task process (up to a bound) and the ids are gathered for every place where it stands; the tests hold
this against the library's ids of whole texts.

Null texts count as empty and have the end id alone; special-token strings are
ordinary text; a null doc_id comes first and repeated doc_ids keep one row for
each document; other columns are ignored; an empty table makes no files.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimspark.llm.common import doc_columns
from claimspark.llm.pretokens import every_character, kind_table, pre_tokens, ragged, unpack_kinds
from claimspark.llm.scan import byte_values, span_hashes, text_chunks

SEQUENCE = 2048
BATCH = 128          # sequences in a record batch
END_ID = 0
MEMO = 1_500_000     # pre-tokens that a task process keeps at most

MASK = pa.list_(pa.field("item", pa.bool_(), False), SEQUENCE)


def tokenizer_kinds(path: str) -> bytes:
    """The character kinds as the tokenizers library has them."""
    from tokenizers import Regex
    from tokenizers.pre_tokenizers import Split

    text = every_character()

    def matched(pattern: str) -> str:
        rest = {c for piece, _ in Split(Regex(pattern), "removed").pre_tokenize_str(text) for c in piece}
        return "".join(c for c in text if c not in rest)
    return kind_table(matched)


class PieceEncoder:
    """The library's ids of texts, by distinct pre-token; what was met before is kept up to a bound."""

    def __init__(self, path: str, kinds: bytes):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        self.kinds = unpack_kinds(kinds)
        self.width = np.uint16 if self.library.get_vocab_size() <= 1 << 16 else np.uint32
        self._forget()

    def _forget(self):
        self.keys = np.empty(0, np.uint64)
        self.begin = self.size = np.empty(0, np.int64)
        self.ids = np.empty(0, self.width)

    def _learn(self, pieces: list[bytes], h: np.ndarray):
        got = [e.ids for e in self.library.encode_batch_fast([p.decode("utf-8") for p in pieces], add_special_tokens=False)]
        size = np.array([len(x) for x in got], np.int64)
        keys, begin = np.concatenate([self.keys, h]), np.concatenate([self.begin, len(self.ids) + np.cumsum(size) - size])
        order = np.argsort(keys, kind="stable")
        self.keys, self.begin, self.size = keys[order], begin[order], np.concatenate([self.size, size])[order]
        self.ids = np.concatenate([self.ids, np.array([x for ids in got for x in ids], self.width)])

    def encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(all ids with an end id after each text, the number of ids of each text)."""
        starts, ends, first = pre_tokens(data, off, self.kinds)
        h, one, place = np.unique(span_hashes(data, starts, ends, byte_values(fold=False)),
                                  return_index=True, return_inverse=True)
        if len(self.keys) > MEMO:
            self._forget()
        at = np.searchsorted(self.keys, h)
        new = np.ones(len(h), bool)
        inside = at < len(self.keys)
        new[inside] = self.keys[at[inside]] != h[inside]
        if new.any():
            raw = data.tobytes()
            self._learn([raw[a:b] for a, b in zip(starts[one[new]].tolist(), ends[one[new]].tolist())], h[new])
            at = np.searchsorted(self.keys, h)
        size = self.size[at][place]
        ids = ragged(self.ids, self.begin[at][place], size)
        sums = np.concatenate([[0], np.cumsum(size)])[first]
        return np.insert(ids, sums[1:], self.width(END_ID)), np.diff(sums) + 1


_ENCODERS: dict[str, PieceEncoder] = {}


def _encoder(path: str, kinds: bytes) -> PieceEncoder:
    """One for the task process: the next task goes on with what this one has met."""
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path, kinds)
    return _ENCODERS[path]


def arrow_name(folder: str) -> str:
    """A folder named as Spark names it, as Arrow names it: ``s3a://`` is its ``s3://``.

    Arrow takes the keys and the region of an object store from the environment of the task processes.
    """
    if folder.startswith("file:") or "://" not in folder:
        return "file://" + "/" + folder.removeprefix("file:").lstrip("/")
    scheme, rest = folder.split("://", 1)
    return f"{'s3' if scheme in ('s3a', 's3n') else scheme}://{rest}"


def _open(folder: str):
    """(file system, path) of a folder named as Spark names it."""
    return pafs.FileSystem.from_uri(arrow_name(folder))


def _batch(ids: np.ndarray) -> pa.RecordBatch:
    n = -(-len(ids) // SEQUENCE)
    tokens, mask = np.zeros(n * SEQUENCE, ids.dtype), np.zeros(n * SEQUENCE, bool)
    tokens[:len(ids)] = ids
    mask[:len(ids)] = True
    kind = pa.list_(pa.field("item", pa.from_numpy_dtype(ids.dtype), False), SEQUENCE)
    return pa.RecordBatch.from_arrays(
        [pa.FixedSizeListArray.from_arrays(pa.array(tokens), type=kind), pa.FixedSizeListArray.from_arrays(pa.array(mask), type=MASK)],
        schema=pa.schema([pa.field("tokens", kind, False), pa.field("mask", MASK, False)]))


def _write(path: str, kinds: bytes, folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        fs, top = _open(folder)
        draft, encoder, sink, writer = f"{top}/.part-{part:05d}-{uuid.uuid4().hex}", None, None, None
        left, done = np.empty(0, np.uint16), 0
        for batch in batches:
            for lo, hi, data, off in text_chunks(batch.column(1)):
                if writer is None:
                    encoder = _encoder(path, kinds)
                    left = left.astype(encoder.width)
                    fs.create_dir(top, recursive=True)
                    sink = fs.open_output_stream(draft)
                    writer = pa.ipc.new_file(sink, _batch(left).schema)
                ids, counts = encoder.encode(data, off)
                left = np.concatenate([left, ids])
                whole = len(left) // (SEQUENCE * BATCH) * SEQUENCE * BATCH
                for k in range(0, whole, SEQUENCE * BATCH):
                    writer.write_batch(_batch(left[k:k + SEQUENCE * BATCH]))
                left = left[whole:]
                first = done + np.cumsum(counts) - counts
                done += int(counts.sum())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(np.full(hi - lo, part, np.int32)), pa.array(first),
                     pa.array(counts)], ["doc_id", "part", "first", "n_tokens"])
        if writer is not None:
            if len(left):
                writer.write_batch(_batch(left))
            writer.close()
            sink.close()
            fs.move(draft, f"{top}/part-{part:05d}.arrow")
    return run


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, partitions: int | None = None) -> DataFrame:
    """Writes the files and the index below ``folder``; returns the index as read back."""
    docs = doc_columns(docs)
    spark = docs.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["doc_id", "tie"]
    dealt = (docs.withColumn("tie", F.xxhash64("text")).repartitionByRange(n, *order)
             .sortWithinPartitions(*order).select("doc_id", "text"))
    index = dealt.mapInArrow(_write(tokenizer, tokenizer_kinds(tokenizer), folder),
                             "doc_id long, part int, first long, n_tokens long")
    index.write.parquet(f"{folder}/index")
    return spark.read.schema(index.schema).parquet(f"{folder}/index")


class TokenFile:
    """One file, opened for random access; ids are slices of the file's own memory."""

    def __init__(self, folder: str, part: int):
        fs, top = _open(folder)
        path = f"{top}/part-{part:05d}.arrow"
        self.source = pa.memory_map(path) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(path)
        self.reader = pa.ipc.open_file(self.source)
        self.held = (-1, None)

    def batch(self, k: int) -> pa.RecordBatch:
        if self.held[0] != k:
            self.held = (k, self.reader.get_batch(k))
        return self.held[1]

    def sequence(self, k: int) -> tuple[pa.Array, pa.Array]:
        """The ids and the mask of sequence k."""
        batch, row = self.batch(k // BATCH), k % BATCH
        return tuple(batch.column(c).slice(row, 1).flatten() for c in (0, 1))

    def ids(self, first: int, n: int) -> np.ndarray:
        """n ids from the first on."""
        out, per = [], SEQUENCE * BATCH
        for k in range(first // per, (first + n - 1) // per + 1):
            flat = self.batch(k).column(0).flatten().to_numpy()
            out.append(flat[max(first - k * per, 0):first + n - k * per])
        return out[0] if len(out) == 1 else np.concatenate(out)


def _read(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, file = None, None
        for batch in batches:
            part, first, size = (batch.column(k).to_numpy() for k in (1, 2, 3))
            sums = []
            for k in range(len(part)):
                if part[k] != now:
                    now, file = part[k], TokenFile(folder, int(part[k]))
                sums.append(zlib.crc32(file.ids(int(first[k]), int(size[k])).astype("<u4")))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sums, pa.int64())], [*batch.schema.names, "ids_crc32"])
    return run


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files."""
    index = spark.read.parquet(f"{folder}/index")
    sizes = index.groupBy("part").agg(F.sum("n_tokens").alias("size"))  # one row per file
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("part", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("base"))
    placed = index.join(starts, "part").select("doc_id", "part", "first", "n_tokens", "base")
    files = placed.repartition("part").sortWithinPartitions("part", "first")
    read = files.mapInArrow(_read(folder), "doc_id long, part int, first long, n_tokens long, base long, ids_crc32 long")
    return read.select("doc_id", (F.col("base") + F.col("first")).alias("start"), "n_tokens", "ids_crc32")
