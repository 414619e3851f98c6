"""Operator 6: byte-level BPE encoding and decoding with a two-tier lookup.

Texts are split into pre-tokens; each distinct pre-token of a chunk of texts is
resolved once and its ids are gathered for every place where it stands.

* Tier one: a minimal perfect hash over the vocabulary's byte strings says in
  one probe which entry a pre-token could be; equal bytes make it that entry.
* Tier two: a pre-token that is no entry is a linked list of bytes; a heap holds
  the pairs by rank and the lowest one is merged until no pair has a rank.

Decoding joins the bytes of the ids.  Null texts count as empty and have no
ids; special-token strings are ordinary text; repeated rows are encoded alike;
other columns are ignored.  The rank file's path is a parameter.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimspark.llm.common import doc_columns, map_docs
from claimspark.llm.pretokens import every_character, kind_table, pre_tokens, ragged, unpack_kinds
from claimspark.llm.scan import byte_values, lists, mix, span_hashes, text_chunks

MEMO = 200_000  # merged pre-tokens that a task keeps at most
DECODE_IDS = 1 << 20  # ids that are decoded at once


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def rank_kinds(ranks: dict[bytes, int]) -> bytes:
    """The character kinds as the library that reads such rank files has them."""
    import tiktoken

    text = every_character()

    def matched(pattern: str) -> str:
        library = tiktoken.Encoding("kinds", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        return library.decode(library.encode_ordinary(text))
    return kind_table(matched)


def _hashes(strings: list[bytes]) -> np.ndarray:
    data = np.frombuffer(b"".join(strings), np.uint8)
    ends = np.cumsum([len(s) for s in strings])
    return span_hashes(data, ends - [len(s) for s in strings], ends, byte_values(fold=False))


@dataclass
class PerfectHash:
    """Slots 0 to n - 1 for n keys: a bucket's seed sends its keys to free slots; a lone key's slot is written down."""

    seeds: np.ndarray  # a seed from 0 on, or -1 - slot
    size: int

    def slots(self, h: np.ndarray) -> np.ndarray:
        seed = self.seeds[h % np.uint64(len(self.seeds))]
        slot = mix(h + seed.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(self.size)
        return np.where(seed < 0, -1 - seed, slot.astype(np.int64))

    @classmethod
    def build(cls, h: np.ndarray) -> "PerfectHash":
        n = len(h)
        seeds = np.zeros(max(1, n // 3), np.int64)
        bucket = (h % np.uint64(len(seeds))).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        count = np.bincount(bucket, minlength=len(seeds))
        begin = np.cumsum(count) - count
        free = np.ones(n, bool)
        alone = []
        for b in np.argsort(-count, kind="stable"):
            keys = h[order[begin[b]:begin[b] + count[b]]]
            if len(keys) < 2:
                alone += [b] * len(keys)
                continue
            seed = 0
            while True:
                trial = mix(keys[None, :] + np.arange(seed, seed + 64, dtype=np.uint64)[:, None]
                            * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(n)
                good = free[trial.astype(np.int64)].all(axis=1)
                for k in np.flatnonzero(good):
                    if len(set(trial[k].tolist())) == len(keys):
                        break
                else:
                    seed += 64
                    continue
                seeds[b] = seed + k
                free[trial[k].astype(np.int64)] = False
                break
        seeds[alone] = -1 - np.flatnonzero(free)[:len(alone)]
        return cls(seeds, n)


class Vocabulary:
    """Ranks by byte string, with the perfect hash in front."""

    def __init__(self, ranks: dict[bytes, int], kinds: bytes):
        strings = list(ranks)
        h = _hashes(strings)
        if len(np.unique(h)) != len(h):
            raise ValueError("two vocabulary entries have one hash")
        self.hash = PerfectHash.build(h)
        slots = self.hash.slots(h)
        self.entries = [strings[i] for i in np.argsort(slots)]
        self.ids = np.array([ranks[s] for s in self.entries], np.int32)
        self.kinds = kinds
        self._state = self._decoder = None

    def __getstate__(self):
        return {"hash": self.hash, "entries": self.entries, "ids": self.ids, "kinds": self.kinds, "_state": None, "_decoder": None}

    def decoder(self) -> "Decoder":
        if self._decoder is None:  # once per task process
            self._decoder = Decoder(self)
        return self._decoder

    def _load(self):
        if self._state is None:  # once per task process
            self._state = (dict(zip(self.entries, self.ids.tolist())), unpack_kinds(self.kinds), {})
        return self._state

    def merge(self, piece: bytes) -> list[int]:
        """Tier two: the heap over linked bytes."""
        ranks = self._load()[0]
        n = len(piece)
        end, after, before = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i:i + 2])) is not None]
        heapq.heapify(heap)
        live = [True] * n
        while heap:
            _, i, j, stop = heapq.heappop(heap)
            if not live[i] or j >= n or not live[j] or end[i] != j or end[j] != stop:
                continue  # one of the two has been merged since
            live[j] = False
            end[i], after[i] = stop, after[j]
            if stop < n:
                before[stop] = i
                if (r := ranks.get(piece[i:end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, stop, end[stop]))
            if (k := before[i]) >= 0 and (r := ranks.get(piece[k:stop])) is not None:
                heapq.heappush(heap, (r, k, i, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i:end[i]]])
            i = after[i]
        return out

    def resolve(self, pieces: list[bytes], h: np.ndarray) -> list[list[int]]:
        """The ids of each byte string; h are their hashes."""
        memo = self._load()[2]
        out = []
        for piece, slot in zip(pieces, self.hash.slots(h).tolist()):
            if self.entries[slot] == piece:
                out.append([int(self.ids[slot])])
                continue
            ids = memo.get(piece)
            if ids is None:
                ids = self.merge(piece)
                if len(memo) >= MEMO:
                    memo.clear()
                memo[piece] = ids
            out.append(ids)
        return out

    def encode_chunk(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, the number of ids of each text)."""
        starts, ends, first = pre_tokens(data, off, self._load()[1])
        h, one, place = np.unique(span_hashes(data, starts, ends, byte_values(fold=False)),
                                  return_index=True, return_inverse=True)
        raw = data.tobytes()
        found = self.resolve([raw[a:b] for a, b in zip(starts[one].tolist(), ends[one].tolist())], h)
        size = np.array([len(x) for x in found], np.int64)
        flat = np.array([x for ids in found for x in ids], np.int32)
        sums = np.concatenate([[0], np.cumsum(size[place])])
        return ragged(flat, (np.cumsum(size) - size)[place], size[place]), np.diff(sums[first])


def vocabulary(path: str) -> Vocabulary:
    ranks = read_ranks(path)
    return Vocabulary(ranks, rank_kinds(ranks))


class Decoder:
    """The bytes of every id, one after another, and where each one's stand."""

    def __init__(self, vocab: Vocabulary):
        order = np.argsort(vocab.ids)
        strings = [vocab.entries[i] for i in order]
        self.size = np.zeros(int(vocab.ids.max()) + 1, np.int64)
        self.size[vocab.ids[order]] = [len(s) for s in strings]
        self.begin = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(strings), np.uint8)

    def texts(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(all bytes, offsets) of texts with ``counts`` ids each."""
        size = self.size[ids]
        stops = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(counts)])]
        return ragged(self.flat, self.begin[ids], size), stops


def _binary(data: np.ndarray, stops: np.ndarray) -> pa.Array:
    return pa.BinaryArray.from_buffers(pa.binary(), len(stops) - 1, [None, pa.py_buffer(stops.astype(np.int32)), pa.py_buffer(data)])


def encode(docs: DataFrame, vocab: Vocabulary) -> DataFrame:
    """doc_id and ids (array of int): one row per document."""
    docs = doc_columns(docs)
    shared = docs.sparkSession.sparkContext.broadcast(vocab)  # as large as the vocabulary file

    def run(batch: pa.RecordBatch) -> Iterator[tuple[int, list]]:
        for lo, hi, data, off in text_chunks(batch.column(1)):
            ids, counts = shared.value.encode_chunk(data, off)
            yield hi - lo, [batch.column(0).slice(lo, hi - lo), lists(pa.array(ids), counts)]
    return map_docs(docs, run, "doc_id bigint, ids array<int>")


def decode(encoded: DataFrame, vocab: Vocabulary) -> DataFrame:
    """Adds decoded (binary): the bytes of ids."""
    shared = encoded.sparkSession.sparkContext.broadcast(vocab)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(shared.value)
        for batch in batches:
            at = batch.schema.get_field_index("ids")
            counts = batch.column(at).value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            total, lo = np.concatenate([[0], np.cumsum(counts)]), 0
            while lo < len(counts):
                hi = max(lo + 1, int(np.searchsorted(total, total[lo] + DECODE_IDS, "right")) - 1)
                part = batch.slice(lo, hi - lo)
                decoded = _binary(*decoder.texts(part.column(at).flatten().to_numpy(), counts[lo:hi]))
                yield pa.RecordBatch.from_arrays([*part.columns, decoded], [*part.schema.names, "decoded"])
                lo = hi
    return encoded.mapInArrow(run, T.StructType([*encoded.schema.fields, T.StructField("decoded", T.BinaryType())]))


def round_trip(docs: DataFrame, vocab: Vocabulary, carry: Sequence[str] = ()) -> DataFrame:
    """doc_id, ids, decoded and same (the decoded bytes are the text's): encoded and decoded again in one pass.

    One task process does both, so that the ids do not go to Spark and back in
    between.  The columns named in ``carry`` are passed on as they are, in the struct row.
    """
    read = doc_columns(docs)
    if carry:
        read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                           F.struct(*carry).alias("row"))
    shared = read.sparkSession.sparkContext.broadcast(vocab)  # as large as the vocabulary file

    def run(batch: pa.RecordBatch) -> Iterator[tuple[int, list]]:
        decoder = shared.value.decoder()
        for lo, hi, data, off in text_chunks(batch.column(1)):
            ids, counts = shared.value.encode_chunk(data, off)
            back, stops = decoder.texts(ids, counts)
            if np.array_equal(back, data) and np.array_equal(stops, off):
                same = np.ones(hi - lo, bool)
            else:
                same = np.array([np.array_equal(back[stops[k]:stops[k + 1]], data[off[k]:off[k + 1]]) for k in range(hi - lo)])
            yield hi - lo, [batch.column(0).slice(lo, hi - lo), lists(pa.array(ids), counts), _binary(back, stops), pa.array(same)]
    return map_docs(read, run, "doc_id bigint, ids array<int>, decoded binary, same boolean")


def digests(docs: DataFrame, vocab: Vocabulary) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encoded, decoded again and summed up."""
    both = round_trip(docs, vocab)
    written = F.array_join(F.col("ids").cast("array<string>"), " ")
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(written, 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))
