"""Operator 12: chat formatting over a prefix tree of conversations.

Template.  Every turn is formatted on its own: an opening mark, its text, a
closing mark (``MARKS``; any other role is written out between marks of its
own).  A control string inside a text or role gets a backslash behind its first
character, and one more if it has some, so no text holds a control string and
``unescaped`` takes exactly what was added away again.

Tree.  A node is a turn behind given turns; conversations that begin with the
same turns share its nodes.  A node's id is the exclusive or of two 64-bit
hashes of (depth, role, text) of all turns up to it, 128 bits in all, so ids
come from running aggregates; ``BLOCK`` turns of a conversation at most are in
one window, and what lies before a block is added from the blocks' own sums.

Order.  The tokens of all nodes are laid out depth first.  A conversation's
place follows from the choices on its way: its first node and each node whose
parent has several children.  Conversations sorted by these choices, shorter
ones first among equals, are the leaves of the tree from left to right; a node
belongs to the first one that has it and reaches to the last one that has it.
Only choices are collected, 24 bytes each, never texts, and one choice is all
that a conversation behind a shared first turn needs; copies of a conversation
are one leaf.

Output (``pack``), two written tables:

* ``sequences``: one row per node, in files of ascending ``start``: ``start`` (its
  first token among all), ``n_tokens``, ``ids``, ``position`` (the tokens before it
  in its conversation, the position id of its first token), ``end`` (the token
  after its subtree: token t of a node is seen by the tokens of [t, end), its
  own ones behind it and its descendants', and by no other), ``loss_from`` and
  ``loss_to`` (tokens of the node under the loss mask: an assistant's text),
  ``depth``, ``part`` (the file's number);
* ``members``: conv_id, the ``start`` of its last node and its number of turns.

``read_back`` restores conversations from the sequences alone: a task walks its
files with a stack of the nodes whose intervals are open, those open at the
beginning of a part being sent along.

Null texts and roles count as empty; rows of one turn go by role and text, null
turns first; rows with a null conv_id make one conversation; repeated rows are
turns of their own; other columns are ignored; an empty table makes empty ones.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimspark.llm.bpe import Vocabulary, decode
from claimspark.llm.common import ship
from claimspark.llm.scan import lists, text_chunks
from claimspark.plans.session import save

BLOCK = 1024
CHUNK_BYTES = 1 << 20

# role: opening and closing mark
MARKS = {
    "system": ("<<SYS>>\n", "\n<</SYS>>\n"),
    "user": ("[INST] ", " [/INST]"),
    "assistant": ("<s> ", " </s>"),
}
ROLE_OPEN, ROLE_MIDDLE, ROLE_CLOSE = "<<ROLE>>", "<</ROLE>>\n", "\n</s>"
TRAINED = "assistant"

#: First character and rest of every control string.
_CONTROL = r"([<\[])(\\*)(/?s>|</?SYS>>|</?ROLE>>|/?INST\])"
_ESCAPED = re.compile(r"([<\[])\\(\\*)(/?s>|</?SYS>>|</?ROLE>>|/?INST\])")


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, _CONTROL, r"$1\\$2$3")


def unescaped(text: str) -> str:
    return _ESCAPED.sub(r"\1\2\3", text)


def formatted(role: Column, text: Column) -> list[Column]:
    """The opening mark, the escaped text and the closing mark of a turn."""
    start, stop = F.concat(F.lit(ROLE_OPEN), escaped(role), F.lit(ROLE_MIDDLE)), F.lit(ROLE_CLOSE)
    for name, (before, after) in MARKS.items():
        start, stop = F.when(role == name, before).otherwise(start), F.when(role == name, after).otherwise(stop)
    return [start.alias("before"), escaped(text).alias("body"), stop.alias("after")]


def parsed(turn: str) -> tuple[str, str]:
    """The role and the text of a formatted turn."""
    for name, (before, after) in MARKS.items():
        if turn.startswith(before):
            return name, unescaped(turn[len(before):len(turn) - len(after)])
    role, _, text = turn[len(ROLE_OPEN):].partition(ROLE_MIDDLE)
    return unescaped(role), unescaped(text[:len(text) - len(ROLE_CLOSE)])


def _running(rows: DataFrame, keys: list[str], order: list[str], totals: dict[str, Column]) -> DataFrame:
    """Adds aggregates over all rows of the same keys up to this one; keys end with a block that ascends with the order.

    A window holds one block.  What the blocks before it come to is aggregated
    over one row per block, and joined only where there are several.
    ``totals`` names sums (of a number) and exclusive ors (named ``p...``).
    """
    whole, block = keys[:-1], keys[-1]
    within = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = Window.partitionBy(*whole).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)

    def total(name: str, value) -> Column:
        return F.bit_xor(value) if name.startswith("p") else F.sum(value)
    blocks = rows.groupBy(*keys).agg(*[total(name, value).alias(name) for name, value in totals.items()])
    blocks = blocks.select(*keys, *[total(name, F.col(name)).over(earlier).alias(f"{name}_before") for name in totals])
    blocks = blocks.filter(F.col(f"{next(iter(totals))}_before").isNotNull())
    out = rows.withColumns({name: total(name, value).over(within) for name, value in totals.items()}).alias("r")
    blocks = blocks.alias("b")
    same = [F.col(f"r.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    out = out.join(blocks, same, "left").drop(*[F.col(f"b.{k}") for k in keys])
    for name in totals:
        before = F.coalesce(f"{name}_before", F.lit(0))
        out = out.withColumn(name, F.col(name).bitwiseXOR(before) if name.startswith("p") else F.col(name) + before)
    return out.drop(*[f"{name}_before" for name in totals])


def prefixes(conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """conv_id, depth, role, text, the node's id (p1, p2) and its parent's (q1, q2; 0, 0 at depth 0): one row per turn."""
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("block", F.floor(F.col("turn") / block))
    order = ["turn", "role", "text"]
    rows = _running(rows, ["conv_id", "block"], order, {"number": F.lit(1).cast("long")})
    rows = rows.withColumn("depth", F.col("number") - 1)
    rows = rows.withColumns({f"x{k}": F.xxhash64(F.lit(k), "depth", "role", "text") for k in (1, 2)})
    rows = _running(rows, ["conv_id", "block"], order, {f"p{k}": F.col(f"x{k}") for k in (1, 2)})
    return rows.select("conv_id", "depth", "role", "text", "p1", "p2",
                       *[F.col(f"p{k}").bitwiseXOR(F.col(f"x{k}")).alias(f"q{k}") for k in (1, 2)])


def _tokens(shared):
    """The ids of each node's marks and text, and which ones are under the loss mask."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = {name: k for k, name in enumerate(batch.schema.names)}
            for lo, hi, _, _ in text_chunks(batch.column(at["body"]), CHUNK_BYTES):
                part = batch.slice(lo, hi - lo)
                three = [part.column(at[name]).to_pylist() for name in ("before", "body", "after")]
                pieces = [x.encode() for turn in zip(*three) for x in turn]
                ids, n = shared.value.encode_chunk(np.frombuffer(b"".join(pieces), np.uint8),
                                                   np.concatenate([[0], np.cumsum([len(x) for x in pieces])]))
                n = n.reshape(-1, 3)
                loss = np.array([r == TRAINED for r in part.column(at["role"]).to_pylist()])
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(at[name]) for name in ("p1", "p2", "q1", "q2", "depth")], lists(pa.array(ids), n.sum(axis=1)),
                     pa.array(n.sum(axis=1)), *[pa.array(np.where(loss, x, 0)) for x in (n[:, 0], n[:, 0] + n[:, 1])]],
                    ["p1", "p2", "q1", "q2", "depth", "ids", "n_tokens", "loss_from", "loss_to"])
    return run


NODES = "p1 long, p2 long, q1 long, q2 long, depth long, ids array<int>, n_tokens long, loss_from long, loss_to long"


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the sum of n_tokens of the rows before in the same partition."""
    total = 0
    for batch in batches:
        n = batch.column(batch.schema.get_field_index("n_tokens")).to_numpy()
        before = total + np.cumsum(n) - n
        total += int(n.sum())
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(before.astype(np.int64))], [*batch.schema.names, "before"])


def _ddl(df: DataFrame, more: str) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields) + f", {more}"


@dataclass
class Packed:
    sequences: DataFrame
    members: DataFrame


def pack(conversations: DataFrame, vocab: Vocabulary, folder: str, block: int = BLOCK) -> Packed:
    """Writes ``sequences`` and ``members`` below ``folder``; returns them as read back."""
    spark = conversations.sparkSession
    ship(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    node, leaf = ["p1", "p2"], ["l1", "l2"]
    turns = save(prefixes(conversations, block), "turns")
    shared = spark.sparkContext.broadcast(vocab)  # as large as the vocabulary file
    nodes = turns.dropDuplicates(node).select(*node, "q1", "q2", "depth", "role", *formatted(F.col("role"), F.col("text")))
    nodes = save(nodes.mapInArrow(_tokens(shared), NODES), "nodes")

    # one conversation for each leaf
    last = F.max(F.struct("depth", *node)).alias("last")
    members = save(turns.groupBy("conv_id").agg(last).select("conv_id", (F.col("last.depth") + 1).alias("n_turns"), "last.p1", "last.p2"), "members")
    chosen = members.groupBy(*node, "n_turns").agg(F.min(F.struct("conv_id")).alias("one"))
    chosen = chosen.select(F.col("one.conv_id").alias("chosen"), F.col("p1").alias("l1"), F.col("p2").alias("l2"), "n_turns")
    paths = turns.select("conv_id", "depth", *node).join(chosen, F.col("conv_id").eqNullSafe(F.col("chosen"))).drop("conv_id", "chosen")

    # nodes that are a choice, and the tokens before each node
    several = nodes.filter("depth > 0").groupBy("q1", "q2").agg(F.count(F.lit(1)).alias("children")).filter("children > 1")
    several = save(several, "several")  # so that adaptive execution can split the children of a hot parent
    known = nodes.select(*node, "q1", "q2", "n_tokens").join(several, ["q1", "q2"], "left")
    known = save(known.select(*node, "n_tokens", F.col("children").isNotNull().alias("choice")), "choices")
    paths = paths.join(known, node).withColumn("block", F.floor(F.col("depth") / block))
    paths = save(_running(paths, [*leaf, "block"], ["depth"], {"through": F.col("n_tokens")}).drop("block"), "paths")

    choices = paths.filter("choice or depth = 0").groupBy(*leaf, "n_turns").agg(F.sort_array(F.collect_list(F.struct("depth", *node))).alias("way"))
    order = choices.repartitionByRange(n, "way", "n_turns").sortWithinPartitions("way", "n_turns")
    order = save(order.select(*leaf, F.monotonically_increasing_id().alias("rank")), "order")
    owned = paths.join(order, leaf).groupBy(*node, "depth", "n_tokens").agg(
        F.min("rank").alias("owner"), F.max("rank").alias("last"), F.min(F.col("through") - F.col("n_tokens")).alias("position"))

    # the first token of each node, and the token after its subtree
    owned = owned.repartitionByRange(n, "owner", "depth").sortWithinPartitions("owner", "depth")
    owned = owned.withColumn("part", F.spark_partition_id())
    owned = save(owned.mapInArrow(_summed, _ddl(owned, "before long")), "owned")
    sizes = {r.part: r.n for r in owned.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()}  # one row per partition
    bases, total = [], 0
    for part in sorted(sizes):
        bases.append((part, total))
        total += sizes[part]
    bases = spark.createDataFrame(bases or [(0, 0)], "part int, base long")
    owned = owned.join(F.broadcast(bases), "part").withColumn("start", F.col("base") + F.col("before"))
    ends = owned.groupBy("owner").agg(F.max(F.col("start") + F.col("n_tokens")).alias("end")).withColumnRenamed("owner", "last")
    placed = save(owned.join(ends, "last").select(*node, "start", "end", "position"), "placed")

    out = nodes.join(placed, node).select("start", "end", "position", "n_tokens", "ids", "loss_from", "loss_to", "depth")
    out = out.repartitionByRange(n, "start").sortWithinPartitions("start").withColumn("part", F.spark_partition_id())
    out.write.parquet(f"{folder}/sequences")
    where = members.join(placed.select(*node, "start"), node).select("conv_id", "start", "n_turns")
    where.write.parquet(f"{folder}/members")
    return Packed(spark.read.schema(out.schema).parquet(f"{folder}/sequences"),
                  spark.read.schema(where.schema).parquet(f"{folder}/members"))


def token_arrays(sequences: DataFrame) -> DataFrame:
    """Each node's ids with arrays as long: position_ids, loss_mask, and the interval (sees_from, sees_to) of tokens that see each one."""
    places = F.when(F.col("n_tokens") > 0, F.sequence(F.lit(0).cast("long"), F.col("n_tokens") - 1)).otherwise(F.array().cast("array<bigint>"))
    return sequences.select(
        "start", "ids", F.transform(places, lambda k: F.col("position") + k).alias("position_ids"),
        F.transform(places, lambda k: (k >= F.col("loss_from")) & (k < F.col("loss_to"))).alias("loss_mask"),
        F.transform(places, lambda k: F.col("start") + k).alias("sees_from"),
        F.transform(places, lambda k: F.col("end")).alias("sees_to"))


def _sent(firsts: np.ndarray):
    """Every node to its own part, and to each later part that begins inside its interval."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start, end = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("start", "end"))
            lo, hi = np.searchsorted(firsts, start, "right"), np.searchsorted(firsts, end, "left")
            more = np.maximum(hi - lo, 0)
            row = np.repeat(np.arange(batch.num_rows), 1 + more)
            own = np.concatenate([[True], row[1:] != row[:-1]]) if len(row) else np.zeros(0, bool)
            place = np.arange(len(row)) - np.repeat(np.cumsum(1 + more) - (1 + more), 1 + more)
            to = lo[row] - 1 + place  # the part that holds its start, then the next ones
            yield pa.RecordBatch.from_arrays(
                [*batch.take(pa.array(row)).columns, pa.array(own), pa.array(to.astype(np.int32))],
                [*batch.schema.names, "own", "to"])
    return run


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of the conversation that ends at each node, from a stack of the open nodes."""
    stack: list = []
    for batch in batches:
        names = ("to", "own", "start", "end", "whole", "loss")
        rows = zip(*[batch.column(batch.schema.get_field_index(c)).to_pylist() for c in names])
        out: list = []
        for to, own, start, end, whole, loss in rows:
            while stack and (stack[-1][0] != to or stack[-1][1] <= start):
                stack.pop()
            turn = whole.decode()
            role, text = parsed(turn)
            if stack:
                _, _, n, turns, chars, losses, size = stack[-1]
                turns, losses = turns.copy(), losses.copy()
            else:
                n, turns, chars, losses, size = 0, hashlib.sha256(), 0, hashlib.sha256(), 0
            turns.update(f"{role}\n{text}\n".encode())
            trained = unescaped(loss.decode())
            losses.update(trained.encode())
            stack.append((to, end, n + 1, turns, chars + len(trained), losses, size + len(turn)))
            if own:
                out.append((start, n + 1, turns.hexdigest(), chars + len(trained), losses.hexdigest(), size + len(turn)))
        columns = list(zip(*out)) if out else [()] * 6
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)],
                                         ["start", "turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def read_back(packed: Packed, vocab: Vocabulary) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars of every conversation, from the sequences."""
    firsts = packed.sequences.groupBy("part").agg(F.min("start").alias("first")).orderBy("first").collect()  # one row per file
    starts = np.array([r["first"] for r in firsts], np.int64)
    rows = packed.sequences.select("start", "end", "ids", F.slice("ids", F.col("loss_from") + 1, F.col("loss_to") - F.col("loss_from")).alias("trained"))
    rows = rows.mapInArrow(_sent(starts), _ddl(rows, "own boolean, to int"))
    rows = rows.repartitionById(max(1, len(starts)), F.col("to")).sortWithinPartitions("to", "start")
    rows = decode(rows, vocab).withColumnRenamed("decoded", "whole").drop("ids").withColumnRenamed("trained", "ids")
    rows = decode(rows, vocab).withColumnRenamed("decoded", "loss").drop("ids")
    read = rows.mapInArrow(_walk, "start long, turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    return packed.members.join(read, "start").select("conv_id", F.col("turns").alias("n_turns"), "turns_sha256", "loss_chars",
                                                     "loss_sha256", "formatted_chars")
