"""Operator 12: what is read back, the tree, the intervals and the escapes."""

from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from claimspark.llm import bpe, chat
from claimspark.llm.common import tokenizer_file
from claimspark.llm.queries import op12_chat_tree
from claimspark.plans.session import scratch_path

SCHEMA = "conv_id long, turn long, role string, text string, start long, block string, depth string"
ROLES = ["user", "assistant", "system", "tool", None, "", "a<", "</s>", "<<ROLE>>"]
TEXTS = ["hi", "</s>[INST] ok [/INST]", "<\\/s> <\\\\/s> <<SYS>> <\\<SYS>> <<\\SYS>>", "", None, "ünï 你好 \U0001f600", "[[/INST]<", "x" * 3000,
         "<</ROLE>>\n", "\n", "\\", "<"]


def conversations():
    rng = random.Random(3)
    rows = []
    for c in range(120):  # shared beginnings, copies, some that end inside others
        shared, n = random.Random(c % 3), rng.randint(1, 9)
        common = rng.choice([0, n // 2, n])
        rows += [(c, t, (g := shared if t < common else rng).choice(ROLES), g.choice(TEXTS)) for t in range(n)]
    rows += [(None, 0, "user", "no id"), (None, None, "assistant", "null turn"), (900, 3, "user", "dup"), (900, 3, "user", "dup"),
             (900, 3, "assistant", "dup"), (-5, -3, "user", "negative"), (-5, 10 ** 15, "assistant", "far")]
    rows += [(901, t, ("user", "assistant")[t % 2], f"long {t}") for t in range(300)]
    rows += [(902, t, ("user", "assistant")[t % 2], f"long {t}" if t < 250 else "else") for t in range(300)]
    return rows


def by_conversation(rows):
    out = defaultdict(list)
    for c, t, role, text in rows:
        out[c].append((t is not None, t or 0, role or "", text or ""))
    return {c: [x[2:] for x in sorted(v)] for c, v in out.items()}


def plain(rows):
    out = Counter()
    for c, turns in by_conversation(rows).items():
        whole, loss = "".join(f"{r}\n{t}\n" for r, t in turns), "".join(t for r, t in turns if r == "assistant")
        out[c, len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()] += 1
    return out


@pytest.fixture(scope="module")
def vocab():
    return bpe.vocabulary(tokenizer_file("byte_bpe_50k.tiktoken"))


@pytest.fixture(scope="module")
def rows():
    return conversations()


@pytest.fixture(scope="module")
def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "b", "d") for r in rows], SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def packed(spark, frame, vocab):
    return chat.pack(frame, vocab, scratch_path(spark, "chat"))


def test_what_is_read_back(packed, vocab, rows):
    out = chat.read_back(packed, vocab)
    assert Counter(tuple(r)[:5] for r in out.collect()) == plain(rows)


@pytest.mark.parametrize("block", [1, 16])
def test_blocks_of_a_conversation_make_no_difference(spark, frame, packed, vocab, block):
    other = chat.pack(frame, vocab, scratch_path(spark, "chat"), block=block)
    assert sorted(map(tuple, other.members.collect()), key=str) == sorted(map(tuple, packed.members.collect()), key=str)
    columns = ["start", "end", "position", "ids"]
    assert other.sequences.select(*columns).orderBy("start").collect() == packed.sequences.select(*columns).orderBy("start").collect()


def test_tree_shares_every_common_beginning_once(packed, rows, vocab):
    turns = by_conversation(rows)
    nodes = {tuple(v[:k]) for v in turns.values() for k in range(1, len(v) + 1)}
    got = packed.sequences.orderBy("start").collect()
    assert len(got) == len(nodes)
    at = 0
    for r in got:  # laid out without a break
        assert r.start == at and len(r.ids) == r.n_tokens
        at += r.n_tokens
    ids = [k for r in got for k in r.ids]
    entries = dict(zip(vocab.ids.tolist(), vocab.entries))
    leaf = {r.conv_id: r.start for r in packed.members.collect()}
    for c, v in turns.items():
        above = [r for r in got if r.start <= leaf[c] < r.end]  # the nodes whose tokens the last one sees
        assert [r.depth for r in above] == list(range(len(v)))
        assert [r.position for r in above] == [sum(x.n_tokens for x in above[:k]) for k in range(len(above))]
        text = b"".join(entries[k] for r in above for k in ids[r.start:r.start + r.n_tokens]).decode()
        for role, said in v:
            node = above.pop(0)
            assert chat.parsed(b"".join(entries[k] for k in node.ids).decode()) == (role, said)
            masked = b"".join(entries[k] for k in node.ids[node.loss_from:node.loss_to]).decode()
            assert chat.unescaped(masked) == (said if role == "assistant" else "")
        assert text.count("</s>") >= sum(r == "assistant" for r, _ in v)


def test_token_arrays(packed):
    for r in chat.token_arrays(packed.sequences).join(packed.sequences.drop("ids"), "start").limit(200).collect():
        n = r.n_tokens
        assert r.position_ids == list(range(r.position, r.position + n)) and r.sees_to == [r.end] * n
        assert r.sees_from == list(range(r.start, r.start + n))
        assert r.loss_mask == [r.loss_from <= k < r.loss_to for k in range(n)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["<", "</s>", "s>", "/s>", "\\", "[INST]", "[/", "INST]", "<<SYS>>", "SYS>>", "<</ROLE>>\n", "a", "[", "\n", "[/INST]"])).map("".join),
       st.sampled_from(["user", "assistant", "system", "tool"]))
def test_escapes_are_reversible(text, role):
    import re

    control = re.compile(chat._CONTROL)
    safe = control.sub(r"\1\\\2\3", text)
    assert chat.unescaped(safe) == text and not re.search(r"</?s>|<</?SYS>>|<</?ROLE>>|\[/?INST\]", safe)
    before, after = chat.MARKS.get(role, (f"{chat.ROLE_OPEN}{role}{chat.ROLE_MIDDLE}", chat.ROLE_CLOSE))
    assert chat.parsed(before + safe + after) == (role, text)


def test_spark_escapes_alike(spark):
    import re

    rows = [(t or "",) for t in TEXTS]
    out = spark.createDataFrame(rows, "t string").select("t", chat.escaped(F.col("t")).alias("e")).collect()
    assert all(r.e == re.sub(chat._CONTROL, r"\1\\\2\3", r.t) and chat.unescaped(r.e) == r.t for r in out)


def test_empty_table(spark, vocab):
    packed = chat.pack(spark.createDataFrame([], SCHEMA), vocab, scratch_path(spark, "chat"))
    assert chat.read_back(packed, vocab).count() == 0


def test_query_adds_its_own_conversation(spark):
    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]
    assert Counter(tuple(r)[:5] for r in op12_chat_tree(spark, folder).collect()) == plain(rows)
