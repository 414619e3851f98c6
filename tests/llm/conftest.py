from __future__ import annotations

import random

import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # names that the operators use themselves
    T.StructField("key", T.StringType()), T.StructField("score", T.StringType()), T.StructField("row", T.StringType()),
])


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


WORDS = [a + b for a in ("ka", "lo", "mi", "ne", "su", "ta", "Re", "éo") for b in ("ran", "vel", "dus", "mik", "pol", "tes", "ñu")]


def edge_texts():
    """Texts with exact and near copies, shared passages, and the odd cases."""
    rng = random.Random(5)
    base = [sentence(rng, rng.randint(40, 160)) for _ in range(30)]
    texts = list(base)
    texts += [base[0], base[0], base[0].upper(), "  " + base[1].replace(" ", "\t\n")]
    for i in range(2, 14):  # near copies: from a few changed words to many
        w = base[i].split()
        for _ in range(rng.randint(1, 4)):
            v = list(w)
            for _ in range(rng.randint(1, 8)):
                v[rng.randrange(len(v))] = rng.choice(WORDS) + "x"
            texts.append(" ".join(v))
    passage = sentence(rng, 60)
    texts += [f"{sentence(rng, 30)}\n{passage}\n{sentence(rng, 20)}" for _ in range(8)]
    twice = sentence(rng, 45)
    texts += [twice + " " + twice, "solo", "a b c d", "a b c d", "A B C D", "", "   \n\t ", None, None, "", "é", "\x0b\x0c",
              sentence(rng, 9000), "x" * 30000, "word " * 400, "\x1c\x1dodd\x85blank\xa0space　wide 'tis don't we'll"]
    return texts


@pytest.fixture(scope="session")
def texts():
    return edge_texts()


@pytest.fixture(scope="session")
def docs(spark, texts):
    """doc_id ascending with gaps; one repeated row and one null id at the end."""
    rows = [(3 * i, t, "en", "s", None, "k", "c", "r") for i, t in enumerate(texts)]
    rows += [rows[0], (None, "no id here " + texts[5], None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def pairs(docs):
    """(doc_id, text) in a fixed order."""
    return sorted(((r.doc_id, r.text) for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
