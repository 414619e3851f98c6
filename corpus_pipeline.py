"""Corpus pipeline: documents in, clean token ids out.

Each stage is (name, function); a function takes (session, docs, folder of the
tables) and returns the documents that it keeps, with the columns of the table
``documents``, except for the last, which returns token ids.  ``run`` writes
what each stage returns as Parquet below the shared folder and reads it again
as the next stage's docs.

Null columns pass through; a null or empty text stays in the corpus (it is not
toxic, is linked with nothing, holds no benchmark text and no secret) and has no
ids.  Rows that are equal in doc_id and text are copies, of which one stays.
An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimspark.llm import bpe, decontaminate, jaccard, secrets, toxicity
from claimspark.llm.common import table, tokenizer_file
from claimspark.plans.session import save


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go."""
    return toxicity.keep_clean(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones stays."""
    return jaccard.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go."""
    return decontaminate.keep_uncontaminated(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the texts."""
    return secrets.redact(docs, secrets.train(docs))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids, and whether the ids decode to the text."""
    vocab = bpe.vocabulary(tokenizer_file("byte_bpe_50k.tiktoken"))
    out = bpe.round_trip(docs, vocab, carry=("doc_id", "lang", "source"))
    return out.select("row.doc_id", "row.lang", "row.source", F.size("ids").cast("long").alias("n_tokens"), "ids",
                      F.col("same").alias("round_trip"))


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("byte_bpe", tokenize),
]

ORACLE_SQL = None  # SQL expresses neither the classifier nor the automata nor the merges


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = save(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
