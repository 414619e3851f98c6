"""The registered queries of the training-data operators.

Each takes (session, folder of the tables), applies one operator with its
production parameters to the whole table and derives the digest columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimspark.llm import secrets as secret_scan
from claimspark.llm import toxicity as toxic
from claimspark.llm.bpe import digests, vocabulary
from claimspark.llm.centroids import cluster
from claimspark.llm.chat import pack, read_back
from claimspark.llm.common import table, tokenizer_file
from claimspark.llm.decontaminate import decontaminate
from claimspark.llm.jaccard import similar_groups
from claimspark.llm.html import extract
from claimspark.llm.quality import quality
from claimspark.llm.resample import resample
from claimspark.llm.sharding import write_shards, written_shards
from claimspark.llm.substring import dedup_substrings
from claimspark.llm.tokenfiles import read_tokens, write_tokens
from claimspark.plans.session import scratch_path


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("items", ","), 256)
    return out.select("doc_id", "n_words", "n_hit", "n_items", digest.alias("items_sha256"), "contaminated")


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), folder, tokenizer_file("byte_bpe_50k.json"))
    return read_tokens(spark, folder)


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_groups(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"))


def op5_extendible_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written_shards(write_shards(table(spark, sf_dir, "documents"), scratch_path(spark, "shards")))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), vocabulary(tokenizer_file("byte_bpe_50k.tiktoken")))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_substrings(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxic.toxicity(docs, toxic.train(docs, table(spark, sf_dir, "labels")))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = secret_scan.secrets(docs, secret_scan.train(docs))
    base = F.filter("spans", lambda s: s["kind"] != "format")

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    counts = [count(kind) for kind in ("assign", "access", "hex")]
    return out.select("doc_id", *counts, F.sha2(secret_scan.written(base), 256).alias("base_sha256"),
                      secret_scan.written(F.col("spans")).alias("spans"))


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(table(spark, sf_dir, "embeddings")).drop("centroid")


def op12_chat_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocab = vocabulary(tokenizer_file("byte_bpe_50k.tiktoken"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = [(-7, turn, role, "</s>[INST] ok [/INST]") for turn, role in enumerate(("user", "assistant"))]
    rows = rows.unionByName(spark.createDataFrame(own, "conv_id long, turn long, role string, text string"))
    return read_back(pack(rows, vocab, scratch_path(spark, "chat")), vocab)


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_token_files": op2_token_files,
    "op3_ngram_jaccard": op3_ngram_jaccard,
    "op4_quality_rules": op4_quality_rules,
    "op5_extendible_sharding": op5_extendible_sharding,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_html_text": op8_html_text,
    "op9_toxicity": op9_toxicity,
    "op10_secret_scan": op10_secret_scan,
    "op11_centroid_clustering": op11_centroid_clustering,
    "op12_chat_tree": op12_chat_tree,
    "op13_importance_resampling": op13_importance_resampling,
}
