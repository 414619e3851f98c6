"""Operator 13 against plain counting and sorting."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from claimspark.llm import resample as R
from tests.llm import brute


def plain(docs, target, percent=R.PERCENT, runs=1, buckets=R.BUCKETS, min_words=R.MIN_WORDS, seed=R.SEED):
    def features(text):
        w = brute.alnum_words(text)
        return [zlib.crc32(" ".join(w[i:i + k]).encode()) % buckets for k in range(1, runs + 1) for i in range(len(w) - k + 1)]
    of = [features(t) for _, t in docs]
    s, t = Counter(b for f in of for b in f), Counter(b for x in target for b in features(x))
    a, b = sum(s.values()) + buckets, sum(t.values()) + buckets
    gain = [math.floor(1000 * math.log((t[k] + 1) * a / ((s[k] + 1) * b))) for k in range(buckets)]
    rows = []
    for (i, text), f in zip(docs, of):
        weight = sum(gain[k] for k in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(brute.alnum_words(text)), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2 ** 32))), None])
    able = sorted((r for r in rows if r[1] >= min_words), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[3], r[2]))
    for k, r in enumerate(able[:len(able) * percent // 100]):
        r[5] = k + 1
    return Counter(map(tuple, rows))


def got(df):
    return Counter(tuple(r) for r in df.collect())


TARGET = ["Karan loran miran", None, "", "the quick brown ñu ñu fox", "x" * 3000]


@pytest.mark.parametrize("percent, runs, buckets, sorted_runs", [(10, 1, 10_000, 512), (50, 3, 500, 3), (100, 2, 7, 1), (0, 1, 50, 4)])
def test_weights_scores_and_ranks_equal_brute_force(spark, docs, pairs, percent, runs, buckets, sorted_runs):
    target = spark.createDataFrame([(t, 1) for t in TARGET], "text string, score int")
    out = R.resample(docs, target, percent=percent, runs=runs, buckets=buckets, sorted_runs=sorted_runs)
    assert out.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    assert got(out) == plain(pairs, TARGET, percent, runs, buckets)


def test_empty_tables(spark, docs, pairs, empty):
    none = spark.createDataFrame([], "text string")
    assert R.resample(empty, none).count() == 0
    assert got(R.resample(docs, none)) == plain(pairs, [])


@pytest.mark.parametrize("chunk", [1, 1 << 22])
def test_crc32_of_words(chunk, texts):
    data = np.frombuffer("\n".join(t or "" for t in texts).encode(), np.uint8)
    for runs in (1, 3):
        found, _, n = R.features(data, np.array([0, len(data)]), runs, 1 << 31)
        w = brute.alnum_words(data.tobytes().decode())
        assert n[0] == len(w)
        assert found.tolist() == [zlib.crc32(" ".join(w[i:i + k]).encode()) % (1 << 31) for k in range(1, runs + 1) for i in range(len(w) - k + 1)]


def test_equal_rows_are_spread_over_segments(spark):
    """Two thirds of all rows are one row: ranks stay 1, 2, 3, ... and no segment holds much over twice its share."""
    rows = [(7, 30, 30, 5, 100)] * 4000 + [(i, 30, 30, 5, i % 90) for i in range(2000)]
    df = spark.createDataFrame(rows, R.SCORED).repartition(16)
    out = R.ranked(df, 3000, 16)
    ranks = [r["rank"] for r in out.filter("rank is not null").select("rank").collect()]
    assert sorted(ranks) == list(range(1, 3001))
    merged = R.ranked(df, 6000, 16)
    from pyspark.sql import functions as F
    sizes = [r.n for r in merged.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert len(sizes) >= 14 and max(sizes) <= 2 * 6000 / 16 + 16
    best = [tuple(r) for r in merged.orderBy("rank").select("score", "doc_id").collect()]
    assert best == sorted(best, key=lambda r: (-r[0], r[1]))


def test_only_drawn_segments_are_exchanged(spark):
    df = spark.createDataFrame([(i, 30, 30, 5, i) for i in range(5000)], R.SCORED).repartition(8)
    out = R.ranked(df, 100, 8)
    plan = out._jdf.queryExecution().executedPlan().toString()
    within = int(re.search(r"PushedFilters: \[IsNotNull\(segment\), LessThan\(segment,(\d+)\)\]", plan)[1])
    assert within <= 2 and "direct_shuffle_partition_id" in plan
    assert out.count() == 5000 and {r.doc_id for r in out.filter("rank is not null").collect()} == set(range(4900, 5000))
