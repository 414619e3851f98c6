"""Bounded reads and top-k.

A limit is kept only where it is the feature (a preview, a top-k report).
Without an order a preview is a plain limit: it stops reading after n rows.  With
an order the rows repeat between runs, and the planner uses a per-task top-k
followed by one small merge (``TakeOrderedAndProject``), never a full sort.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The bounded-read sizes the workflows use (a 1,000-row pull,
# 100-row previews, heads of 25 and 5 rows).
PULL_ROWS = 1000
PREVIEW_ROWS = 100
HEAD_ROWS = 25
SHORT_HEAD_ROWS = 5


def preview(df: DataFrame, n: int = PREVIEW_ROWS,
            order_by: Sequence[str | Column] | None = None) -> DataFrame:
    """``n`` rows, any (the default, and the cheap form) or the first
    under ``order_by``, nulls first.

    Rows that tie in ``order_by`` may take each other's place; name enough
    columns where the choice has to repeat.
    """
    if n < 0:
        raise ValueError("n must be >= 0")
    if order_by is None:
        return df.limit(n)
    cols = [F.asc_nulls_first(k) if isinstance(k, str) else k for k in order_by]
    return df.orderBy(*cols).limit(n)


def top_k(df: DataFrame, k: int, order: Sequence[Column]) -> DataFrame:
    """O3: the first ``k`` rows of ``df`` under ``order``."""
    if k < 0:
        raise ValueError("k must be >= 0")
    return df.orderBy(*order).limit(k)
