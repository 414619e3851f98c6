"""Plan inspection helpers for tests and tuning, built on ``DataFrame.explain``."""

from __future__ import annotations

import contextlib
import io
import re

from pyspark.sql import DataFrame


def plan_text(df: DataFrame, mode: str = "formatted") -> str:
    """What ``df.explain(mode)`` prints, returned as a string."""
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode)
    return buf.getvalue()


def exchanges(df: DataFrame) -> list[str]:
    """Arguments of every hash-partitioning shuffle in the physical plan."""
    return re.findall(r"Arguments: (hashpartitioning\([^\n]*)", plan_text(df, "formatted"))


def optimized_logical_plan(df: DataFrame) -> str:
    text = plan_text(df, "extended")
    start = text.find("== Optimized Logical Plan ==")
    end = text.find("== Physical Plan ==")
    return text[start:end]


def estimated_bytes(df: DataFrame) -> int:
    """The planner's estimate of a frame's size, the one that its broadcast decision uses; runs no job."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
