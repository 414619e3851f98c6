"""Dataset-name helpers.

These run once on the driver over parameters (names, a timestamp); the column
form of X10 is provided for labelling rows inside a job.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the dataset suffix format used when publishing.
DATASET_SUFFIX_FORMAT = "%Y%m%d_%H%M%S"


def table_type(name: str) -> str:
    """The last two ``_``-separated parts of a table name."""
    return "_".join(name.split("_")[-2:])


def table_type_col(name: Column | str) -> Column:
    """X10 as a column expression (JVM side)."""
    c = F.col(name) if isinstance(name, str) else name
    return F.array_join(F.slice(F.split(c, "_"), -2, 2), "_")


def dataset_suffix(at: datetime) -> str:
    """X11: ``YYYYmmdd_HHMMSS`` for a dataset name."""
    return at.strftime(DATASET_SUFFIX_FORMAT)
