"""Procedure code <-> display label."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# The four target procedure codes and their display labels,
# in the order the app lists them.
CODE_LABELS: dict[str, str] = {
    "22612": "22612 – Lumbar spine fusion (posterior)",
    "22630": "22630 – Interbody technique (laminectomy/discectomy)",
    "22633": "22633 – Combined lumbar fusion",
    "S2900": "S2900 – Robotic surgical system (add-on)",
}
TARGET_CODES: list[str] = list(CODE_LABELS)


def label_col(code_col: Column | str = "procedure_code",
              labels: dict[str, str] = CODE_LABELS) -> Column:
    """Code -> label as a literal map lookup (no join, no Python per row)."""
    c = F.col(code_col) if isinstance(code_col, str) else code_col
    lookup = F.create_map(*[F.lit(x) for x in chain.from_iterable(labels.items())])
    # try_element_at: a code outside the map (or a null code) gives null,
    # also under ANSI mode
    return F.try_element_at(lookup, c)


def code_for_label(label: str, labels: dict[str, str] = CODE_LABELS) -> str:
    """Label -> code (a parameter lookup done once on the driver)."""
    for code, text in labels.items():
        if text == label:
            return code
    raise KeyError(f"unknown procedure label {label!r}")
