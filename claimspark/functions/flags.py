"""Boolean flags and predicates on code columns (X8, X9, F6 helper)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the add-on code that marks a robotic-assisted procedure.
ROBOTIC_CODE = "S2900"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def code_flag(code_col: Column | str, code: str) -> Column:
    """``CASE WHEN col = code THEN true ELSE false END`` - never null.

    A bare ``col == code`` would be null for a null code.
    """
    return F.when(_col(code_col) == F.lit(code), F.lit(True)).otherwise(F.lit(False))


def is_robotic(code_col: Column | str = "procedure_code") -> Column:
    return code_flag(code_col, ROBOTIC_CODE)


def has_value_upper(c: Column | str) -> Column:
    """X9 + F5: ``UPPER(c) IS NOT NULL`` (an empty string passes)."""
    return F.upper(_col(c)).isNotNull()


def has_token(c: Column | str, token: str, sep: str = "|") -> Column:
    """the delimited list in ``c`` holds ``token`` as a whole element.

    ``|HE|`` and ``|59|HE|`` hold ``HE``; ``|HEX|`` does not; null -> false.
    Split on the literal separator (escaped, ``split`` takes a regex).
    """
    pattern = "[" + sep + "]" if len(sep) == 1 else F.lit(sep)
    parts = F.split(_col(c), pattern)
    return F.coalesce(F.array_contains(parts, F.lit(token)), F.lit(False))
