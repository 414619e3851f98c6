"""Date expressions (X1-X7), all built-in and codegen-friendly.

Two parse rules exist on purpose:

* the staging model detects the format: ISO (``2024-1-31``, a time may follow),
  ``MM/DD/YYYY`` or ``DD-MON-YYYY`` in any case;
* the app parses only ``yyyy-MM-dd`` (``try_to_date(text, 'yyyy-MM-dd')``).

Both return null for text they cannot parse, never an error, which matters
because ANSI mode (the default) makes a plain ``to_date`` raise.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

# The formats used by the app (year-month-day in, year-month out).
APP_DATE_FORMAT = "yyyy-MM-dd"
MONTH_TEXT_FORMAT = "yyyy-MM"
# The shapes of the three detected formats.
ISO_SHAPE = r"^\d{4}-\d{1,2}-\d{1,2}([ T].*)?$"
SLASH_SHAPE = r"^\d{1,2}/\d{1,2}/\d{4}$"
MONTH_NAME_SHAPE = r"^\d{1,2}-[A-Za-z]{3}-\d{4}$"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_date_lenient(c: Column | str) -> Column:
    """The date of a text in one of the three detected formats; else null.

    The shape picks the format, so a bare year or a number is not a date.  A
    full ``yyyy-MM-dd`` text is known by its length and two characters; only
    other texts meet the patterns and the rebuilt month name.
    """
    text = F.trim(_col(c))
    plain = (F.length(text) == 10) & (F.substring(text, 5, 1) == "-") & (F.substring(text, 8, 1) == "-")
    dash = F.instr(text, "-")
    name = F.concat(F.upper(F.substr(text, dash + 1, F.lit(1))), F.lower(F.substr(text, dash + 2, F.lit(2))))
    english = F.concat(F.substring_index(text, "-", 1), F.lit("-"), name, F.lit("-"), F.substring_index(text, "-", -1))
    return (F.when(plain, F.try_to_date(text))
            .when(text.rlike(ISO_SHAPE), F.try_to_date(text))
            .when(text.rlike(SLASH_SHAPE), F.try_to_date(text, "M/d/yyyy"))
            .when(text.rlike(MONTH_NAME_SHAPE), F.try_to_date(english, "d-MMM-yyyy")))


def parse_date_strict(c: Column | str, fmt: str = APP_DATE_FORMAT) -> Column:
    """Parse with one fixed format; anything else -> null."""
    return F.try_to_date(_col(c), fmt)


def month_text(d: Column | str) -> Column:
    """``yyyy-MM`` text of a date (null stays null)."""
    return F.date_format(_col(d), MONTH_TEXT_FORMAT)


def month_start(d: Column | str) -> Column:
    """First day of the month, as a DATE (``date_trunc`` would give a timestamp)."""
    return F.trunc(_col(d), "month")


def year_of(d: Column | str) -> Column:
    """Calendar year as INT."""
    return F.year(_col(d))


def as_of_col(as_of: date | None) -> Column:
    """The reference date; ``None`` means today (``current_date()``)."""
    return F.current_date() if as_of is None else F.lit(as_of)


def age_years(birth: Column | str, as_of: date | None = None) -> Column:
    """Age as a difference of calendar years (not a birthday age)."""
    return (year_of(as_of_col(as_of)) - year_of(birth)).cast("int")
