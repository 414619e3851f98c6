"""Provider filtering: period snapshots, new prescribers, enrichment, modifiers.

(S5, E1-E3, J7, F5, F6.)
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimspark.functions.flags import has_token, has_value_upper


def snapshot(df: DataFrame, date_col: str, start: date | str, end: date | str) -> DataFrame:
    """One period of a table, ``start <= date < end`` (pushed to the scan
    when ``date_col`` is a stored column)."""
    d = F.col(date_col)
    return df.filter((d >= F.lit(start).cast("date")) & (d < F.lit(end).cast("date")))


def unique_keys(table_1: DataFrame, table_2: DataFrame, key: str = "prescriber_npi") -> DataFrame:
    """``SELECT key FROM t1 EXCEPT SELECT key FROM t2``.

    Set semantics: duplicates removed, and a null key in ``t2`` removes a null
    in ``t1``.  Each side is de-duplicated first (a partial distinct per task
    runs before any shuffle), so a prescriber holding a large share of all
    rows costs one row per task in the exchange; only the distinct keys reach
    the null-safe anti-join.
    """
    return table_1.select(key).distinct().subtract(table_2.select(key).distinct())


def new_prescribers(later: DataFrame, earlier: DataFrame, key: str = "prescriber_npi") -> DataFrame:
    """Prescribers present in the later period and absent from the earlier one."""
    return unique_keys(later, earlier, key)


def enrich(uniques: DataFrame, providers: DataFrame,
           left_key: str = "prescriber_npi", right_key: str = "npi") -> DataFrame:
    """Inner join that keeps both keys and matches null to null.

    ``eqNullSafe`` is planned as an equi-join on (coalesced key, is-null flag),
    so it still hashes/sorts on the key; the left side is a distinct key set.
    """
    return uniques.join(providers, uniques[left_key].eqNullSafe(providers[right_key]), "inner")


def new_prescribers_enriched(later: DataFrame, earlier: DataFrame, providers: DataFrame,
                             key: str = "prescriber_npi", provider_key: str = "npi") -> DataFrame:
    """E1 followed by J7."""
    return enrich(new_prescribers(later, earlier, key), providers, key, provider_key)


def events_with_modifier(events: DataFrame, col: str = "modifiers") -> DataFrame:
    """rows whose modifier list is present (``UPPER(m) IS NOT NULL``)."""
    return events.filter(has_value_upper(col))


def events_with_modifier_token(events: DataFrame, token: str = "HE",
                               col: str = "modifiers") -> DataFrame:
    """rows whose ``|``-delimited modifier list holds ``token``."""
    return events.filter(has_token(col, token))
