"""Procedure-trends app operators.

The app's widget values become parameters.  Every function is a lazy
DataFrame transformation; only the small aggregates are ever meant to reach a
driver (for a chart), and that is the caller's choice.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimspark.functions.dates import age_years, month_text, parse_date_strict
from claimspark.functions.flags import ROBOTIC_CODE
from claimspark.functions.labels import TARGET_CODES, label_col
from claimspark.operators.joins import semi_join
from claimspark.operators.limits import top_k
from claimspark.plans.session import save

# The app's dimensions and default month floor.
GROUP_BY_OPTIONS = ("provider_state", "payer_name", "patient_gender")
DEFAULT_MONTH_FLOOR = "2020-01"
TOP_K = 20


def lower_case_columns(df: DataFrame) -> DataFrame:
    """P5: lower-case every column name; two names that collide raise."""
    lowered = [c.lower() for c in df.columns]
    if len(set(lowered)) != len(lowered):
        raise ValueError(f"lower-casing makes duplicate column names: {df.columns}")
    return df.toDF(*lowered)


def prepare(extract: DataFrame, tag: str = "CLAIMS", as_of: date | None = None) -> DataFrame:
    """P4 + P5 + P6: source tag, lower-case names, parsed date, month text, age."""
    df = lower_case_columns(extract.withColumn("TYPE", F.lit(tag)))
    parsed = parse_date_strict("service_date")
    return df.withColumns({
        "service_date_parsed": parsed,
        "procedure_month": month_text(parsed),
        "patient_age": age_years(parse_date_strict("patient_yob"), as_of),
    })


def with_procedure_label(df: DataFrame, col: str = "procedure_code") -> DataFrame:
    """Add the display label of the procedure code."""
    return df.withColumn("procedure_label", label_col(col))


def filter_codes(df: DataFrame, codes: list[str] = TARGET_CODES) -> DataFrame:
    """keep the target procedure codes."""
    return df.filter(F.col("procedure_code").isin(*codes))


def filter_code(df: DataFrame, code: str) -> DataFrame:
    """one procedure code."""
    return df.filter(F.col("procedure_code") == F.lit(code))


def filter_month_range(df: DataFrame, lo: str, hi: str, col: str = "procedure_month",
                       date_text: str | None = "service_date") -> DataFrame:
    """inclusive month range on ``yyyy-MM`` text; a null month drops out.

    The month comes from a strict ``yyyy-MM-dd`` text, whose order is the order
    of its characters.  If the frame has that text (``date_text``), a range on
    it is added: it holds for every row that passes, and it reaches the scan.
    """
    cond = F.col(col).between(F.lit(lo), F.lit(hi))
    if date_text in df.columns:
        cond = cond & F.col(date_text).between(F.lit(lo), F.lit(hi + "-99"))
    return df.filter(cond)


VISIT_KEYS = ["patient_id", "service_date"]


def robotic_visits(df: DataFrame, robotic_code: str = ROBOTIC_CODE) -> DataFrame:
    """Distinct (patient, raw date text) pairs that carry the robotic add-on code."""
    return df.filter(F.col("procedure_code") == F.lit(robotic_code)).select(*VISIT_KEYS).distinct()


def robotic_visits_of_events(events: DataFrame, providers: DataFrame, plans: DataFrame,
                             robotic_code: str = ROBOTIC_CODE) -> DataFrame:
    """The robotic visits that survive the star join, from raw medical events.

    Only the robotic events are read, and only providers and plans are joined:
    both rows of a pair carry the same patient, so whatever the patient join
    does to one it does to the other.
    """
    robotic = events.filter(F.col("procedure_code") == F.lit(robotic_code))
    listed = robotic.join(providers.select(F.col("npi").alias("rendering_npi")), "rendering_npi", "left_semi")
    return listed.join(plans.select("kh_plan_id"), "kh_plan_id", "left_semi").select(*VISIT_KEYS).distinct()


def robotic_events(events: DataFrame, providers: DataFrame, plans: DataFrame,
                   robotic_code: str = ROBOTIC_CODE) -> DataFrame:
    """J6 before the star join: the raw events of robotic visits.

    The visit keys are written once, so that both inputs of the semi-join are
    shuffles of their own and adaptive execution can split a hot visit.
    """
    visits = save(robotic_visits_of_events(events, providers, plans, robotic_code), "robotic-visits")
    return semi_join(events, visits, VISIT_KEYS)


def keep_robotic_visits(df: DataFrame, robotic_code: str = ROBOTIC_CODE,
                        of: DataFrame | None = None) -> DataFrame:
    """Keep rows whose (patient, date) pair also has the robotic code in
    ``of`` (default: in ``df``).

    An inner join against *distinct* keys equals a left semi-join, which never
    duplicates rows.
    """
    return semi_join(df, robotic_visits(df if of is None else of, robotic_code), VISIT_KEYS)


def select_procedures(
    df: DataFrame,
    code: str,
    month_lo: str,
    month_hi: str,
    robotic_only: bool = False,
) -> DataFrame:
    """F10 + F1 + F3: the app's filter panel applied to the target-code frame.

    Code and month are filtered first; only those rows meet the visit keys.
    """
    kept = filter_month_range(filter_code(df, code), month_lo, month_hi)
    return keep_robotic_visits(kept, of=df) if robotic_only else kept


def distinct_months(df: DataFrame) -> DataFrame:
    """The distinct month values (null kept as a value)."""
    return df.select("procedure_month").distinct()


def month_bounds(df: DataFrame, floor: str = DEFAULT_MONTH_FLOOR) -> DataFrame:
    """Default slider window in one aggregate pass.

    Start is the first month at or after ``floor``, else the earliest month;
    end is the latest.  Null months are ignored; an empty input gives nulls.
    """
    m = F.col("procedure_month")
    return df.agg(
        F.coalesce(F.min(F.when(m >= F.lit(floor), m)), F.min(m)).alias("min_month"),
        F.max(m).alias("max_month"),
    )


def monthly_counts(df: DataFrame, dim: str) -> DataFrame:
    """A5 + O1: events per month and one chosen dimension, by month."""
    if dim not in GROUP_BY_OPTIONS:
        raise ValueError(f"group-by must be one of {GROUP_BY_OPTIONS}, not {dim!r}")
    return (df.groupBy("procedure_month", dim)
              .agg(F.count("medical_event_id").alias("procedure_count"))
              .transform(_monthly_order, dim))


def _monthly_order(df: DataFrame, dim: str) -> DataFrame:
    return df.orderBy(F.asc_nulls_first("procedure_month"), F.asc_nulls_first(dim))


def territory_summary(df: DataFrame) -> DataFrame:
    """A6 + A7 + O2: volume and provider counts by state.

    ``hcp_count`` counts non-null provider ids per row (not distinct), exactly
    as the app does; ``hcp_distinct_count`` is the distinct count.  The ratio
    is a float division that gives null, not an error, when the count is 0.
    """
    agg = df.groupBy("provider_state").agg(
        F.count("medical_event_id").alias("procedure_volume"),
        F.count("rendering_npi").alias("hcp_count"),
        F.countDistinct("rendering_npi").alias("hcp_distinct_count"),
    )
    return _territory_ratio(agg)


def _territory_ratio(agg: DataFrame) -> DataFrame:
    return (agg.withColumn(
                "avg_procedure_per_hcp",
                F.try_divide(F.col("procedure_volume").cast("double"), F.col("hcp_count")))
            .select("provider_state", "procedure_volume", "hcp_count",
                    "avg_procedure_per_hcp", "hcp_distinct_count")
            .orderBy(F.desc("procedure_volume"), F.asc_nulls_first("provider_state")))


def _volume_by(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("medical_event_id").alias("procedure_volume"))


def top_diagnoses(df: DataFrame, k: int = TOP_K) -> DataFrame:
    """A8 + F4 + O3: the ``k`` diagnoses with most events; ties broken by code."""
    return _most_diagnoses(_volume_by(df, ["diagnosis_codes"]), k)


def _most_diagnoses(volumes: DataFrame, k: int) -> DataFrame:
    volumes = volumes.filter(F.col("diagnosis_codes").isNotNull())
    return top_k(volumes, k, [F.desc("procedure_volume"), F.asc("diagnosis_codes")])


def top_payers(df: DataFrame, k: int = TOP_K) -> DataFrame:
    """A9 + O3: the ``k`` (payer, parent) pairs with most events; ties by name."""
    return _most_payers(_volume_by(df, ["payer_name", "parent_name"]), k)


def _most_payers(volumes: DataFrame, k: int) -> DataFrame:
    return top_k(volumes, k, [F.desc("procedure_volume"),
                              F.asc_nulls_first("payer_name"), F.asc_nulls_first("parent_name")])


def payer_mix_by_state(df: DataFrame) -> DataFrame:
    """A10 + O2: events by state and payer, largest first, no limit."""
    return _mix_order(_volume_by(df, ["provider_state", "payer_name"]))


def _mix_order(volumes: DataFrame) -> DataFrame:
    return volumes.orderBy(F.desc("procedure_volume"),
                           F.asc_nulls_first("provider_state"), F.asc_nulls_first("payer_name"))


def page_aggregates(df: DataFrame, dim: str) -> DataFrame:
    """Every count that the page needs, by ``GROUPING SETS`` over one pass of the filtered events.

    ``set_id`` is the grouping id of a row's set.  The (state, provider) set
    stands for the territory summary: its distinct providers are its rows.
    """
    if dim not in GROUP_BY_OPTIONS:
        raise ValueError(f"group-by must be one of {GROUP_BY_OPTIONS}, not {dim!r}")
    return df.groupingSets([[F.col(c) for c in cols] for cols in _page_sets(dim).values()], *_page_columns(dim)).agg(
        F.grouping_id().cast("long").alias("set_id"), F.count("medical_event_id").alias("procedure_volume"),
        F.count("rendering_npi").alias("hcp_count"))


def _page_sets(dim: str) -> dict[str, list[str]]:
    return {
        "monthly": ["procedure_month", dim],
        "territory_summary": ["provider_state", "rendering_npi"],
        "top_diagnoses": ["diagnosis_codes"],
        "top_payers": ["payer_name", "parent_name"],
        "payer_mix_by_state": ["provider_state", "payer_name"],
    }


def _page_columns(dim: str) -> list[str]:
    return list(dict.fromkeys(c for cols in _page_sets(dim).values() for c in cols))


def page_frames(aggregates: DataFrame, dim: str, k: int = TOP_K) -> dict[str, DataFrame]:
    """The page's five frames from its aggregates: the same rows and orders as the single operators give."""
    columns = _page_columns(dim)

    def rows(name: str) -> DataFrame:
        inside = _page_sets(dim)[name]
        set_id = sum(1 << (len(columns) - 1 - i) for i, c in enumerate(columns) if c not in inside)
        return aggregates.filter(F.col("set_id") == set_id).select(*inside, "procedure_volume", "hcp_count")
    territory = rows("territory_summary").groupBy("provider_state").agg(
        F.sum("procedure_volume").alias("procedure_volume"), F.sum("hcp_count").alias("hcp_count"),
        F.count("rendering_npi").alias("hcp_distinct_count"))
    return {
        "monthly": _monthly_order(rows("monthly").select("procedure_month", dim, F.col("procedure_volume").alias("procedure_count")), dim),
        "territory_summary": _territory_ratio(territory),
        "top_diagnoses": _most_diagnoses(rows("top_diagnoses").drop("hcp_count"), k),
        "top_payers": _most_payers(rows("top_payers").drop("hcp_count"), k),
        "payer_mix_by_state": _mix_order(rows("payer_mix_by_state").drop("hcp_count")),
    }
