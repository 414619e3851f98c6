"""dbt-style models as DataFrame functions: base -> staging -> marts.

The models chain on DataFrames directly; materialising them as views or tables
is a separate sink (``claimspark.sinks.materialize``).
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimspark.functions.dates import age_years, month_start, parse_date_lenient
from claimspark.functions.flags import is_robotic
from claimspark.plans.session import save

# The base model's 16-column contract (P2), in contract order.
BASE_COLUMNS = [
    "patient_id", "medical_event_id", "procedure_code", "service_date",
    "place_of_service", "rendering_npi", "first_name", "primary_specialty",
    "provider_state", "provider_zip", "payer_name", "parent_name", "plan_id",
    "patient_yob", "patient_gender", "diagnosis_code",
]

# The extract and the base contract name two columns differently.
EXTRACT_TO_BASE = {"kh_plan_id": "plan_id", "diagnosis_codes": "diagnosis_code"}


def base_procedure_events(extract: DataFrame) -> DataFrame:
    """Rename to the contract names and project the contract columns."""
    return extract.withColumnsRenamed(EXTRACT_TO_BASE).select(*BASE_COLUMNS)


def stg_procedure_events(base: DataFrame, as_of: date | None = None) -> DataFrame:
    """Every base column plus four derived ones.

    ``service_date_parsed`` (lenient parse), ``procedure_month`` (first day of
    month, DATE), ``patient_age`` (year difference to ``as_of``; today when
    ``None``) and ``is_robotic`` (never null).
    """
    parsed = parse_date_lenient("service_date")
    return base.withColumns({
        "service_date_parsed": parsed,
        "procedure_month": month_start(parsed),
        "patient_age": age_years(parse_date_lenient("patient_yob"), as_of),
        "is_robotic": is_robotic("procedure_code"),
    })


def _count_by(df: DataFrame, keys: list[str]) -> DataFrame:
    # count(*) with a partial (map-side) aggregate per task before the shuffle,
    # so a hot group costs one row per task in the exchange.
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("procedure_volume"))


# The group keys of the three marts (A1-A3).
TRENDS_KEYS = ["procedure_month", "procedure_code", "provider_state", "payer_name", "patient_gender"]
DIAGNOSIS_KEYS = ["procedure_code", "diagnosis_code"]
PLANS_KEYS = ["procedure_code", "plan_id", "payer_name", "parent_name"]


def mart_procedure_trends(stg: DataFrame) -> DataFrame:
    """A1: volume by month, code, state, payer and gender (null keys form groups)."""
    return _count_by(stg, TRENDS_KEYS)


def mart_diagnosis_pathways(stg: DataFrame) -> DataFrame:
    """A2 + F4: volume by code and diagnosis, null diagnosis dropped first."""
    return _count_by(stg.filter(F.col("diagnosis_code").isNotNull()), DIAGNOSIS_KEYS)


def mart_plans_breakdown(stg: DataFrame) -> DataFrame:
    """A3: volume by code, plan, payer and parent."""
    return _count_by(stg, PLANS_KEYS)


# Fixed value: the trends mart, grouped by ordinals.
MART_TRENDS_SQL = """
SELECT procedure_month, procedure_code, provider_state, payer_name, patient_gender,
       count(*) AS procedure_volume
FROM {stg}
GROUP BY 1, 2, 3, 4, 5
"""


def mart_procedure_trends_sql(spark: SparkSession, stg: DataFrame) -> DataFrame:
    """A4: the trends mart written as SQL with ordinal GROUP BY.

    The DataFrame is bound as a query parameter, so no global view is needed.
    """
    return spark.sql(MART_TRENDS_SQL, stg=stg)


def all_marts(stg: DataFrame) -> dict[str, DataFrame]:
    """The three marts of one run.  Callers building all three at once should
    persist ``stg`` first so the star join runs once."""
    return {
        "mart_procedure_trends": mart_procedure_trends(stg),
        "mart_diagnosis_pathways": mart_diagnosis_pathways(stg),
        "mart_plans_breakdown": mart_plans_breakdown(stg),
    }


def patient_weights(demographics: DataFrame, geography: DataFrame, keys: list[str]) -> DataFrame:
    """(patient_id, keys..., weight): how often the patient joins repeat an event of a patient."""
    people = demographics.groupBy("patient_id", *keys).agg(F.count(F.lit(1)).alias("people"))
    places = geography.groupBy("patient_id").agg(F.count(F.lit(1)).alias("places"))
    joined = people.join(places, "patient_id")
    return joined.select("patient_id", *keys, (F.col("people") * F.col("places")).alias("weight"))


def _weighted(events: DataFrame, weights: DataFrame, event_keys: list[str], keys: list[str]) -> DataFrame:
    counted = events.groupBy("patient_id", *event_keys).agg(F.count(F.lit(1)).alias("events"))
    met = counted.join(weights, "patient_id")
    return met.groupBy(*keys).agg(F.sum(F.col("events") * F.col("weight")).alias("procedure_volume"))


def eager_marts(tables) -> dict[str, DataFrame]:
    """A1-A3 straight from a ``ClaimsTables`` bundle, aggregated below the patient join.

    A mart only counts, and the patient join only repeats rows (demographics
    bring the gender, geography nothing).  So events meet the plan and provider
    dimensions, are counted by patient and event-side keys, and the counts meet
    one weight per patient (and gender): the product stands for the rows that
    the star join would have made.  The patient join exchanges one row per
    patient and group in place of every event, a hot patient's events are
    counted in their own tasks, and no repeated row exists.  Weights are written
    once, so adaptive execution can still split the join.
    """
    plans = tables.plans.select("kh_plan_id", "payer_name", "parent_name")
    providers = tables.providers.select(F.col("npi").alias("rendering_npi"), "provider_state")
    columns = ["patient_id", "procedure_code", "service_date", "diagnosis_codes", "kh_plan_id", "rendering_npi"]
    events = tables.medical_events.select(*columns).join(plans, "kh_plan_id").join(providers, "rendering_npi")
    events = events.withColumnsRenamed(EXTRACT_TO_BASE)
    by_gender = save(patient_weights(tables.demographics, tables.geography, ["patient_gender"]), "patient-weights")
    weights = by_gender.groupBy("patient_id").agg(F.sum("weight").alias("weight"))
    months = events.withColumn("procedure_month", month_start(parse_date_lenient("service_date")))
    return {
        "mart_procedure_trends": _weighted(months, by_gender, [k for k in TRENDS_KEYS if k != "patient_gender"], TRENDS_KEYS),
        "mart_diagnosis_pathways": _weighted(events.filter(F.col("diagnosis_code").isNotNull()), weights, DIAGNOSIS_KEYS, DIAGNOSIS_KEYS),
        "mart_plans_breakdown": _weighted(events, weights, PLANS_KEYS, PLANS_KEYS),
    }
