"""The procedure-adoption extract: a five-table star join.

All joins are inner equi-joins, so null keys never match (SQL semantics).

Join strategy (the plan we want at scale):

* ``plans`` and ``providers`` are dimension tables.  No broadcast hint is
  forced: the planner broadcasts a side only when its estimated size, and with
  adaptive execution its *measured* shuffle size, is under the configured
  threshold; otherwise it falls back to a shuffle join.  So what is broadcast
  is always size-checked.
* ``demographics`` and ``geography`` are both keyed by patient.  They are
  joined to each other first (``patients``: at most a few rows per patient)
  so the event table is shuffled on ``patient_id`` once, not twice, and read
  once.
* Hot patients and providers.  Adaptive execution splits a hot key's partition
  when both inputs of a join are shuffles of their own.  The provider join is
  such a join.  The patient dimension is the output of a join on the same key,
  which would share its stage with the event join, so it is written once below
  the shared folder and read back: then the patient join is one too.
* The geography join projects no column but must stay an inner join: it drops
  patients without geography and repeats events of patients with several
  geography rows.  A semi-join would lose the repeats.

Inner joins are associative, so this order gives the same rows as the
left-deep order of the original SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from claimspark.plans.session import save

EVENT_COLUMNS = [
    "patient_id", "medical_event_id", "procedure_code", "service_date",
    "place_of_service", "rendering_npi", "diagnosis_codes", "kh_plan_id",
]
PROVIDER_COLUMNS = ["first_name", "primary_specialty", "provider_state", "provider_zip"]
PLAN_COLUMNS = ["payer_name", "parent_name"]
PATIENT_COLUMNS = ["patient_yob", "patient_gender"]

# The 16 extract columns (P1), in extract order.
EXTRACT_COLUMNS = [
    "patient_id", "medical_event_id", "procedure_code", "service_date",
    "place_of_service", "rendering_npi", "diagnosis_codes", "first_name",
    "primary_specialty", "provider_state", "provider_zip", "payer_name",
    "kh_plan_id", "parent_name", "patient_yob", "patient_gender",
]


def join_providers(events: DataFrame, providers: DataFrame) -> DataFrame:
    """Events ⋈ providers on ``rendering_npi = npi`` (both keys kept)."""
    pr = providers.select("npi", *PROVIDER_COLUMNS)
    return events.join(pr, events["rendering_npi"] == pr["npi"], "inner")


def join_demographics(events: DataFrame, demographics: DataFrame) -> DataFrame:
    """Events ⋈ demographics on ``patient_id``."""
    return events.join(demographics.select("patient_id", *PATIENT_COLUMNS), "patient_id", "inner")


def join_geography(events: DataFrame, geography: DataFrame) -> DataFrame:
    """Inner join on the geography keys only (drops and repeats rows)."""
    return events.join(geography.select("patient_id"), "patient_id", "inner")


def join_plans(events: DataFrame, plans: DataFrame) -> DataFrame:
    """Events ⋈ plans on ``kh_plan_id``."""
    return events.join(plans.select("kh_plan_id", *PLAN_COLUMNS), "kh_plan_id", "inner")


def patient_dimension(demographics: DataFrame, geography: DataFrame) -> DataFrame:
    """Demographics with the geography fan-out applied (one row per geography row)."""
    return join_geography(demographics.select("patient_id", *PATIENT_COLUMNS), geography)


def procedure_adoption(
    events: DataFrame,
    providers: DataFrame,
    demographics: DataFrame,
    geography: DataFrame,
    plans: DataFrame,
) -> DataFrame:
    """J5 + P1: the star join, projected to the 16 extract columns.

    Writes the patient dimension when called; the join itself is lazy.
    """
    x = join_plans(events.select(*EVENT_COLUMNS), plans)
    pr = providers.select("npi", *PROVIDER_COLUMNS)
    x = x.join(pr, x["rendering_npi"] == pr["npi"], "inner").drop("npi")
    patients = save(patient_dimension(demographics, geography), "patients")
    return x.join(patients, "patient_id", "inner").select(*EXTRACT_COLUMNS)


def procedure_adoption_from(tables, events: DataFrame | None = None) -> DataFrame:
    """The star join over a ``ClaimsTables`` bundle (``events``: some of its events)."""
    return procedure_adoption(
        tables.medical_events if events is None else events, tables.providers, tables.demographics,
        tables.geography, tables.plans,
    )
