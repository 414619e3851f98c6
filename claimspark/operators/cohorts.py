"""Cohorts: a rule, time ranges and a claim-status switch select patients; each
requested subject table is then cut down to them (F7-F9, J8, A14).

The platform runs its cohort engine server-side; only the request payload is
visible.  This module is **our reading** of that payload:

* the rule (F9) is a caller-supplied ``Column`` over medical events;
* time ranges (F7) are inclusive ``[start, end]`` dates, OR-ed together, on
  the event date; no ranges means no time filter.  ``date_col`` may name a
  stored date column (such as that of the written staging table): its range
  then reaches the scan, which a date parsed from text cannot;
* rejected claims (F8) are dropped unless ``include_rejected_claims``;
* the cohort's entities are patients; patient-keyed tables are semi-joined on
  ``patient_id``, providers and plans on the keys found in the cohort's
  medical events (J8);
* entity counts (A14) are exact distinct counts (approximate on request).

Scale: the patient id set is computed once and written as a table in the
shared folder (``spark.checkpoint.dir``), so the filter over the event table
is not re-run for every output table and a lost executor does not force it.
A written table rather than ``checkpoint()``: a checkpoint keeps the hash
partitioning of the distinct, so the planner would not shuffle the id side
again, and adaptive skew handling only splits a hot patient's partition when
both sides of the semi-join are shuffle stages.  Ids too many to be broadcast
are also turned into a Bloom filter (``joins.key_filter``) that drops other
patients' rows right above each subject table's scan, before that shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimspark.functions.dates import parse_date_lenient
from claimspark.operators.joins import KeyFilter, key_filter, semi_join
from claimspark.plans.session import scratch_path

MEDICAL = "claims-medical-events"
PHARMACY = "claims-pharmacy-events"
DEMOGRAPHICS = "claims-patient-demographics"
ENROLLMENT = "claims-patient-enrollment"
GEOGRAPHY = "claims-patient-geography"
PLANS = "claims-plans"
PROVIDERS = "claims-providers"
CLOSED = "claims-patient-closed"
INSURANCE = "claims-patient-insurance"
MORTALITY = "claims-mortality"
RACE_ETHNICITY = "claims-patient-race-ethnicity"

# The eleven subject areas a cohort can output, and how each is
# restricted to the cohort ("patient" = by patient id; otherwise by the key
# found in the cohort's medical events: (event column, table column)).
SUBJECT_AREAS: dict[str, tuple[str, str] | str] = {
    MEDICAL: "patient",
    PHARMACY: "patient",
    DEMOGRAPHICS: "patient",
    ENROLLMENT: "patient",
    GEOGRAPHY: "patient",
    PLANS: ("kh_plan_id", "kh_plan_id"),
    PROVIDERS: ("rendering_npi", "npi"),
    CLOSED: "patient",
    INSURANCE: "patient",
    MORTALITY: "patient",
    RACE_ETHNICITY: "patient",
}
DEFAULT_OUTPUTS = (MEDICAL, PHARMACY, DEMOGRAPHICS, GEOGRAPHY, PLANS, PROVIDERS)

# entity name -> column of the medical events that identifies it
ENTITY_COLUMNS = {"patient": "patient_id", "provider": "rendering_npi", "plan": "kh_plan_id"}


@dataclass(frozen=True)
class Cohort:
    rule: Column
    time_ranges: Sequence[tuple[str, str]] = ()
    date_col: Column | str | None = None   # default: leniently parsed service_date
    include_rejected_claims: bool = False
    version: str = "release"                # which data release to read: an input choice
    entities: Sequence[str] = ("patient",)
    outputs: Sequence[str] = DEFAULT_OUTPUTS
    count_entities: bool = False
    entities_to_count: Sequence[str] = field(default_factory=tuple)

    def event_date(self) -> Column:
        if self.date_col is None:
            return parse_date_lenient("service_date")
        return F.col(self.date_col) if isinstance(self.date_col, str) else self.date_col


def time_filter(d: Column, ranges: Sequence[tuple[str, str]]) -> Column | None:
    """event date inside any of the inclusive ranges (None: no filter)."""
    if not ranges:
        return None
    parts = [d.between(F.lit(a).cast("date"), F.lit(b).cast("date")) for a, b in ranges]
    return reduce(or_, parts)


def cohort_events(events: DataFrame, cohort: Cohort) -> DataFrame:
    """F7 + F8 + F9: the medical events that qualify a patient."""
    cond = cohort.rule
    tf = time_filter(cohort.event_date(), cohort.time_ranges)
    if tf is not None:
        cond = cond & tf
    if not cohort.include_rejected_claims:
        # null status is treated as not rejected
        cond = cond & ~F.coalesce(F.col("is_rejected"), F.lit(False))
    return events.filter(cond)


def cohort_patients(events: DataFrame, cohort: Cohort) -> DataFrame:
    """The cohort: distinct patient ids (partial distinct per task first).

    An event without a patient makes no member: a null id matches no row.
    """
    if tuple(cohort.entities) != ("patient",):
        raise ValueError(f"only patient cohorts are supported, not {cohort.entities}")
    ids = cohort_events(events, cohort).select("patient_id").filter(F.col("patient_id").isNotNull())
    return ids.distinct()


def materialized_patients(events: DataFrame, cohort: Cohort, path: str | None = None) -> DataFrame:
    """The cohort ids, written once below the shared folder and read back."""
    spark = events.sparkSession
    target = path or scratch_path(spark, "cohort-ids")
    ids = cohort_patients(events, cohort)
    ids.write.mode("errorifexists").parquet(target)
    return spark.read.schema(ids.schema).parquet(target)


def restrict(area: str, table: DataFrame, ids: DataFrame, cohort_events_df: DataFrame | None,
             keep: KeyFilter = lambda df: df) -> DataFrame:
    """One subject table cut down to the cohort with a left semi-join.

    ``keep`` may drop rows of other patients before (``joins.key_filter``).
    """
    how = SUBJECT_AREAS.get(area)
    if how is None:
        raise ValueError(f"unknown output area {area!r}")
    if how == "patient":
        return semi_join(keep(table), ids, ["patient_id"])
    event_col, table_col = how
    keys = cohort_events_df.select(F.col(event_col).alias(table_col)).distinct()
    return semi_join(table, keys, [table_col])


def area_tables(tables) -> dict[str, DataFrame]:
    """Subject area -> frame, for the areas a ``ClaimsTables`` bundle has."""
    return {
        MEDICAL: tables.medical_events,
        PHARMACY: tables.pharmacy_events,
        DEMOGRAPHICS: tables.demographics,
        GEOGRAPHY: tables.geography,
        PLANS: tables.plans,
        PROVIDERS: tables.providers,
    }


def subjects_for(cohort: Cohort, releases: Mapping[str, Mapping[str, DataFrame]]) -> dict[str, DataFrame]:
    """F8's data version: the subject tables of the release the cohort asks
    for (``releases``: version -> area -> frame).  An unknown version raises."""
    if cohort.version not in releases:
        raise KeyError(f"no data release {cohort.version!r}; have {sorted(releases)}")
    return dict(releases[cohort.version])


def cohort_tables(subjects: Mapping[str, DataFrame], cohort: Cohort,
                  ids: DataFrame | None = None) -> dict[str, DataFrame]:
    """One cut-down frame per requested output area (lazy; K5 writes them)."""
    events = subjects[MEDICAL]
    if ids is None:
        ids = materialized_patients(events, cohort)
    keep = key_filter(ids, "patient_id")
    cohort_medical = restrict(MEDICAL, events, ids, None, keep)
    out: dict[str, DataFrame] = {}
    for area in cohort.outputs:
        if area not in SUBJECT_AREAS:
            raise ValueError(f"unknown output area {area!r}")
        if area not in subjects:
            raise KeyError(f"no table bound for output area {area!r}")
        out[area] = restrict(area, subjects[area], ids, cohort_medical, keep)
    return out


def entity_counts(cohort_medical: DataFrame, entities: Sequence[str],
                  approx: bool = False) -> DataFrame:
    """(entity, entity_count) for the requested entities, one pass.

    Exact distinct counts by default; ``approx`` uses HyperLogLog++.
    """
    unknown = [e for e in entities if e not in ENTITY_COLUMNS]
    if unknown or not entities:
        raise ValueError(f"entities must be a non-empty subset of {list(ENTITY_COLUMNS)}")
    fn = F.approx_count_distinct if approx else F.countDistinct
    wide = cohort_medical.agg(*[fn(ENTITY_COLUMNS[e]).alias(e) for e in entities])
    return wide.unpivot([], list(entities), "entity", "entity_count")


def cohort_entity_counts(events: DataFrame, cohort: Cohort, ids: DataFrame | None = None,
                         approx: bool = False) -> DataFrame:
    entities = list(cohort.entities_to_count) or list(cohort.entities)
    if ids is None:
        ids = materialized_patients(events, cohort)
    return entity_counts(semi_join(events, ids, ["patient_id"]), entities, approx)


# log2 of the registers of a sketch, and its relative standard error (0.8 %).
SKETCH_LOG2 = 14
SKETCH_ERROR = 1.04 / 2 ** (SKETCH_LOG2 / 2)


def entity_sketches(cohort_medical: DataFrame, by: Sequence[str], entities: Sequence[str]) -> DataFrame:
    """A14, mergeable: one HyperLogLog sketch of each entity for each group of ``by``.

    A sketch has a fixed size, so a written table of them answers later counts
    of any union of its groups without the events.
    """
    unknown = [e for e in entities if e not in ENTITY_COLUMNS]
    if unknown or not entities:
        raise ValueError(f"entities must be a non-empty subset of {list(ENTITY_COLUMNS)}")
    return cohort_medical.groupBy(*by).agg(
        *[F.hll_sketch_agg(ENTITY_COLUMNS[e], F.lit(SKETCH_LOG2)).alias(e) for e in entities])


def merged_entity_counts(sketches: DataFrame, entities: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by..., entity, entity_count): the sketches of each group of ``by`` merged and estimated."""
    merged = sketches.groupBy(*by).agg(*[F.hll_sketch_estimate(F.hll_union_agg(e)).alias(e) for e in entities])
    return merged.unpivot(list(by), list(entities), "entity", "entity_count")
