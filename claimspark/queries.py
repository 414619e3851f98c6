"""The registered queries: one per operator of the inventory.

Each takes ``(spark, sf_dir)``, builds the claims tables over the whole test
tables in ``sf_dir`` and returns a lazy DataFrame.  Parameters are fixed so
that the DuckDB oracles in ``claimspark.oracle`` compute the same thing.

Sink queries write to a fresh path below the shared folder
(``spark.checkpoint.dir``), read the result back and return it.  Run a query
inside ``plans.session.scratch_scope`` to have what it wrote removed afterwards.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimspark import sinks
from claimspark.functions.dates import parse_date_lenient
from claimspark.operators import cohorts as C
from claimspark.operators import models as M
from claimspark.operators import procedures as P
from claimspark.operators import providers as V
from claimspark.operators.extract import (
    EVENT_COLUMNS, join_demographics, join_geography, join_plans, join_providers,
    procedure_adoption_from,
)
from claimspark.operators.joins import key_filter
from claimspark.operators.limits import preview
from claimspark.plans.session import scratch_path, unique_suffix
from claimspark.plans.workflows import run_cohort
from claimspark.sources.catalog import (
    TEST_TABLES, footer_row_counts, load_outputs, load_run, row_counts, scan, sf_catalog,
)
from claimspark.sources.files import read_extract_csv
from claimspark.sources.fixtures import ClaimsTables, claims_tables

AS_OF = date(2025, 1, 1)
SOURCE_TAG = "CLAIMS"
SELECTED_CODE = "22612"
MONTH_LO, MONTH_HI = "1996-01", "1999-12"
MONTH_FLOOR = "1998-06"
EARLIER = (date(1997, 1, 1), date(1998, 1, 1))
LATER = (date(1998, 1, 1), date(1999, 1, 1))
COHORT_CODE = "22612"
COHORT_RANGES = [("1998-01-01", "1998-01-31")]
LAYOUT_BUCKETS = 4
MEDICAL_EVENT_COLUMNS = EVENT_COLUMNS + ["modifiers", "is_rejected"]

Query = Callable[[SparkSession, str], DataFrame]


def _tables(spark: SparkSession, sf_dir: str) -> ClaimsTables:
    return claims_tables(spark, sf_dir)


def _extract(spark, sf_dir) -> DataFrame:
    return procedure_adoption_from(_tables(spark, sf_dir))


def _stg(spark, sf_dir) -> DataFrame:
    return M.stg_procedure_events(M.base_procedure_events(_extract(spark, sf_dir)), AS_OF)


def _app(spark, sf_dir) -> DataFrame:
    return P.prepare(_extract(spark, sf_dir), SOURCE_TAG, AS_OF)


def _targets(spark, sf_dir) -> DataFrame:
    return P.filter_codes(_app(spark, sf_dir))


def _filtered(spark, sf_dir) -> DataFrame:
    return P.select_procedures(_targets(spark, sf_dir), SELECTED_CODE, MONTH_LO, MONTH_HI)


def _events(spark, sf_dir) -> DataFrame:
    return _tables(spark, sf_dir).medical_events.select(*MEDICAL_EVENT_COLUMNS)


def _rx_periods(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    rx = _tables(spark, sf_dir).pharmacy_events
    return V.snapshot(rx, "fill_date", *LATER), V.snapshot(rx, "fill_date", *EARLIER)


def _cohort() -> C.Cohort:
    return C.Cohort(
        rule=F.col("procedure_code") == F.lit(COHORT_CODE),
        time_ranges=COHORT_RANGES,
        date_col=parse_date_lenient("service_date"),
        include_rejected_claims=False,
        entities_to_count=("patient", "provider", "plan"),
    )


def _cohort_subjects(spark, sf_dir) -> dict[str, DataFrame]:
    subjects = C.area_tables(_tables(spark, sf_dir))
    subjects[C.MEDICAL] = subjects[C.MEDICAL].select(*MEDICAL_EVENT_COLUMNS)
    return subjects


# ---------------------------------------------------------------- sources ---

def q_scan_table(spark, sf_dir):
    return scan(spark, sf_catalog(sf_dir), "customer")


def q_preview_limit(spark, sf_dir):
    # every column is named, since rows repeat and the choice has to agree with the oracle's
    return preview(_events(spark, sf_dir), 100, MEDICAL_EVENT_COLUMNS)


def q_output_row_counts(spark, sf_dir):
    # run the cohort, expose each written output under its platform-style
    # name, then load them by name (S2) and count
    cohort_id = f"CHT_{unique_suffix().upper()}"
    written = run_cohort(spark, _cohort_subjects(spark, sf_dir), _cohort(), cohort_id,
                         scratch_path(spark, "cohort"))
    names = []
    for area, df in written.items():
        name = sinks.cohort_table_name(cohort_id, area)
        df.createOrReplaceTempView(name)
        names.append(name)
    return row_counts(load_outputs(spark, names))


def q_table_footer_counts(spark, sf_dir):
    paths = {t: f"{sf_dir.rstrip('/')}/{t}.parquet" for t in TEST_TABLES}
    return footer_row_counts(spark, paths).select("table_type", "row_count")


# ------------------------------------------------------------------ sinks ---

def q_csv_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "extract-csv")
    sinks.write_extract_csv(_extract(spark, sf_dir), path)
    return read_extract_csv(spark, path)  # explicit schema: no inference pass


def q_publish_readback(spark, sf_dir):
    final = V.events_with_modifier(_events(spark, sf_dir))
    name = sinks.publish(final, f"claims_final_dataset_{unique_suffix()}_", datetime.now(),
                         path=scratch_path(spark, "publish"))
    return spark.table(name)


def q_register_output_readback(spark, sf_dir):
    later, earlier = _rx_periods(spark, sf_dir)
    name = sinks.register_output(V.unique_keys(later, earlier, "prescriber_npi"),
                                 f"unique_hcps_from_analytic_{unique_suffix()}",
                                 path=scratch_path(spark, "register"))
    return spark.table(name)


def q_export_readback(spark, sf_dir):
    tables = C.cohort_tables(_cohort_subjects(spark, sf_dir), _cohort())
    root = scratch_path(spark, "export")
    paths = sinks.export({"cohort_medical_events": tables[C.MEDICAL]}, root)
    return spark.read.schema(tables[C.MEDICAL].schema).parquet(paths["cohort_medical_events"])


def q_materialize_readback(spark, sf_dir):
    suffix = unique_suffix()
    base = sinks.materialize(M.base_procedure_events(_extract(spark, sf_dir)),
                             f"base_procedure_events_{suffix}", "view")
    stg = sinks.materialize(M.stg_procedure_events(base, AS_OF),
                            f"stg_procedure_events_{suffix}", "view")
    return sinks.materialize(M.mart_plans_breakdown(stg), f"mart_plans_breakdown_{suffix}",
                             "table", path=scratch_path(spark, "mart"))


# ------------------------------------------------------------------ joins ---

def q_join_providers(spark, sf_dir):
    t = _tables(spark, sf_dir)
    return join_providers(t.medical_events.select(*EVENT_COLUMNS), t.providers)


def q_join_demographics(spark, sf_dir):
    t = _tables(spark, sf_dir)
    return join_demographics(t.medical_events.select(*EVENT_COLUMNS), t.demographics)


def q_join_geography_fanout(spark, sf_dir):
    t = _tables(spark, sf_dir)
    return join_geography(t.medical_events.select(*EVENT_COLUMNS), t.geography)


def q_join_plans(spark, sf_dir):
    t = _tables(spark, sf_dir)
    return join_plans(t.medical_events.select(*EVENT_COLUMNS), t.plans)


def q_procedure_adoption(spark, sf_dir):
    return _extract(spark, sf_dir)


# ----------------------------------------------------------------- models ---

def q_base_procedure_events(spark, sf_dir):
    return M.base_procedure_events(_extract(spark, sf_dir))


def q_stg_procedure_events(spark, sf_dir):
    return _stg(spark, sf_dir)


def q_mart_procedure_trends(spark, sf_dir):
    return M.mart_procedure_trends(_stg(spark, sf_dir))


def q_mart_trends_sql(spark, sf_dir):
    return M.mart_procedure_trends_sql(spark, _stg(spark, sf_dir))


def q_mart_diagnosis_pathways(spark, sf_dir):
    return M.mart_diagnosis_pathways(_stg(spark, sf_dir))


def q_mart_plans_breakdown(spark, sf_dir):
    return M.mart_plans_breakdown(_stg(spark, sf_dir))


def q_mart_procedure_trends_eager(spark, sf_dir):
    return M.eager_marts(_tables(spark, sf_dir))["mart_procedure_trends"]


def q_mart_diagnosis_pathways_eager(spark, sf_dir):
    return M.eager_marts(_tables(spark, sf_dir))["mart_diagnosis_pathways"]


def q_mart_plans_breakdown_eager(spark, sf_dir):
    return M.eager_marts(_tables(spark, sf_dir))["mart_plans_breakdown"]


def q_staged_layout(spark, sf_dir):
    # the staging table in months and patient buckets; its robotic visits' rows by a semi-join of two bucketed tables
    suffix = unique_suffix()
    stg = sinks.write_layout(_stg(spark, sf_dir), f"stg_layout_{suffix}", "patient_id", LAYOUT_BUCKETS,
                             "procedure_month", scratch_path(spark, "layout"))
    robotic = stg.filter("is_robotic").select("patient_id").distinct()
    robotic = sinks.write_layout(robotic, f"robotic_patients_{suffix}", "patient_id", LAYOUT_BUCKETS,
                                 path=scratch_path(spark, "layout"))
    kept = stg.join(robotic, "patient_id", "left_semi")
    return kept.groupBy("procedure_month").agg(F.count(F.lit(1)).alias("event_count"))


def q_age_distribution_check(spark, sf_dir):
    return _stg(spark, sf_dir).groupBy("patient_age").agg(F.count(F.lit(1)).alias("event_count"))


def q_robotic_flag_nulls(spark, sf_dir):
    return (_stg(spark, sf_dir).groupBy("procedure_code", "is_robotic")
            .agg(F.count(F.lit(1)).alias("event_count")))


# -------------------------------------------------------------------- app ---

def q_app_prepare(spark, sf_dir):
    return _app(spark, sf_dir)


def q_procedure_labels(spark, sf_dir):
    return (P.with_procedure_label(_targets(spark, sf_dir))
            .select("medical_event_id", "patient_id", "procedure_code", "procedure_label"))


def q_filter_target_codes(spark, sf_dir):
    return _targets(spark, sf_dir)


def q_filter_code_month(spark, sf_dir):
    return _filtered(spark, sf_dir)


def q_robotic_procedures(spark, sf_dir):
    t = _tables(spark, sf_dir)
    events = P.robotic_events(t.medical_events, t.providers, t.plans)
    targets = P.filter_codes(P.prepare(procedure_adoption_from(t, events), SOURCE_TAG, AS_OF))
    return P.select_procedures(targets, SELECTED_CODE, MONTH_LO, MONTH_HI)


def q_distinct_months(spark, sf_dir):
    return P.distinct_months(_targets(spark, sf_dir))


def q_month_bounds(spark, sf_dir):
    return P.month_bounds(_targets(spark, sf_dir), MONTH_FLOOR)


def q_monthly_by_state(spark, sf_dir):
    return P.monthly_counts(_filtered(spark, sf_dir), "provider_state")


def q_monthly_by_payer(spark, sf_dir):
    return P.monthly_counts(_filtered(spark, sf_dir), "payer_name")


def q_monthly_by_gender(spark, sf_dir):
    return P.monthly_counts(_filtered(spark, sf_dir), "patient_gender")


def q_territory_summary(spark, sf_dir):
    return P.territory_summary(_filtered(spark, sf_dir))


def q_top_diagnoses(spark, sf_dir):
    return P.top_diagnoses(_filtered(spark, sf_dir), 20)


def q_top_payers(spark, sf_dir):
    return P.top_payers(_filtered(spark, sf_dir), 20)


def q_payer_mix_by_state(spark, sf_dir):
    return P.payer_mix_by_state(_filtered(spark, sf_dir))


def q_procedure_page(spark, sf_dir):
    # the page's five frames from one pass, as one table
    frames = P.page_frames(P.page_aggregates(_filtered(spark, sf_dir), "provider_state"), "provider_state")
    parts = []
    for name, df in frames.items():
        keys = {"territory_summary": ["provider_state"], "top_diagnoses": ["diagnosis_codes"]}.get(name, df.columns[:2])
        second = F.col(keys[1]) if len(keys) > 1 else F.lit(None)
        volume = "procedure_count" if name == "monthly" else "procedure_volume"
        distinct = F.col("hcp_distinct_count") if name == "territory_summary" else F.lit(None)
        parts.append(df.select(F.lit(name).alias("frame"), F.col(keys[0]).cast("string").alias("key_1"), second.cast("string").alias("key_2"),
                               F.col(volume).alias("volume"), distinct.cast("long").alias("hcp_distinct_count")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# -------------------------------------------------------------- providers ---

def q_new_prescribers(spark, sf_dir):
    later, earlier = _rx_periods(spark, sf_dir)
    return V.new_prescribers(later, earlier)


def q_unique_hcps_reverse(spark, sf_dir):
    later, earlier = _rx_periods(spark, sf_dir)
    return V.unique_keys(earlier, later, "prescriber_npi")


def q_new_prescribers_enriched(spark, sf_dir):
    later, earlier = _rx_periods(spark, sf_dir)
    return V.new_prescribers_enriched(later, earlier, _tables(spark, sf_dir).prescribers)


def q_events_with_modifier(spark, sf_dir):
    return V.events_with_modifier(_events(spark, sf_dir))


def q_events_with_modifier_token(spark, sf_dir):
    return V.events_with_modifier_token(_events(spark, sf_dir), "HE")


def q_modifier_refresh_stream(spark, sf_dir):
    # the order-line files arrive as a stream; each micro-batch is joined to
    # the (static) orders, shaped into medical events and filtered (F5);
    # the appended dataset is read back whole.  (That per-batch join is the
    # test binding's; real event files arrive as medical events already and
    # the refresh is a plain filter-and-append, ``prepare=None``.)
    from claimspark.sources.catalog import read_parquet
    from claimspark.sources.fixtures import events_from_lines, read_table
    from claimspark.streaming.refresh import (
        FILES_PER_BATCH, event_stream, refresh_modifier_dataset, run_to_completion,
    )

    lines = event_stream(spark, sf_dir, read_parquet(spark, f"{sf_dir}/lineitem.parquet").schema,
                         file_glob="lineitem.parquet", max_files_per_trigger=FILES_PER_BATCH)
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")

    def prepare(stream):
        joined = stream.join(orders, stream["l_orderkey"] == orders["o_orderkey"], "inner")
        return events_from_lines(joined).select(*MEDICAL_EVENT_COLUMNS)

    root = scratch_path(spark, "refresh")
    run_to_completion(refresh_modifier_dataset(lines, f"{root}/data", f"{root}/_checkpoint", prepare))
    schema = _events(spark, sf_dir).schema
    return spark.read.schema(schema).parquet(f"{root}/data")


# ---------------------------------------------------------------- cohorts ---

def q_cohort_patients(spark, sf_dir):
    return C.cohort_patients(_tables(spark, sf_dir).medical_events, _cohort())


def q_cohort_output_tables(spark, sf_dir):
    cohort_id = f"CHT_{unique_suffix().upper()}"
    written = run_cohort(spark, _cohort_subjects(spark, sf_dir), _cohort(), cohort_id,
                         scratch_path(spark, "cohort"))
    parts = [df.agg(F.count(F.lit(1)).alias("row_count"))
             .select(F.lit(area).alias("output_type"), "row_count")
             for area, df in written.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def q_cohort_run_reload(spark, sf_dir):
    # the run as another job finds it: by its manifest, rows checked
    root, cohort_id = scratch_path(spark, "cohort"), f"CHT_{unique_suffix().upper()}"
    run_cohort(spark, _cohort_subjects(spark, sf_dir), _cohort(), cohort_id, root)
    counts = row_counts(load_run(spark, root, cohort_id))
    return counts.select(F.col("table_type").alias("output_type"), "row_count")


def q_cohort_prefiltered_events(spark, sf_dir):
    # the runtime filter, also where the ids would be broadcast
    t = _tables(spark, sf_dir)
    ids = C.materialized_patients(t.medical_events, _cohort())
    keep = key_filter(ids, "patient_id", from_bytes=0)
    return C.restrict(C.PHARMACY, t.pharmacy_events, ids, None, keep).select("patient_id", "pharmacy_event_id", "fill_date")


def q_entity_sketch_counts(spark, sf_dir):
    # one sketch per code, merged over all codes, held against the exact count
    entities = ("patient", "provider", "plan")
    events = _events(spark, sf_dir)
    estimated = C.merged_entity_counts(C.entity_sketches(events, ["procedure_code"], entities), entities)
    exact = C.entity_counts(events, entities).withColumnRenamed("entity_count", "exact_count")
    near = F.abs(F.col("entity_count") - F.col("exact_count")) <= F.greatest(F.lit(1.0), F.col("exact_count") * 4 * C.SKETCH_ERROR)
    return exact.join(estimated, "entity").select("entity", "exact_count", near.alias("within_four_errors"))


def q_cohort_entity_counts(spark, sf_dir):
    events = _tables(spark, sf_dir).medical_events
    return C.cohort_entity_counts(events, _cohort())


QUERIES: dict[str, Query] = {
    "scan_table": q_scan_table,
    "preview_limit": q_preview_limit,
    "output_row_counts": q_output_row_counts,
    "csv_roundtrip": q_csv_roundtrip,
    "publish_readback": q_publish_readback,
    "register_output_readback": q_register_output_readback,
    "export_readback": q_export_readback,
    "materialize_readback": q_materialize_readback,
    "join_providers": q_join_providers,
    "join_demographics": q_join_demographics,
    "join_geography_fanout": q_join_geography_fanout,
    "join_plans": q_join_plans,
    "procedure_adoption": q_procedure_adoption,
    "base_procedure_events": q_base_procedure_events,
    "stg_procedure_events": q_stg_procedure_events,
    "mart_procedure_trends": q_mart_procedure_trends,
    "mart_trends_sql": q_mart_trends_sql,
    "mart_diagnosis_pathways": q_mart_diagnosis_pathways,
    "mart_plans_breakdown": q_mart_plans_breakdown,
    "app_prepare": q_app_prepare,
    "procedure_labels": q_procedure_labels,
    "filter_target_codes": q_filter_target_codes,
    "filter_code_month": q_filter_code_month,
    "robotic_procedures": q_robotic_procedures,
    "distinct_months": q_distinct_months,
    "month_bounds": q_month_bounds,
    "monthly_by_state": q_monthly_by_state,
    "monthly_by_payer": q_monthly_by_payer,
    "monthly_by_gender": q_monthly_by_gender,
    "territory_summary": q_territory_summary,
    "top_diagnoses": q_top_diagnoses,
    "top_payers": q_top_payers,
    "payer_mix_by_state": q_payer_mix_by_state,
    "new_prescribers": q_new_prescribers,
    "unique_hcps_reverse": q_unique_hcps_reverse,
    "new_prescribers_enriched": q_new_prescribers_enriched,
    "events_with_modifier": q_events_with_modifier,
    "events_with_modifier_token": q_events_with_modifier_token,
    "modifier_refresh_stream": q_modifier_refresh_stream,
    "cohort_patients": q_cohort_patients,
    "cohort_output_tables": q_cohort_output_tables,
    "cohort_entity_counts": q_cohort_entity_counts,
    "age_distribution_check": q_age_distribution_check,
    "robotic_flag_nulls": q_robotic_flag_nulls,
    "mart_procedure_trends_eager": q_mart_procedure_trends_eager,
    "mart_diagnosis_pathways_eager": q_mart_diagnosis_pathways_eager,
    "mart_plans_breakdown_eager": q_mart_plans_breakdown_eager,
    "procedure_page": q_procedure_page,
    "cohort_run_reload": q_cohort_run_reload,
    "cohort_prefiltered_events": q_cohort_prefiltered_events,
    "entity_sketch_counts": q_entity_sketch_counts,
    "table_footer_counts": q_table_footer_counts,
    "staged_layout": q_staged_layout,
}
