"""DuckDB oracle SQL for every registered query.

Each oracle is one SQL statement over the raw test tables.  The claims views
of FIXTURES.md part B are prepended as CTEs; the text of the binding runs
unchanged on DuckDB and Spark.  These strings are an independent statement of
each query's meaning: the Spark side is written with the DataFrame API.

Column names are aliased exactly as on the Spark side.  Types are cast where
the engines differ (DuckDB gives BIGINT for ``year()``, TIMESTAMP for
``date_trunc`` on a date).
"""

from __future__ import annotations

from claimspark.functions.labels import CODE_LABELS
from claimspark.sources.catalog import TEST_TABLES

# The date of service_date in any of the three detected formats.
DETECTED = "CAST(try_strptime(service_date, ['%Y-%m-%d', '%m/%d/%Y', '%d-%b-%Y']) AS DATE)"

BINDING_VIEWS: list[tuple[str, str]] = [
    ("providers", """
SELECT s_suppkey AS npi, s_name AS first_name,
  CASE s_suppkey % 3 WHEN 0 THEN 'ORTHO' WHEN 1 THEN 'NEURO' ELSE 'PAIN' END AS primary_specialty,
  n_name AS provider_state, CAST(10000 + s_suppkey % 900 AS STRING) AS provider_zip
FROM supplier JOIN nation ON s_nationkey = n_nationkey
UNION ALL
SELECT CAST(NULL AS BIGINT), 'Unlisted', 'UNKNOWN', CAST(NULL AS STRING), CAST(NULL AS STRING)"""),
    ("demographics", """
SELECT c_custkey AS patient_id,
  CASE WHEN c_custkey % 97 = 0 THEN 'unknown'
       ELSE CAST(1930 + c_custkey % 80 AS STRING) || '-01-01' END AS patient_yob,
  CASE c_custkey % 3 WHEN 0 THEN 'F' WHEN 1 THEN 'M' ELSE NULL END AS patient_gender
FROM customer"""),
    ("geography", """
SELECT c_custkey AS patient_id, c_nationkey AS geo_id FROM customer WHERE c_custkey % 10 <> 0
UNION ALL
SELECT c_custkey AS patient_id, c_nationkey + 100 AS geo_id FROM customer WHERE c_custkey % 20 = 1"""),
    ("plans", """
SELECT CAST(n_nationkey AS BIGINT) AS kh_plan_id, 'Payer ' || n_name AS payer_name, r_name AS parent_name
FROM nation JOIN region ON n_regionkey = r_regionkey"""),
    ("medical_events", """
SELECT o_custkey AS patient_id, l_orderkey * 10 + l_linenumber AS medical_event_id,
  CASE l_linenumber WHEN 1 THEN '22612' WHEN 2 THEN '22630' WHEN 3 THEN '22633' WHEN 4 THEN 'S2900'
                    WHEN 5 THEN '99213' WHEN 6 THEN NULL ELSE '27447' END AS procedure_code,
  CASE WHEN l_orderkey % 101 = 0 THEN 'bad-date'
       WHEN l_orderkey % 103 = 1 THEN substr(day, 6, 2) || '/' || substr(day, 9, 2) || '/' || substr(day, 1, 4)
       WHEN l_orderkey % 103 = 2 THEN substr(day, 9, 2) || '-' ||
            substr('JANFEBMARAPRMAYJUNJULAUGSEPOCTNOVDEC', CAST(substr(day, 6, 2) AS INT) * 3 - 2, 3) || '-' || substr(day, 1, 4)
       ELSE day END AS service_date,
  CASE WHEN l_linestatus = 'F' THEN '24' ELSE '11' END AS place_of_service,
  CASE WHEN l_suppkey % 50 = 7 THEN NULL ELSE l_suppkey END AS rendering_npi,
  CASE WHEN l_partkey % 7 = 0 THEN NULL
       ELSE '|M' || CAST(l_partkey % 40 AS STRING) || '|' END AS diagnosis_codes,
  CASE WHEN l_returnflag = 'R' THEN NULL WHEN l_returnflag = 'A' THEN '|HE|'
       WHEN l_linestatus = 'F' THEN '|59|HE|' ELSE '|59|' END AS modifiers,
  l_partkey % 30 AS kh_plan_id,
  (l_linestatus = 'F' AND l_returnflag = 'R') AS is_rejected
FROM lineitem JOIN (SELECT o_orderkey, o_custkey, CAST(CAST(o_orderdate AS DATE) AS STRING) AS day FROM orders)
  ON l_orderkey = o_orderkey"""),
    ("pharmacy_events", """
SELECT o_custkey AS patient_id, l_orderkey * 10 + l_linenumber AS pharmacy_event_id,
  CAST(l_shipdate AS DATE) AS fill_date,
  CASE WHEN o_custkey % 10 = 3 AND l_shipdate >= DATE '1998-01-01' THEN NULL
       ELSE o_custkey * 10 + l_linenumber END AS prescriber_npi
FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""),
    ("prescribers", """
SELECT c_custkey * 10 + k AS npi, c_name || ' ' || CAST(k AS STRING) AS first_name,
  CASE c_custkey % 3 WHEN 0 THEN 'ORTHO' WHEN 1 THEN 'NEURO' ELSE 'PAIN' END AS primary_specialty,
  n_name AS provider_state, CAST(10000 + c_custkey % 900 AS STRING) AS provider_zip
FROM customer JOIN nation ON c_nationkey = n_nationkey
CROSS JOIN (SELECT 1 AS k UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4 UNION ALL SELECT 5
            UNION ALL SELECT 6 UNION ALL SELECT 7)
UNION ALL
SELECT CAST(NULL AS BIGINT), 'Unlisted', 'UNKNOWN', CAST(NULL AS STRING), CAST(NULL AS STRING)"""),
    ("procedure_adoption", """
SELECT mx.patient_id, mx.medical_event_id, mx.procedure_code, mx.service_date, mx.place_of_service,
  mx.rendering_npi, mx.diagnosis_codes, pr.first_name, pr.primary_specialty, pr.provider_state,
  pr.provider_zip, pl.payer_name, pl.kh_plan_id, pl.parent_name, d.patient_yob, d.patient_gender
FROM medical_events mx
JOIN providers pr ON mx.rendering_npi = pr.npi
JOIN demographics d ON mx.patient_id = d.patient_id
JOIN geography g ON mx.patient_id = g.patient_id
JOIN plans pl ON mx.kh_plan_id = pl.kh_plan_id"""),
    # Derived layers used by several oracles (our own, not part of the binding).
    ("base_procedure_events", """
SELECT patient_id, medical_event_id, procedure_code, service_date, place_of_service, rendering_npi,
  first_name, primary_specialty, provider_state, provider_zip, payer_name, parent_name,
  kh_plan_id AS plan_id, patient_yob, patient_gender, diagnosis_codes AS diagnosis_code
FROM procedure_adoption"""),
    ("stg_procedure_events", """
SELECT *,
  {DETECTED} AS service_date_parsed,
  CAST(date_trunc('month', {DETECTED}) AS DATE) AS procedure_month,
  CAST(2025 - year(TRY_CAST(patient_yob AS DATE)) AS INTEGER) AS patient_age,
  CASE WHEN procedure_code = 'S2900' THEN true ELSE false END AS is_robotic
FROM base_procedure_events"""),
    ("app_events", """
SELECT *,
  CAST(try_strptime(service_date, '%Y-%m-%d') AS DATE) AS service_date_parsed,
  strftime(CAST(try_strptime(service_date, '%Y-%m-%d') AS DATE), '%Y-%m') AS procedure_month,
  CAST(2025 - year(CAST(try_strptime(patient_yob, '%Y-%m-%d') AS DATE)) AS INTEGER) AS patient_age
FROM (SELECT patient_id, medical_event_id, procedure_code, service_date, place_of_service,
        rendering_npi, diagnosis_codes, first_name, primary_specialty, provider_state,
        provider_zip, payer_name, kh_plan_id, parent_name, patient_yob, patient_gender,
        'CLAIMS' AS type
      FROM procedure_adoption)"""),
    ("app_targets", """
SELECT * FROM app_events WHERE procedure_code IN ('22612', '22630', '22633', 'S2900')"""),
    ("app_filtered", """
SELECT * FROM app_targets
WHERE procedure_code = '22612' AND procedure_month BETWEEN '1996-01' AND '1999-12'"""),
    ("rx_earlier", """
SELECT * FROM pharmacy_events WHERE fill_date >= DATE '1997-01-01' AND fill_date < DATE '1998-01-01'"""),
    ("rx_later", """
SELECT * FROM pharmacy_events WHERE fill_date >= DATE '1998-01-01' AND fill_date < DATE '1999-01-01'"""),
    ("cohort_ids", """
SELECT DISTINCT patient_id FROM medical_events
WHERE procedure_code = '22612'
  AND {DETECTED} BETWEEN DATE '1998-01-01' AND DATE '1998-01-31'
  AND NOT is_rejected"""),
]


def with_views(body: str) -> str:
    """Prefix ``body`` with every binding view as a CTE (unused ones are free)."""
    ctes = ",\n".join(f"{name} AS ({sql.strip()}\n)" for name, sql in BINDING_VIEWS)
    ctes = ctes.replace("{DETECTED}", DETECTED)
    return f"WITH {ctes}\n{body.strip()}"


APP_COLUMNS = (
    "patient_id, medical_event_id, procedure_code, service_date, place_of_service, rendering_npi, "
    "diagnosis_codes, first_name, primary_specialty, provider_state, provider_zip, payer_name, "
    "kh_plan_id, parent_name, patient_yob, patient_gender, type, service_date_parsed, "
    "procedure_month, patient_age"
)

EVENT_COLS = ("patient_id, medical_event_id, procedure_code, service_date, place_of_service, "
              "rendering_npi, diagnosis_codes, kh_plan_id")
ME_ALL = EVENT_COLS + ", modifiers, is_rejected"

FOOTER_TABLES = "\nUNION ALL ".join(f"SELECT '{t}' AS table_type, count(*) AS row_count FROM {t}" for t in TEST_TABLES)

_BODIES: dict[str, str] = {
    "scan_table": "SELECT * FROM customer",
    "preview_limit": f"""
SELECT {ME_ALL} FROM medical_events
ORDER BY patient_id NULLS FIRST, medical_event_id NULLS FIRST, procedure_code NULLS FIRST,
  service_date NULLS FIRST, place_of_service NULLS FIRST, rendering_npi NULLS FIRST,
  diagnosis_codes NULLS FIRST, kh_plan_id NULLS FIRST, modifiers NULLS FIRST, is_rejected NULLS FIRST
LIMIT 100""",
    "join_providers": f"""
SELECT mx.*, pr.npi, pr.first_name, pr.primary_specialty, pr.provider_state, pr.provider_zip
FROM (SELECT {EVENT_COLS} FROM medical_events) mx JOIN providers pr ON mx.rendering_npi = pr.npi""",
    "join_demographics": f"""
SELECT mx.*, d.patient_yob, d.patient_gender
FROM (SELECT {EVENT_COLS} FROM medical_events) mx JOIN demographics d ON mx.patient_id = d.patient_id""",
    "join_geography_fanout": f"""
SELECT mx.* FROM (SELECT {EVENT_COLS} FROM medical_events) mx
JOIN geography g ON mx.patient_id = g.patient_id""",
    "join_plans": f"""
SELECT mx.*, pl.payer_name, pl.parent_name
FROM (SELECT {EVENT_COLS} FROM medical_events) mx JOIN plans pl ON mx.kh_plan_id = pl.kh_plan_id""",
    "procedure_adoption": "SELECT * FROM procedure_adoption",
    "csv_roundtrip": "SELECT * FROM procedure_adoption",
    "base_procedure_events": "SELECT * FROM base_procedure_events",
    "stg_procedure_events": "SELECT * FROM stg_procedure_events",
    "mart_procedure_trends": """
SELECT procedure_month, procedure_code, provider_state, payer_name, patient_gender,
  count(*) AS procedure_volume
FROM stg_procedure_events GROUP BY 1, 2, 3, 4, 5""",
    "mart_trends_sql": """
SELECT procedure_month, procedure_code, provider_state, payer_name, patient_gender,
  count(*) AS procedure_volume
FROM stg_procedure_events GROUP BY 1, 2, 3, 4, 5""",
    "mart_diagnosis_pathways": """
SELECT procedure_code, diagnosis_code, count(*) AS procedure_volume
FROM stg_procedure_events WHERE diagnosis_code IS NOT NULL GROUP BY 1, 2""",
    "mart_plans_breakdown": """
SELECT procedure_code, plan_id, payer_name, parent_name, count(*) AS procedure_volume
FROM stg_procedure_events GROUP BY 1, 2, 3, 4""",
    "materialize_readback": """
SELECT procedure_code, plan_id, payer_name, parent_name, count(*) AS procedure_volume
FROM stg_procedure_events GROUP BY 1, 2, 3, 4""",
    "age_distribution_check": """
SELECT patient_age, count(*) AS event_count FROM stg_procedure_events GROUP BY 1""",
    "robotic_flag_nulls": """
SELECT procedure_code, is_robotic, count(*) AS event_count FROM stg_procedure_events GROUP BY 1, 2""",
    "app_prepare": f"SELECT {APP_COLUMNS} FROM app_events",
    "filter_target_codes": f"SELECT {APP_COLUMNS} FROM app_targets",
    "procedure_labels": """
SELECT medical_event_id, patient_id, procedure_code,
  CASE procedure_code
{LABELS}
  END AS procedure_label
FROM app_targets""",
    "filter_code_month": f"SELECT {APP_COLUMNS} FROM app_filtered",
    "robotic_procedures": f"""
SELECT {APP_COLUMNS} FROM app_targets t
WHERE procedure_code = '22612'
  AND EXISTS (SELECT 1 FROM app_targets r WHERE r.procedure_code = 'S2900'
              AND r.patient_id = t.patient_id AND r.service_date = t.service_date)
  AND procedure_month BETWEEN '1996-01' AND '1999-12'""",
    "distinct_months": "SELECT DISTINCT procedure_month FROM app_targets",
    "month_bounds": """
SELECT coalesce(min(CASE WHEN procedure_month >= '1998-06' THEN procedure_month END),
                min(procedure_month)) AS min_month,
       max(procedure_month) AS max_month
FROM app_targets""",
    "monthly_by_state": """
SELECT procedure_month, provider_state, count(medical_event_id) AS procedure_count
FROM app_filtered GROUP BY 1, 2""",
    "monthly_by_payer": """
SELECT procedure_month, payer_name, count(medical_event_id) AS procedure_count
FROM app_filtered GROUP BY 1, 2""",
    "monthly_by_gender": """
SELECT procedure_month, patient_gender, count(medical_event_id) AS procedure_count
FROM app_filtered GROUP BY 1, 2""",
    "territory_summary": """
SELECT provider_state, count(medical_event_id) AS procedure_volume,
  count(rendering_npi) AS hcp_count,
  CAST(count(medical_event_id) AS DOUBLE) / NULLIF(count(rendering_npi), 0) AS avg_procedure_per_hcp,
  count(DISTINCT rendering_npi) AS hcp_distinct_count
FROM app_filtered GROUP BY 1""",
    "top_diagnoses": """
SELECT diagnosis_codes, count(medical_event_id) AS procedure_volume
FROM app_filtered WHERE diagnosis_codes IS NOT NULL GROUP BY 1
ORDER BY procedure_volume DESC, diagnosis_codes ASC LIMIT 20""",
    "top_payers": """
SELECT payer_name, parent_name, count(medical_event_id) AS procedure_volume
FROM app_filtered GROUP BY 1, 2
ORDER BY procedure_volume DESC, payer_name ASC NULLS FIRST, parent_name ASC NULLS FIRST LIMIT 20""",
    "payer_mix_by_state": """
SELECT provider_state, payer_name, count(medical_event_id) AS procedure_volume
FROM app_filtered GROUP BY 1, 2""",
    "new_prescribers": """
SELECT prescriber_npi FROM rx_later EXCEPT SELECT prescriber_npi FROM rx_earlier""",
    "register_output_readback": """
SELECT prescriber_npi FROM rx_later EXCEPT SELECT prescriber_npi FROM rx_earlier""",
    "unique_hcps_reverse": """
SELECT prescriber_npi FROM rx_earlier EXCEPT SELECT prescriber_npi FROM rx_later""",
    "new_prescribers_enriched": """
SELECT u.prescriber_npi, p.npi, p.first_name, p.primary_specialty, p.provider_state, p.provider_zip
FROM (SELECT prescriber_npi FROM rx_later EXCEPT SELECT prescriber_npi FROM rx_earlier) u
JOIN prescribers p ON u.prescriber_npi IS NOT DISTINCT FROM p.npi""",
    "events_with_modifier": f"SELECT {ME_ALL} FROM medical_events WHERE upper(modifiers) IS NOT NULL",
    "publish_readback": f"SELECT {ME_ALL} FROM medical_events WHERE upper(modifiers) IS NOT NULL",
    "modifier_refresh_stream": f"SELECT {ME_ALL} FROM medical_events WHERE upper(modifiers) IS NOT NULL",
    "events_with_modifier_token": f"""
SELECT {ME_ALL} FROM medical_events WHERE list_contains(string_split(modifiers, '|'), 'HE')""",
    "cohort_patients": "SELECT patient_id FROM cohort_ids",
    "export_readback": f"""
SELECT {ME_ALL} FROM medical_events WHERE patient_id IN (SELECT patient_id FROM cohort_ids)""",
    "cohort_output_tables": """
SELECT 'claims-medical-events' AS output_type, count(*) AS row_count
  FROM medical_events WHERE patient_id IN (SELECT patient_id FROM cohort_ids)
UNION ALL SELECT 'claims-pharmacy-events', count(*)
  FROM pharmacy_events WHERE patient_id IN (SELECT patient_id FROM cohort_ids)
UNION ALL SELECT 'claims-patient-demographics', count(*)
  FROM demographics WHERE patient_id IN (SELECT patient_id FROM cohort_ids)
UNION ALL SELECT 'claims-patient-geography', count(*)
  FROM geography WHERE patient_id IN (SELECT patient_id FROM cohort_ids)
UNION ALL SELECT 'claims-plans', count(*)
  FROM plans WHERE kh_plan_id IN (SELECT kh_plan_id FROM medical_events
                                  WHERE patient_id IN (SELECT patient_id FROM cohort_ids))
UNION ALL SELECT 'claims-providers', count(*)
  FROM providers WHERE npi IN (SELECT rendering_npi FROM medical_events
                               WHERE patient_id IN (SELECT patient_id FROM cohort_ids))""",
    "output_row_counts": """
SELECT 'MEDICAL_EVENTS' AS table_type, count(*) AS row_count, 10 AS column_count
  FROM medical_events WHERE patient_id IN (SELECT patient_id FROM cohort_ids)
UNION ALL SELECT 'PHARMACY_EVENTS', count(*), 4
  FROM pharmacy_events WHERE patient_id IN (SELECT patient_id FROM cohort_ids)
UNION ALL SELECT 'PATIENT_DEMOGRAPHICS', count(*), 3
  FROM demographics WHERE patient_id IN (SELECT patient_id FROM cohort_ids)
UNION ALL SELECT 'PATIENT_GEOGRAPHY', count(*), 2
  FROM geography WHERE patient_id IN (SELECT patient_id FROM cohort_ids)
UNION ALL SELECT 'CLAIMS_PLANS', count(*), 3
  FROM plans WHERE kh_plan_id IN (SELECT kh_plan_id FROM medical_events
                                  WHERE patient_id IN (SELECT patient_id FROM cohort_ids))
UNION ALL SELECT 'CLAIMS_PROVIDERS', count(*), 5
  FROM providers WHERE npi IN (SELECT rendering_npi FROM medical_events
                               WHERE patient_id IN (SELECT patient_id FROM cohort_ids))""",
    "cohort_entity_counts": """
SELECT 'patient' AS entity, count(DISTINCT patient_id) AS entity_count
  FROM medical_events WHERE patient_id IN (SELECT patient_id FROM cohort_ids)
UNION ALL SELECT 'provider', count(DISTINCT rendering_npi)
  FROM medical_events WHERE patient_id IN (SELECT patient_id FROM cohort_ids)
UNION ALL SELECT 'plan', count(DISTINCT kh_plan_id)
  FROM medical_events WHERE patient_id IN (SELECT patient_id FROM cohort_ids)""",
}

_BODIES |= {
    "mart_procedure_trends_eager": _BODIES["mart_procedure_trends"],
    "mart_diagnosis_pathways_eager": _BODIES["mart_diagnosis_pathways"],
    "mart_plans_breakdown_eager": _BODIES["mart_plans_breakdown"],
    "cohort_run_reload": _BODIES["cohort_output_tables"],
    "cohort_prefiltered_events": """
SELECT patient_id, pharmacy_event_id, fill_date FROM pharmacy_events
WHERE patient_id IN (SELECT patient_id FROM cohort_ids)""",
    "entity_sketch_counts": """
SELECT 'patient' AS entity, count(DISTINCT patient_id) AS exact_count, true AS within_four_errors FROM medical_events
UNION ALL SELECT 'provider', count(DISTINCT rendering_npi), true FROM medical_events
UNION ALL SELECT 'plan', count(DISTINCT kh_plan_id), true FROM medical_events""",
    "table_footer_counts": FOOTER_TABLES,
    "staged_layout": """
SELECT procedure_month, count(*) AS event_count FROM stg_procedure_events
WHERE patient_id IN (SELECT patient_id FROM stg_procedure_events WHERE is_robotic) GROUP BY 1""",
    "procedure_page": f"""
SELECT 'monthly' AS frame, procedure_month AS key_1, provider_state AS key_2, procedure_count AS volume,
  CAST(NULL AS BIGINT) AS hcp_distinct_count FROM ({_BODIES["monthly_by_state"]})
UNION ALL SELECT 'territory_summary', provider_state, NULL, procedure_volume, hcp_distinct_count FROM ({_BODIES["territory_summary"]})
UNION ALL SELECT 'top_diagnoses', diagnosis_codes, NULL, procedure_volume, NULL FROM ({_BODIES["top_diagnoses"]})
UNION ALL SELECT 'top_payers', payer_name, parent_name, procedure_volume, NULL FROM ({_BODIES["top_payers"]})
UNION ALL SELECT 'payer_mix_by_state', provider_state, payer_name, procedure_volume, NULL FROM ({_BODIES["payer_mix_by_state"]})""",
}


def oracle_sql() -> dict[str, str]:
    labels = "\n".join(f"    WHEN '{code}' THEN '{label}'" for code, label in CODE_LABELS.items())
    return {key: with_views(body.replace("{LABELS}", labels)) for key, body in _BODIES.items()}
