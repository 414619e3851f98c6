"""Sources and sinks: naming, modes, read-back and error cases."""

from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from claimspark import sinks
from claimspark.operators import cohorts as C
from claimspark.plans.session import scratch_path, shared_root
from claimspark.plans.workflows import run_cohort, run_procedure_models, run_unique_keys
from claimspark.sources.catalog import (
    DatasetCatalog, Manifestation, load_outputs, read_parquet, row_counts, scan, sf_catalog,
)
from claimspark.sources.files import EXTRACT_SCHEMA, read_extract_csv
from tests.conftest import SF_SMALL


def test_catalog_first_manifestation_and_missing_name(spark):
    cat = sf_catalog(SF_SMALL)
    cat.register("customers_twice", Manifestation(f"{SF_SMALL}/customer.parquet", "parquet"),
                 Manifestation(f"{SF_SMALL}/supplier.parquet", "parquet"))
    assert "c_custkey" in scan(spark, cat, "customers_twice").columns
    with pytest.raises(KeyError, match="not in the catalog"):
        scan(spark, DatasetCatalog(), "nope")


def test_shared_root_comes_from_session(spark):
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        assert shared_root(spark) == configured.rstrip("/")
    else:
        assert shared_root(spark).startswith(spark.conf.get("spark.sql.warehouse.dir").rstrip("/"))
    assert scratch_path(spark, "x").startswith(shared_root(spark))


def test_publish_names_and_never_replaces(spark):
    df = spark.range(3)
    at = datetime(2024, 5, 6, 7, 8, 9)
    name = sinks.publish(df, "pub_test_", at, path=scratch_path(spark, "pub"))
    assert name == "pub_test_20240506_070809"
    assert spark.table(name).count() == 3
    with pytest.raises(Exception):
        sinks.publish(df, "pub_test_", at, path=scratch_path(spark, "pub"))


def test_register_output_replaces(spark):
    path = scratch_path(spark, "reg")
    sinks.register_output(spark.range(3), "reg_test", path=path)
    sinks.register_output(spark.range(5), "reg_test", path=path)
    assert spark.table("reg_test").count() == 5


def test_materialize_kinds(spark):
    v = sinks.materialize(spark.range(2), "mat_view_test", "view")
    assert v.count() == 2
    t = sinks.materialize(spark.range(4), "mat_table_test", "table", path=scratch_path(spark, "mat"))
    assert t.count() == 4
    with pytest.raises(ValueError):
        sinks.materialize(spark.range(1), "x", "index")


def test_csv_extract_keeps_code_text(spark):
    path = scratch_path(spark, "csv")
    df = spark.createDataFrame(
        [(1, 2, "022612", "2024-01-01", "11", 3, None, "A", "B", "C", "00501", "P", 4, "R",
          "1980-01-01", None)], EXTRACT_SCHEMA)
    sinks.write_extract_csv(df, path)
    back = read_extract_csv(spark, path).first()
    assert back.procedure_code == "022612" and back.provider_zip == "00501"
    assert back.diagnosis_codes is None and back.patient_gender is None


def test_csv_keeps_every_text(spark):
    path = scratch_path(spark, "csv")
    odd = [" F ", "a\nb", 'say "x"', '"', "back\\slash", "\\", "\\\"", "a,b", "", None, "\ttab", "é", " \r\n ", "'", "\\N", "null"]
    row = (1, 2, "022612", "2024-01-01", "11", 3, None, "A", "B", "C", "00501", "P", 4, "R", "1980-01-01")
    df = spark.createDataFrame([(i, *row[1:], t) for i, t in enumerate(odd)], EXTRACT_SCHEMA).repartition(3)
    sinks.write_extract_csv(df, path)
    back = {r.patient_id: r.patient_gender for r in read_extract_csv(spark, path).collect()}
    assert back == {i: t or None for i, t in enumerate(odd)}  # an empty text comes back as null


def test_export_and_load_outputs(spark):
    root = scratch_path(spark, "exp")
    paths = sinks.export({"A_0_CLAIMS_PLANS": spark.range(2), "A_0_CLAIMS_MEDICAL_EVENTS": spark.range(3)},
                         root)
    for name, p in paths.items():
        spark.read.parquet(p).createOrReplaceTempView(name)
    loaded = load_outputs(spark, list(paths))
    assert set(loaded) == {"CLAIMS_PLANS", "MEDICAL_EVENTS"}
    counts = {r.table_type: r.row_count for r in row_counts(loaded).collect()}
    assert counts == {"CLAIMS_PLANS": 2, "MEDICAL_EVENTS": 3}


def test_cohort_table_name():
    assert sinks.cohort_table_name("cht_x", C.MEDICAL) == "COHORT_RUN_CHT_X_0_CLAIMS_MEDICAL_EVENTS"


def test_cohort_unknown_area_raises(spark, tables):
    cohort = C.Cohort(rule=F.col("procedure_code") == "22612", outputs=("claims-unknown",))
    with pytest.raises(ValueError):
        C.cohort_tables(C.area_tables(tables), cohort)
    unbound = C.Cohort(rule=F.col("procedure_code") == "22612", outputs=(C.MORTALITY,))
    with pytest.raises(KeyError):
        C.cohort_tables(C.area_tables(tables), unbound)


def test_cohort_rejected_switch(spark, tables):
    ranges = [("1992-01-01", "1998-12-31")]
    base = dict(rule=F.col("procedure_code") == "22612", time_ranges=ranges)
    kept = C.cohort_events(tables.medical_events, C.Cohort(**base)).count()
    with_rejected = C.cohort_events(
        tables.medical_events, C.Cohort(**base, include_rejected_claims=True)).count()
    rejected = (C.cohort_events(tables.medical_events, C.Cohort(**base, include_rejected_claims=True))
                .filter("is_rejected").count())
    assert with_rejected == kept + rejected and rejected > 0


def test_entity_counts_exact_and_approx(spark, tables):
    cohort = C.Cohort(rule=F.col("procedure_code") == "22612",
                      time_ranges=[("1998-01-01", "1998-01-31")],
                      entities_to_count=("patient", "provider"))
    exact = {r.entity: r.entity_count for r in C.cohort_entity_counts(
        tables.medical_events, cohort).collect()}
    assert exact["patient"] == 10
    approx = {r.entity: r.entity_count for r in C.cohort_entity_counts(
        tables.medical_events, cohort, approx=True).collect()}
    assert abs(approx["provider"] - exact["provider"]) <= max(2, exact["provider"] // 20)
    with pytest.raises(ValueError):
        C.entity_counts(tables.medical_events, ["galaxy"])


def test_procedure_models_workflow(spark, tables):
    root = scratch_path(spark, "models")
    paths = run_procedure_models(tables, None, root)
    stg = spark.read.parquet(paths["stg_procedure_events"])
    total = spark.read.parquet(paths["mart_procedure_trends"]).agg(F.sum("procedure_volume")).first()[0]
    assert total == stg.count() == 4276


def test_catalog_batch_lookup(spark):
    cat = sf_catalog(SF_SMALL)
    names = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
             "events", "labels", "pages"]
    resolved = cat.resolve_many(names)
    assert list(resolved) == names
    assert all(m.format == "parquet" and m.location.endswith(f"{n}.parquet")
               for n, m in resolved.items())
    with pytest.raises(KeyError):
        cat.resolve_many(["region", "missing"])


def test_load_outputs_later_table_wins(spark):
    spark.range(1).createOrReplaceTempView("RUN_A_0_CLAIMS_PLANS")
    spark.range(4).createOrReplaceTempView("RUN_B_0_CLAIMS_PLANS")
    loaded = load_outputs(spark, ["RUN_A_0_CLAIMS_PLANS", "RUN_B_0_CLAIMS_PLANS"])
    assert list(loaded) == ["CLAIMS_PLANS"] and loaded["CLAIMS_PLANS"].count() == 4


def test_run_cohort_counts_entities_when_asked(spark, tables):
    from claimspark.plans.workflows import run_cohort
    cohort = C.Cohort(rule=F.col("procedure_code") == "22612",
                      time_ranges=[("1998-01-01", "1998-01-31")],
                      outputs=(C.MEDICAL, C.PROVIDERS), count_entities=True,
                      entities_to_count=("patient",))
    subjects = C.area_tables(tables)
    out = run_cohort(spark, subjects, cohort, "T1", scratch_path(spark, "cohort"))
    assert set(out) == {C.MEDICAL, C.PROVIDERS, "entity-counts"}
    assert {r.entity: r.entity_count for r in out["entity-counts"].collect()} == {"patient": 10}
    assert out[C.MEDICAL].count() == 529


def test_procedure_report_workflow(spark):
    from claimspark.plans.workflows import run_procedure_report
    from claimspark.queries import QUERIES, _extract
    report = run_procedure_report(_extract(spark, SF_SMALL), scratch_path(spark, "report"),
                                  "22612", "1996-01", "1999-12", as_of=None)
    assert set(report) == {"monthly", "territory_summary", "top_diagnoses", "top_payers",
                           "payer_mix_by_state"}
    for name, key in [("territory_summary", "territory_summary"), ("top_payers", "top_payers"),
                      ("payer_mix_by_state", "payer_mix_by_state"), ("top_diagnoses", "top_diagnoses"),
                      ("monthly", "monthly_by_state")]:
        got = sorted(tuple(r) for r in report[name].collect())
        want = sorted(tuple(r) for r in QUERIES[key](spark, SF_SMALL).collect())
        assert got == want, name


def test_new_prescribers_workflow(spark, tables):
    from claimspark.plans.workflows import run_new_prescribers
    from claimspark.queries import _rx_periods
    later, earlier = _rx_periods(spark, SF_SMALL)
    name = run_new_prescribers(later, earlier, tables.prescribers, "new_hcps_",
                               datetime(2024, 1, 2, 3, 4, 5), path=scratch_path(spark, "newhcp"))
    assert name == "new_hcps_20240102_030405"
    plain = {r.prescriber_npi for r in later.collect()} - {r.prescriber_npi for r in earlier.collect()}
    assert {r.prescriber_npi for r in spark.table(name).collect()} == plain and len(plain) > 5


def test_cohort_run_can_be_repeated(spark, tables):
    cohort = C.Cohort(rule=F.col("procedure_code") == "22612", time_ranges=[("1998-01-01", "1998-01-31")],
                      outputs=(C.MEDICAL, C.DEMOGRAPHICS, C.GEOGRAPHY))
    root = scratch_path(spark, "k5")
    # what a failed run leaves: one of its outputs, with other rows
    spark.range(3).write.parquet(f"{root}/COHORT_RUN_K5_0_CLAIMS_PATIENT_DEMOGRAPHICS")
    first = run_cohort(spark, C.area_tables(tables), cohort, "K5", root)
    n = {a: df.count() for a, df in first.items()}
    again = run_cohort(spark, C.area_tables(tables), cohort, "K5", root)
    assert {a: df.count() for a, df in again.items()} == n and n[C.DEMOGRAPHICS] == 10


def test_a_rewritten_table_is_read_as_it_is(spark):
    path = scratch_path(spark, "rewritten")
    spark.range(2).write.parquet(path)
    assert read_parquet(spark, path).columns == ["id"]
    spark.range(2).selectExpr("id", "'x' AS added").write.mode("overwrite").parquet(path)
    assert read_parquet(spark, path).columns == ["id", "added"]
    spark.range(2).selectExpr("id AS renamed").write.mode("overwrite").parquet(path)
    assert sorted(r.renamed for r in read_parquet(spark, path).collect()) == [0, 1]
    spark.range(2).selectExpr("cast(id AS string) AS renamed").write.mode("overwrite").parquet(path)
    assert read_parquet(spark, path).dtypes == [("renamed", "string")]
    spark.range(5).selectExpr("cast(id AS string) AS renamed").write.mode("append").parquet(path)
    assert read_parquet(spark, path).count() == 7


def test_datasets_by_name(spark):
    root, catalog = scratch_path(spark, "named"), DatasetCatalog()
    for name, keys in (("later", [1, 2, None]), ("earlier", [2])):
        spark.createDataFrame([(k,) for k in keys], "prescriber_npi long").write.parquet(f"{root}/{name}")
        catalog.register(name, Manifestation(f"{root}/{name}", "parquet"))
    out = sinks.export_datasets(spark, catalog, ["later", "earlier"], f"{root}/out")
    assert {n: spark.read.parquet(p).count() for n, p in out.items()} == {"later": 3, "earlier": 1}
    with pytest.raises(KeyError):
        sinks.export_datasets(spark, catalog, ["later", "unknown"], f"{root}/none")
    name = run_unique_keys(spark, catalog, "later", "earlier", "unique_by_name_test", path=f"{root}/unique")
    assert {r.prescriber_npi for r in spark.table(name).collect()} == {1, None}


def test_cohort_reads_the_requested_release(spark, tables):
    current = C.area_tables(tables)
    releases = {"release": current, "preview": {C.MEDICAL: current[C.MEDICAL].limit(0)}}
    assert C.subjects_for(C.Cohort(rule=F.lit(True)), releases)[C.MEDICAL] is current[C.MEDICAL]
    preview_cohort = C.Cohort(rule=F.lit(True), version="preview")
    assert C.subjects_for(preview_cohort, releases)[C.MEDICAL].count() == 0
    with pytest.raises(KeyError, match="no data release"):
        C.subjects_for(C.Cohort(rule=F.lit(True), version="2019"), releases)
