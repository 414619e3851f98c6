"""Outputs that are whole or absent, filters below exchanges, one pass per page, sketches, footers, releases, layout."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from claimspark import sinks
from claimspark.operators import cohorts as C
from claimspark.operators import models as M
from claimspark.operators import procedures as P
from claimspark.operators.joins import key_filter, semi_join
from claimspark.plans.inspect import plan_text
from claimspark.plans.session import byte_setting, save, scratch_path, subfolders
from claimspark.plans.workflows import run_cohort, run_procedure_report, run_released_cohort
from claimspark.queries import _events, _extract, _filtered, _stg
from claimspark.sources.catalog import (
    DatasetCatalog, IncompleteRun, Manifestation, footer_row_counts, load_run, manifest_path, scan,
)
from claimspark.sources.fixtures import claims_tables
from tests.conftest import SF_SMALL


# ------------------------------------------------------- outputs are swapped ---

def failing(spark):
    """A frame whose write fails after some tasks have written."""
    return spark.range(0, 100, 1, 4).select(F.when(F.col("id") == 99, F.raise_error(F.lit("boom"))).otherwise(F.col("id")).cast("long").alias("id"))


def test_failed_overwrite_leaves_the_old_rows(spark):
    path = scratch_path(spark, "swap")
    sinks.register_output(spark.range(3), "swap_test", path=path)
    with pytest.raises(Exception, match="boom"):
        sinks.register_output(failing(spark), "swap_test", path=path)
    assert sorted(r.id for r in spark.table("swap_test").collect()) == [0, 1, 2]
    sinks.register_output(spark.range(2).selectExpr("id", "'x' AS added"), "swap_test", path=path)
    assert spark.table("swap_test").columns == ["id", "added"] and spark.table("swap_test").count() == 2


def test_reader_of_the_old_version_goes_on(spark):
    path = scratch_path(spark, "swap")
    sinks.register_output(spark.range(3), "swap_readers", path=path)
    reader = spark.table("swap_readers")
    sinks.register_output(spark.range(7), "swap_readers", path=path)
    assert reader.count() == 3 and spark.table("swap_readers").count() == 7
    for n in (1, 2, 3):
        sinks.register_output(spark.range(n), "swap_readers", path=path, keep=1)
    assert len(subfolders(spark, path)) == 2  # the current one and one replaced
    assert spark.table("swap_readers").count() == 3


def test_output_that_was_a_table_becomes_a_view(spark):
    spark.range(4).write.option("path", scratch_path(spark, "old")).saveAsTable("swap_was_table")
    sinks.register_output(spark.range(6), "swap_was_table", path=scratch_path(spark, "swap"))
    assert spark.table("swap_was_table").count() == 6


# ------------------------------------------------------------- run manifests ---

@pytest.fixture
def cohort(spark):
    return C.Cohort(rule=F.col("procedure_code") == "22612", time_ranges=[("1998-01-01", "1998-01-31")], outputs=(C.MEDICAL, C.DEMOGRAPHICS))


def test_run_is_read_by_its_manifest(spark, tables, cohort):
    root = scratch_path(spark, "runs")
    out = run_cohort(spark, C.area_tables(tables), cohort, "m1", root)
    back = load_run(spark, root, "m1")
    assert {a: df.count() for a, df in back.items()} == {a: df.count() for a, df in out.items()} and len(back) == 2
    run_cohort(spark, C.area_tables(tables), cohort, "m1", root)  # again: the manifest is replaced
    assert load_run(spark, root, "m1")[C.MEDICAL].count() == 529


def test_run_that_has_not_ended_is_refused(spark, tables, cohort):
    root = scratch_path(spark, "runs")
    with pytest.raises(IncompleteRun, match="no manifest"):
        load_run(spark, root, "m2")
    run_cohort(spark, C.area_tables(tables), cohort, "m2", root)
    broken = {**C.area_tables(tables), C.DEMOGRAPHICS: tables.demographics.withColumn("x", F.raise_error(F.lit("boom")))}
    with pytest.raises(Exception, match="boom"):
        run_cohort(spark, broken, cohort, "m2", root)
    with pytest.raises(IncompleteRun, match="no manifest"):  # the earlier run's one is gone too
        load_run(spark, root, "m2")


def test_run_with_other_rows_is_refused(spark, tables, cohort):
    root = scratch_path(spark, "runs")
    run_cohort(spark, C.area_tables(tables), cohort, "m3", root)
    path = spark.read.parquet(manifest_path(root, "m3")).filter(F.col("area") == C.DEMOGRAPHICS).first().path
    tables.demographics.limit(1).write.mode("append").parquet(path)
    with pytest.raises(IncompleteRun, match="patient-demographics"):
        load_run(spark, root, "m3")


# ------------------------------------------------------------ runtime filter ---

@pytest.fixture
def no_broadcast(spark):
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    before = {k: spark.conf.get(k) for k in keys}
    for k in keys:
        spark.conf.set(k, "-1")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_key_filter_sits_below_the_exchange_of_the_semi_join(spark, tables, cohort, no_broadcast):
    stored = save(tables.pharmacy_events, "pharmacy")
    pharmacy = C.Cohort(rule=cohort.rule, time_ranges=cohort.time_ranges, outputs=(C.PHARMACY,))
    out = C.cohort_tables({**C.area_tables(tables), C.PHARMACY: stored}, pharmacy)[C.PHARMACY]
    join, _, side = plan_text(out, "simple").partition("Exchange hashpartitioning(patient_id")
    assert "SortMergeJoin" in join and "LeftSemi" in join and "xxhash64" not in join
    first = side.splitlines()[1]  # what feeds that exchange
    assert "Filter" in first and "getbit(Subquery" in first and "xxhash64(patient_id" in first
    ids = C.materialized_patients(tables.medical_events, cohort)
    assert out.count() == semi_join(tables.pharmacy_events, ids, ["patient_id"]).count() > 0


def test_key_filter_keeps_every_key_and_drops_most_others(spark):
    keys = save(spark.range(5000).select((F.col("id") * 7 - 900).alias("k")).union(spark.createDataFrame([(None,)], "k long")), "keys")
    keep = key_filter(keys, "k", from_bytes=0)
    rows = spark.range(200_000).select((F.col("id") - 50_000).alias("k"), F.lit(1).alias("bits"), F.lit(2).alias("word"))
    kept = keep(rows)
    assert kept.columns == rows.columns
    assert semi_join(kept, keys, ["k"]).count() == semi_join(rows, keys, ["k"]).count() == 5000
    assert kept.count() < 5000 + 0.05 * 200_000
    assert keep(spark.createDataFrame([(None, 1)], "k long, x int")).count() <= 1


def test_key_filter_is_left_out_where_it_spares_nothing(spark):
    keys = save(spark.range(1000), "keys")
    rows = spark.range(10)
    assert key_filter(keys, "id")(rows) is rows                              # would be broadcast
    assert key_filter(keys, "id", max_words=16, from_bytes=0)(rows) is rows  # too many keys for the filter
    empty = save(spark.range(0), "keys")
    assert key_filter(empty, "id", from_bytes=-1)(rows).count() == 0


def test_byte_settings(spark):
    for text, n in (("32MB", 32 << 20), ("10485760b", 10485760), ("-1", -1), ("77", 77)):
        spark.conf.set("spark.sql.test_only.size", text)
        assert byte_setting(spark, "spark.sql.test_only.size") == n


# ------------------------------------------------------ eager aggregation ---

def test_eager_marts_equal_the_marts_of_the_star_join(spark, tables):
    eager, stg = M.eager_marts(tables), _stg(spark, SF_SMALL).cache()
    for name, mart in M.all_marts(stg).items():
        assert eager[name].schema.simpleString() == mart.schema.simpleString()
        assert eager[name].exceptAll(mart).count() == 0 and mart.exceptAll(eager[name]).count() == 0
    stg.unpersist()


class Hot:
    """One patient with most events, two demographics rows and three places; null keys; dimension rows that repeat."""

    def __init__(self, spark):
        frame = spark.createDataFrame
        events = [(1, i, "22612", "2024-01-05" if i % 2 else "01/05/2024", "11", 5, "D1" if i % 3 else None, 9) for i in range(400)]
        events += [(2, 900, "22630", "bad", "11", 5, "D2", 9), (3, 901, "22612", None, "11", 6, "D1", 9), (None, 902, "22612", "2024-01-05", "11", 5, "D1", 9),
                   (2, 903, "22630", "2024-02-01", "11", 7, "D1", 9), (2, 904, None, "2024-02-01", "11", 5, "D1", 8)]
        self.medical_events = frame(events, "patient_id long, medical_event_id long, procedure_code string, service_date string, "
                                            "place_of_service string, rendering_npi long, diagnosis_codes string, kh_plan_id long")
        self.providers = frame([(5, "a", "s", None, "z"), (6, "b", "s", "TX", "z"), (6, "b", "s", "TX", "z")],
                               "npi long, first_name string, primary_specialty string, provider_state string, provider_zip string")
        self.plans = frame([(9, "P", None), (8, None, "Q")], "kh_plan_id long, payer_name string, parent_name string")
        self.demographics = frame([(1, "1980-01-01", "F"), (1, "1980-01-01", None), (2, None, "M"), (3, "x", "F")],
                                  "patient_id long, patient_yob string, patient_gender string")
        self.geography = frame([(1, 1), (1, 2), (1, 3), (2, 4)], "patient_id long, geo_id long")


def test_eager_marts_carry_every_repeat(spark):
    from claimspark.operators.extract import procedure_adoption_from

    hot = Hot(spark)
    stg = M.stg_procedure_events(M.base_procedure_events(procedure_adoption_from(hot)))
    eager = M.eager_marts(hot)
    for name, mart in M.all_marts(stg).items():
        assert sorted(map(str, eager[name].collect())) == sorted(map(str, mart.collect())), name
    assert sum(r.procedure_volume for r in eager["mart_plans_breakdown"].collect()) == 400 * 6 + 2


def test_patient_join_gets_counts_in_place_of_events(spark):
    """What the patient join exchanges: a row per patient and group, though one patient has nearly all events."""
    mart = M.eager_marts(Hot(spark))["mart_plans_breakdown"]
    tree = plan_text(mart, "simple")
    join = tree.index("patient_id") if "Join" not in tree else tree.index("Join")
    assert "partial_count(1)" in tree[join:] and tree[join:].index("HashAggregate") < tree[join:].index("partial_count(1)")


# ------------------------------------------------------------ one pass a page ---

@pytest.mark.parametrize("dim", P.GROUP_BY_OPTIONS)
def test_page_equals_the_single_operators(spark, dim):
    rows = _filtered(spark, SF_SMALL)
    blank = rows.limit(40).withColumns({"provider_state": F.lit(None).cast("string"), "payer_name": F.lit(None).cast("string"),
                                        "rendering_npi": F.lit(None).cast("long"), "medical_event_id": F.lit(None).cast("long")})
    df = save(rows.unionByName(blank), "page")
    page = P.page_frames(P.page_aggregates(df, dim), dim)
    single = {"monthly": P.monthly_counts(df, dim), "territory_summary": P.territory_summary(df), "top_diagnoses": P.top_diagnoses(df),
              "top_payers": P.top_payers(df), "payer_mix_by_state": P.payer_mix_by_state(df)}
    assert set(page) == set(single)
    for name, want in single.items():
        assert page[name].schema.simpleString() == want.schema.simpleString(), name
        assert page[name].collect() == want.collect(), name  # the order too


def test_page_reads_the_events_once(spark):
    aggregates = P.page_aggregates(_filtered(spark, SF_SMALL), "provider_state")
    text = plan_text(aggregates)
    assert text.split("\n\n")[0].count("Expand") == 1 and text.count("lineitem.parquet") == 1
    root = scratch_path(spark, "report")
    frames = run_procedure_report(_extract(spark, SF_SMALL), root, "22612", "1996-01", "1999-12")
    assert subfolders(spark, root) == ["page"]
    assert all("lineitem" not in plan_text(df) and "/page" in plan_text(df) for df in frames.values())
    with pytest.raises(ValueError):
        P.page_aggregates(_filtered(spark, SF_SMALL), "patient_id")


# --------------------------------------------------------- sketches, footers ---

def test_sketches_merge_to_the_counts_of_the_whole(spark):
    events = spark.range(60_000).select((F.col("id") % 40_000).alias("patient_id"), (F.col("id") % 12).alias("month"),
                                        F.lit(None).cast("long").alias("rendering_npi"), (F.col("id") % 3).alias("kh_plan_id"))
    stored = save(C.entity_sketches(events, ["month"], ["patient", "provider", "plan"]), "sketches")
    assert stored.count() == 12
    whole = {r.entity: r.entity_count for r in C.merged_entity_counts(stored, ["patient", "provider", "plan"]).collect()}
    assert abs(whole["patient"] - 40_000) <= 40_000 * 4 * C.SKETCH_ERROR and whole["plan"] == 3 and not whole["provider"]
    exact = {r.month: r.n for r in events.groupBy("month").agg(F.countDistinct("patient_id").alias("n")).collect()}
    for r in C.merged_entity_counts(stored, ["patient"], ["month"]).collect():
        assert abs(r.entity_count - exact[r.month]) <= exact[r.month] * 4 * C.SKETCH_ERROR
    with pytest.raises(ValueError):
        C.entity_sketches(events, ["month"], ["galaxy"])


def test_footer_counts_read_no_data_page(spark):
    paths = {t: f"{SF_SMALL}/{t}.parquet" for t in ("orders", "lineitem")}
    out = footer_row_counts(spark, paths)
    assert plan_text(out).count("PushedAggregation: [COUNT(*)]") == 2
    assert {r.table_type: r.row_count for r in out.collect()} == {t: spark.read.parquet(p).count() for t, p in paths.items()}
    assert "parquet" in spark.conf.get("spark.sql.sources.useV1SourceList")  # the caller's settings stay


# ------------------------------------------------------------------ releases ---

def test_catalog_resolves_releases(spark, tables, cohort):
    root, cat = scratch_path(spark, "releases"), DatasetCatalog()
    for area, df in ((C.MEDICAL, tables.medical_events), (C.DEMOGRAPHICS, tables.demographics)):
        df.write.parquet(f"{root}/{area}/2024")
        df.limit(0).write.parquet(f"{root}/{area}/2023")
        for release in ("2023", "2024"):
            cat.register(area, Manifestation(f"{root}/{area}/{release}", "parquet"), release=release)
    cat.register("plain", Manifestation(f"{SF_SMALL}/region.parquet", "parquet"))
    assert scan(spark, cat, C.MEDICAL, "2023").count() == 0 and scan(spark, cat, "plain", "2023").count() == 5
    with pytest.raises(KeyError, match="no data release '2022'"):
        scan(spark, cat, C.MEDICAL, "2022")
    with pytest.raises(KeyError, match="no data release None"):
        scan(spark, cat, C.MEDICAL)
    new = C.Cohort(rule=cohort.rule, time_ranges=cohort.time_ranges, outputs=cohort.outputs, version="2024")
    assert run_released_cohort(spark, cat, new, "r1", f"{root}/run")[C.MEDICAL].count() == 529
    wrong = C.Cohort(rule=cohort.rule, outputs=cohort.outputs, version="2022")
    with pytest.raises(KeyError):
        run_released_cohort(spark, cat, wrong, "r2", f"{root}/none")
    assert subfolders(spark, f"{root}/none") == []


# -------------------------------------------------------------------- layout ---

def test_bucketed_tables_join_without_an_exchange(spark, no_broadcast):
    events = _events(spark, SF_SMALL).withColumn("month", F.substring("service_date", 1, 4))
    a = sinks.write_layout(events, "layout_events_test", "patient_id", 4, "month", scratch_path(spark, "layout"))
    b = sinks.write_layout(events.filter("procedure_code = 'S2900'").select("patient_id").distinct(), "layout_ids_test", "patient_id", 4,
                           path=scratch_path(spark, "layout"))
    joined = a.join(b, "patient_id", "left_semi")
    assert "Exchange" not in plan_text(joined, "simple")
    assert joined.count() == events.join(events.filter("procedure_code = 'S2900'").select("patient_id").distinct(), "patient_id", "left_semi").count()


def test_partitions_are_pruned_by_a_join(spark):
    events = _events(spark, SF_SMALL).withColumn("month", F.substring("service_date", 1, 4))
    a = sinks.write_layout(events, "layout_pruned_test", "patient_id", 2, "month", scratch_path(spark, "layout"))
    months = save(spark.createDataFrame([("1995", 1), ("1996", 2)], "month string, wanted int"), "months")
    joined = a.join(months.filter("wanted = 2").select("month"), "month")
    assert "dynamicpruning" in plan_text(joined)
    assert joined.count() == events.filter("month = '1996'").count() > 0


def test_lenient_dates_of_full_texts(spark):
    """The short cut for full ISO texts changes nothing for texts that only look like one."""
    from datetime import date

    from claimspark.functions.dates import parse_date_lenient
    texts = {"2024-01-31": date(2024, 1, 31), " 2024-01-31 ": date(2024, 1, 31), "2024-02-30": None, "2024-1-3": date(2024, 1, 3), "abcd-ef-gh": None,
             "2024-01-3x": None, "+024-01-01": None, "2024-01-31T10:00": date(2024, 1, 31), "01/31/2024": date(2024, 1, 31), "31-Jan-2024": date(2024, 1, 31),
             "31-JAN-2024": date(2024, 1, 31), "2024": None, "": None, None: None}
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r.d for r in df.select(parse_date_lenient("t").alias("d")).collect()] == list(texts.values())
