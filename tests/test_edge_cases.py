"""Hand-made rows for the null and edge rules N1-N13 and FIXTURES.md part C."""

from __future__ import annotations

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimspark.functions.dates import age_years, month_text, parse_date_lenient, parse_date_strict
from claimspark.functions.flags import has_token, has_value_upper, is_robotic
from claimspark.functions.labels import CODE_LABELS, code_for_label, label_col
from claimspark.functions.names import dataset_suffix, table_type, table_type_col
from claimspark.operators import cohorts as C
from claimspark.operators import procedures as P
from claimspark.operators import providers as V
from claimspark.operators.cohorts import time_filter
from claimspark.operators.extract import join_geography, procedure_adoption
from claimspark.operators.limits import preview, top_k
from claimspark.operators.models import (
    base_procedure_events, mart_diagnosis_pathways, mart_plans_breakdown, stg_procedure_events,
)
from tests.conftest import rows

S = T.StringType()
L = T.LongType()


def one_col(spark, values, dtype=S, name="c"):
    return spark.createDataFrame([(v,) for v in values], T.StructType([T.StructField(name, dtype)]))


def test_n1_bad_dates_become_null(spark):
    df = one_col(spark, ["2024-13-01", "junk", None, "2024-02-29"])
    got = df.select(parse_date_strict("c").alias("d"), month_text(parse_date_strict("c")).alias("m"))
    assert [tuple(r) for r in got.collect()] == [
        (None, None), (None, None), (None, None), (date(2024, 2, 29), "2024-02")]
    lenient = df.select(parse_date_lenient("c").alias("d"))
    assert [r.d for r in lenient.collect()] == [None, None, None, date(2024, 2, 29)]


def test_n2_strict_and_lenient_rules_differ(spark):
    df = one_col(spark, ["2024-1-3"])
    r = df.select(parse_date_strict("c").alias("app"), parse_date_lenient("c").alias("stg")).first()
    assert r.app is None
    assert r.stg == date(2024, 1, 3)


def test_x1_detects_three_formats(spark):
    texts = ["01/31/2024", "31-JAN-2024", "31-jan-2024", "1-Feb-2024", "2/3/2024", "2024-01-31 10:11:12", "2024", "31/01/2024",
             "20240131", "31-XXX-2024", "13-2024", " 2024-01-31 "]
    got = [r.d for r in one_col(spark, texts).select(parse_date_lenient("c").alias("d")).collect()]
    jan, feb = date(2024, 1, 31), date(2024, 2, 1)
    assert got == [jan, jan, jan, feb, date(2024, 2, 3), jan, None, None, None, None, None, jan]
    strict = [r.d for r in one_col(spark, texts[:3]).select(parse_date_strict("c").alias("d")).collect()]
    assert strict == [None, None, None]


def test_null_patient_is_no_cohort_member(spark):
    df = spark.createDataFrame([(1, "22612", False), (None, "22612", False), (1, "22612", None)],
                               "patient_id long, procedure_code string, is_rejected boolean")
    cohort = C.Cohort(rule=F.col("procedure_code") == "22612")
    assert [r.patient_id for r in C.cohort_patients(df, cohort).collect()] == [1]


def test_output_order_by_month_and_by_volume(spark):
    rows = [("2024-02", "NY", 1), ("2024-01", "NY", 1), (None, "CA", 1), ("2024-01", None, 1), ("2024-01", "CA", 1), ("2024-01", "CA", 1)]
    df = spark.createDataFrame([(m, s, "P", n, i) for i, (m, s, n) in enumerate(rows)],
                               "procedure_month string, provider_state string, payer_name string, rendering_npi long, medical_event_id long")
    monthly = [(r.procedure_month, r.provider_state) for r in P.monthly_counts(df, "provider_state").collect()]
    assert monthly == [(None, "CA"), ("2024-01", None), ("2024-01", "CA"), ("2024-01", "NY"), ("2024-02", "NY")]
    summary = [(r.procedure_volume, r.provider_state) for r in P.territory_summary(df).collect()]
    assert summary == [(3, "CA"), (2, "NY"), (1, None)]
    mix = [(r.procedure_volume, r.provider_state) for r in P.payer_mix_by_state(df).collect()]
    assert mix == summary


def test_x11_name_suffix():
    assert dataset_suffix(datetime(2024, 5, 6, 7, 8, 9)) == "20240506_070809"


def test_n3_robotic_flag_never_null(spark):
    df = one_col(spark, ["S2900", "22612", None])
    assert [r.f for r in df.select(is_robotic("c").alias("f")).collect()] == [True, False, False]


def test_n4_null_group_key_is_one_group(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("A", 3)], "payer_name string, id long")
    got = rows(df.groupBy("payer_name").agg(F.count(F.lit(1)).alias("n")))
    assert got == [("A", 1), (None, 2)]


def _star(spark, npi_event=None, npi_provider=None):
    events = spark.createDataFrame(
        [(1, 10, "22612", "2024-01-01", "11", npi_event, "|M1|", 1)],
        "patient_id long, medical_event_id long, procedure_code string, service_date string, "
        "place_of_service string, rendering_npi long, diagnosis_codes string, kh_plan_id long")
    providers = spark.createDataFrame(
        [(npi_provider, "A", "ORTHO", "CA", "90000")],
        "npi long, first_name string, primary_specialty string, provider_state string, "
        "provider_zip string")
    demo = spark.createDataFrame([(1, "1980-01-01", "F")],
                                 "patient_id long, patient_yob string, patient_gender string")
    geo = spark.createDataFrame([(1, 5)], "patient_id long, geo_id int")
    plans = spark.createDataFrame([(1, "P", "R")], "kh_plan_id long, payer_name string, parent_name string")
    return procedure_adoption(events, providers, demo, geo, plans)


def test_n5_null_join_keys_do_not_match(spark):
    assert _star(spark, None, None).count() == 0
    assert _star(spark, 7, 7).count() == 1


def test_n6_null_safe_enrichment(spark):
    uniques = spark.createDataFrame([(None,), (5,)], "prescriber_npi long")
    prov = spark.createDataFrame([(None, "Unlisted"), (5, "X"), (6, "Y")], "npi long, first_name string")
    got = rows(V.enrich(uniques, prov))
    assert got == [(5, 5, "X"), (None, None, "Unlisted")]


def test_n7_except_is_distinct_and_null_equal(spark):
    a = one_col(spark, [1, 1, None, 2], L, "k")
    b = one_col(spark, [2], L, "k")
    assert rows(V.unique_keys(a, b, "k")) == [(1,), (None,)]
    a2 = one_col(spark, [1, None], L, "k")
    b2 = one_col(spark, [None], L, "k")
    assert rows(V.unique_keys(a2, b2, "k")) == [(1,)]


def test_n8_count_col_skips_nulls(spark):
    df = spark.createDataFrame([(1, "CA"), (None, "CA")], "medical_event_id long, provider_state string")
    r = df.agg(F.count(F.lit(1)).alias("star"), F.count("medical_event_id").alias("col")).first()
    assert (r.star, r.col) == (2, 1)


def test_n9_ratio_by_zero_is_null(spark):
    df = spark.createDataFrame([("CA", None, None)],
                               "provider_state string, medical_event_id long, rendering_npi long")
    r = P.territory_summary(df).first()
    assert r.procedure_volume == 0 and r.hcp_count == 0
    assert r.avg_procedure_per_hcp is None
    assert r.hcp_distinct_count == 0


def test_a6_hcp_count_is_not_distinct(spark):
    df = spark.createDataFrame([("CA", 1, 7), ("CA", 2, 7), ("CA", 3, 8)],
                               "provider_state string, medical_event_id long, rendering_npi long")
    r = P.territory_summary(df).first()
    assert (r.procedure_volume, r.hcp_count, r.hcp_distinct_count) == (3, 3, 2)
    assert r.avg_procedure_per_hcp == 1.0


def test_n10_empty_modifier_kept_null_dropped(spark):
    df = one_col(spark, ["", None, "|59|"], S, "modifiers")
    assert rows(V.events_with_modifier(df)) == [("",), ("|59|",)]
    assert [r.f for r in df.select(has_value_upper("modifiers").alias("f")).collect()] == [True, False, True]


def test_n11_inclusive_month_range(spark):
    df = one_col(spark, ["2024-01", "2024-02", "2024-03", None], S, "procedure_month")
    assert rows(P.filter_month_range(df, "2024-01", "2024-02")) == [("2024-01",), ("2024-02",)]


def test_n12_ties_are_cut_by_key(spark):
    df = spark.createDataFrame([(f"|M{i:02d}|", 5) for i in range(21)],
                               "diagnosis_codes string, procedure_volume long")
    got = top_k(df, 20, [F.desc("procedure_volume"), F.asc("diagnosis_codes")]).collect()
    assert [r.diagnosis_codes for r in got] == [f"|M{i:02d}|" for i in range(20)]


def test_n12_top_diagnoses_tie_break(spark):
    data = [(i, f"|M{i % 21:02d}|") for i in range(42)]  # 21 codes, 2 events each
    df = spark.createDataFrame(data, "medical_event_id long, diagnosis_codes string")
    got = P.top_diagnoses(df, 20).collect()
    assert len(got) == 20 and got[-1].diagnosis_codes == "|M19|"


def test_n13_age_is_year_difference(spark):
    df = one_col(spark, ["2000-12-31"], S, "patient_yob")
    r = df.select(age_years(parse_date_strict("patient_yob"), date(2025, 1, 1)).alias("a")).first()
    assert r.a == 25


def test_j3_geography_fan_out(spark):
    events = spark.createDataFrame([(1, 100), (2, 200), (3, 300)], "patient_id long, medical_event_id long")
    geo = spark.createDataFrame([(2, 1), (3, 1), (3, 2)], "patient_id long, geo_id int")
    got = rows(join_geography(events, geo))
    assert got == [(2, 200), (3, 300), (3, 300)]


def test_j6_robotic_same_day_only(spark):
    df = spark.createDataFrame(
        [(1, "2024-01-05", "S2900", 1), (1, "2024-01-05", "22612", 2),
         (1, "2024-01-06", "22612", 3), (2, "2024-01-05", "22612", 4)],
        "patient_id long, service_date string, procedure_code string, medical_event_id long")
    got = P.keep_robotic_visits(df).filter(F.col("procedure_code") == "22612")
    assert [r.medical_event_id for r in got.collect()] == [2]


def test_j6_distinct_keys_do_not_duplicate(spark):
    df = spark.createDataFrame(
        [(1, "d", "S2900", 1), (1, "d", "S2900", 2), (1, "d", "22612", 3)],
        "patient_id long, service_date string, procedure_code string, medical_event_id long")
    assert P.keep_robotic_visits(df).count() == 3


def test_a12_month_bounds(spark):
    df = one_col(spark, ["2018-01", "2019-05", None], S, "procedure_month")
    r = P.month_bounds(df, "2020-01").first()
    assert (r.min_month, r.max_month) == ("2018-01", "2019-05")
    df2 = one_col(spark, ["2018-01", "2021-03", "2020-02"], S, "procedure_month")
    r2 = P.month_bounds(df2, "2020-01").first()
    assert (r2.min_month, r2.max_month) == ("2020-02", "2021-03")
    empty = one_col(spark, [], S, "procedure_month")
    r3 = P.month_bounds(empty, "2020-01").first()
    assert (r3.min_month, r3.max_month) == (None, None)


def test_f6_token_filter(spark):
    df = one_col(spark, ["|HE|", "|59|HE|", "|HEX|", None], S, "modifiers")
    assert rows(V.events_with_modifier_token(df, "HE")) == [("|59|HE|",), ("|HE|",)]
    flags = [r.f for r in df.select(has_token("modifiers", "HE").alias("f")).collect()]
    assert flags == [True, True, False, False]


def test_f7_time_ranges_inclusive(spark):
    df = spark.createDataFrame([(date(2024, 1, 1),), (date(2024, 1, 31),), (date(2024, 2, 15),),
                                (date(2024, 3, 1),)], "d date")
    cond = time_filter(F.col("d"), [("2024-01-01", "2024-01-31"), ("2024-03-01", "2024-03-31")])
    assert [r.d for r in df.filter(cond).collect()] == [date(2024, 1, 1), date(2024, 1, 31),
                                                        date(2024, 3, 1)]
    assert time_filter(F.col("d"), []) is None


def test_x10_table_type(spark):
    assert table_type("A_0_CLAIMS_MEDICAL_EVENTS") == "MEDICAL_EVENTS"
    assert table_type("A_0_CLAIMS_PLANS") == "CLAIMS_PLANS"
    df = one_col(spark, ["A_0_CLAIMS_MEDICAL_EVENTS", "A_0_CLAIMS_PLANS"])
    assert [r.t for r in df.select(table_type_col("c").alias("t")).collect()] == [
        "MEDICAL_EVENTS", "CLAIMS_PLANS"]


def test_x11_dataset_suffix():
    from datetime import datetime
    assert dataset_suffix(datetime(2024, 3, 9, 7, 5, 1)) == "20240309_070501"


def test_p5_lower_case_and_clash(spark):
    df = spark.createDataFrame([(1, 2)], "A long, b long")
    assert P.lower_case_columns(df).columns == ["a", "b"]
    clash = spark.createDataFrame([(1, 2)], "A long, b long").toDF("A", "a")
    with pytest.raises(ValueError):
        P.lower_case_columns(clash)


def test_p7_labels_both_ways(spark):
    df = one_col(spark, ["22612", "99999", None], S, "procedure_code")
    got = [r.l for r in df.select(label_col("procedure_code").alias("l")).collect()]
    assert got == [CODE_LABELS["22612"], None, None]
    assert code_for_label(CODE_LABELS["S2900"]) == "S2900"
    with pytest.raises(KeyError):
        code_for_label("nope")


def test_a5_dimension_checked(spark):
    df = one_col(spark, ["2024-01"], S, "procedure_month")
    with pytest.raises(ValueError):
        P.monthly_counts(df, "first_name")


def test_p2_p3_models_on_hand_rows(spark):
    extract = spark.createDataFrame(
        [(1, 10, "S2900", "2024-1-3", "11", 7, None, "A", "ORTHO", "CA", "9", "P", 3, "R", "1990-06-01", "F")],
        "patient_id long, medical_event_id long, procedure_code string, service_date string, "
        "place_of_service string, rendering_npi long, diagnosis_codes string, first_name string, "
        "primary_specialty string, provider_state string, provider_zip string, payer_name string, "
        "kh_plan_id long, parent_name string, patient_yob string, patient_gender string")
    base = base_procedure_events(extract)
    assert "plan_id" in base.columns and "diagnosis_code" in base.columns
    assert len(base.columns) == 16
    stg = stg_procedure_events(base, date(2025, 1, 1)).first()
    assert stg.service_date_parsed == date(2024, 1, 3)
    assert stg.procedure_month == date(2024, 1, 1)
    assert stg.patient_age == 35 and stg.is_robotic is True
    assert mart_diagnosis_pathways(stg_procedure_events(base)).count() == 0
    assert mart_plans_breakdown(stg_procedure_events(base)).first().procedure_volume == 1


def test_preview_orders_and_bounds(spark):
    df = spark.createDataFrame([(3, "c"), (1, "a"), (2, None)], "k long, v string")
    assert [r.k for r in preview(df, 2, ["k"]).collect()] == [1, 2]
    assert preview(df, 2).count() == 2
    with pytest.raises(ValueError):
        preview(df, -1)


def test_bounded_read_sizes(spark):
    from claimspark.operators.limits import HEAD_ROWS, PULL_ROWS, SHORT_HEAD_ROWS
    df = spark.range(2000)
    assert preview(df, PULL_ROWS).count() == 1000
    assert [r.id for r in preview(df, SHORT_HEAD_ROWS, ["id"]).collect()] == [0, 1, 2, 3, 4]
    assert preview(df, HEAD_ROWS, [F.desc("id")]).first().id == 1999
