
from __future__ import annotations

import re

from pyspark.sql.classic.dataframe import DataFrame

from claimspark.queries import QUERIES
from claimspark.plans.inspect import exchanges, optimized_logical_plan, plan_text
from tests.conftest import SF_SMALL


def plan(spark, key):
    return plan_text(QUERIES[key](spark, SF_SMALL))


def test_top_k_is_take_ordered(spark):
    for key in ("top_diagnoses", "top_payers", "preview_limit"):
        assert "TakeOrderedAndProject" in plan(spark, key), key


def test_robotic_reads_the_written_visits_and_joins_the_rest_once(spark):
    p = plan(spark, "robotic_procedures")
    tree = p.split("\n\n")[0]
    assert tree.count("LeftSemi") == 1 and "robotic-visits" in p
    assert p.count("lineitem.parquet") == 1  # the kept side; the visits come from their table


def test_scans_prune_columns_and_push_filters(spark):
    p = plan(spark, "new_prescribers")
    # the period alone reaches the lineitem scan: no line is left out otherwise
    scans = re.findall(r"Location: [^\n]*lineitem[^\n]*\n(?:PartitionFilters[^\n]*\n)?PushedFilters: \[([^\]]*)\]", p)
    assert scans and all("l_shipdate" in x and "l_quantity" not in x and "l_linenumber" not in x for x in scans)
    scan = re.search(r"ReadSchema: (struct<l_[^>]*>)", p).group(1)
    assert "l_extendedprice" not in scan and "l_comment" not in scan


def test_every_order_line_is_a_pharmacy_event(spark, tables):
    lines = spark.read.parquet(f"{SF_SMALL}/lineitem.parquet").count()
    assert tables.pharmacy_events.count() == tables.medical_events.count() == lines


def test_month_range_reaches_a_stored_date_text(spark):
    from pyspark.sql import functions as F

    from claimspark.operators import procedures as P
    from claimspark.plans.session import save

    stored = save(spark.createDataFrame([("2024-01-05",), ("2023-12-31",), ("junk",), (None,)], "service_date string"), "text")
    months = stored.withColumn("procedure_month", F.substring("service_date", 1, 7))
    df = P.filter_month_range(months, "2024-01", "2024-02")
    assert "GreaterThanOrEqual(service_date,2024-01)" in plan_text(df)
    assert [r.service_date for r in df.collect()] == ["2024-01-05"]


def test_cohort_range_reaches_a_stored_date(spark):
    from pyspark.sql import functions as F

    from claimspark.operators import cohorts as C
    from claimspark.plans.session import save

    df = spark.createDataFrame([(1, "22612", "2024-01-05", False)], "patient_id long, procedure_code string, d string, is_rejected boolean")
    events = save(df.withColumn("day", F.to_date("d")), "events")
    cohort = C.Cohort(rule=F.col("procedure_code") == "22612", time_ranges=[("2024-01-01", "2024-01-31")], date_col="day")
    assert "GreaterThanOrEqual(day,2024-01-01)" in plan_text(C.cohort_patients(events, cohort))


def test_preview_without_an_order_is_a_limit(spark):
    from claimspark.operators.limits import preview

    p = plan_text(preview(spark.read.parquet(f"{SF_SMALL}/customer.parquet"), 5))
    assert "CollectLimit" in p and "Sort" not in p and "TakeOrdered" not in p


def test_aggregates_are_partial_before_shuffle(spark):
    p = plan(spark, "mart_procedure_trends")
    assert p.count("HashAggregate") >= 2  # partial + final around one exchange


def test_fact_shuffled_once_for_patient_dimensions(spark):
    # demographics and geography are joined to each other first, so the event
    # table meets the patient dimension in one join on patient_id
    p = optimized_logical_plan(QUERIES["procedure_adoption"](spark, SF_SMALL))
    assert p.count("Join Inner") >= 5  # 4 star joins + lines/orders (+ dims of the fixture)
    ex = exchanges(QUERIES["procedure_adoption"](spark, SF_SMALL))
    assert sum(1 for e in ex if "patient_id" in e) <= 3


NULL_SAFE_KEYS = re.compile(r"keys \[2\]: \[coalesce\(prescriber_npi#\d+L, 0\), isnull\(prescriber_npi")


def test_except_is_null_safe_anti_join(spark):
    p = plan(spark, "new_prescribers")
    assert "LeftAnti" in p
    assert NULL_SAFE_KEYS.search(p)  # <=> planned as an equi-join on (coalesce, isnull)


def test_except_deduplicates_before_the_shuffle(spark):
    df = QUERIES["new_prescribers"](spark, SF_SMALL)
    tree = df._jdf.queryExecution().executedPlan().toString().splitlines()
    # every shuffle of prescribers reads from an aggregate: rows are
    # de-duplicated per task first, and only distinct keys move afterwards
    below = [tree[i + 1] for i, ln in enumerate(tree) if "Exchange hashpartitioning(" in ln and "prescriber_npi" in ln]
    assert below and all("HashAggregate" in ln for ln in below)


def test_enrichment_join_is_null_safe(spark):
    assert NULL_SAFE_KEYS.search(plan(spark, "new_prescribers_enriched"))


def test_no_python_udf_in_any_plan(spark, monkeypatch):
    written = []
    real = DataFrame.write.fget

    def write(df):
        written.append(plan_text(df))
        return real(df)
    monkeypatch.setattr(DataFrame, "write", property(write))
    for key in QUERIES:
        p = plan(spark, key)
        assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p, key
    assert len(written) > 20  # what the sink queries write is checked as well
    assert not any("BatchEvalPython" in p or "ArrowEvalPython" in p for p in written)


def test_fixture_fact_join_is_never_broadcast(spark):
    p = plan(spark, "events_with_modifier")
    assert "SortMergeJoin" in p or "ShuffledHashJoin" in p


def test_star_join_reads_the_events_once(spark):
    p = plan(spark, "procedure_adoption")
    assert p.count("lineitem.parquet") == 1
    assert "claimspark-scratch/patients" in p
    assert "Generate" not in p.split("\n\n")[0]  # nothing is replicated


def test_cohort_semi_joins_read_the_written_id_set(spark):
    p = plan(spark, "cohort_entity_counts")
    assert "claimspark-scratch/cohort-ids" in p
