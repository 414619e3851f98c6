"""Property tests: operators against plain-Python statements of their meaning
on small random inputs (few examples each; every example is a Spark job)."""

from __future__ import annotations

from collections import Counter

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from claimspark.functions.dates import month_text, parse_date_strict
from claimspark.operators import procedures as P
from claimspark.operators import providers as V
from claimspark.operators.joins import hot_keys, salted_join

SETTINGS = settings(max_examples=8, deadline=None,
                    suppress_health_check=[HealthCheck.function_scoped_fixture])

keys = st.one_of(st.none(), st.integers(min_value=0, max_value=5))


@SETTINGS
@given(a=st.lists(keys, max_size=12), b=st.lists(keys, max_size=12))
def test_unique_keys_is_set_difference_with_equal_nulls(spark, a, b):
    df_a = spark.createDataFrame([(x,) for x in a], "k long")
    df_b = spark.createDataFrame([(x,) for x in b], "k long")
    got = sorted((r.k for r in V.unique_keys(df_a, df_b, "k").collect()), key=lambda v: (v is None, v))
    want = sorted(set(a) - set(b), key=lambda v: (v is None, v))
    assert got == want


@SETTINGS
@given(big=st.lists(st.tuples(st.integers(0, 3), st.integers(0, 50)), min_size=1, max_size=40),
       small=st.lists(st.tuples(st.integers(0, 4), st.integers(0, 9)), max_size=10),
       split=st.integers(1, 6))
def test_salted_join_equals_plain_join(spark, big, small, split):
    b = spark.createDataFrame(big, "k long, v long")
    s = spark.createDataFrame(small, "k long, w long")
    got = Counter(tuple(r) for r in salted_join(b, s, ["k"], ["v"], hot_keys(b, ["k"], split))
                  .select("k", "v", "w").collect())
    want = Counter((k, v, w) for k, v in big for k2, w in small if k == k2)
    assert got == want


@SETTINGS
@given(months=st.lists(st.one_of(st.none(), st.sampled_from(
    ["2018-01", "2019-07", "2020-01", "2020-02", "2021-12"])), max_size=8),
       floor=st.sampled_from(["2019-01", "2020-01", "2022-01"]))
def test_month_bounds_matches_the_slider_rule(spark, months, floor):
    df = spark.createDataFrame([(m,) for m in months], "procedure_month string")
    r = P.month_bounds(df, floor).first()
    present = sorted(m for m in set(months) if m is not None)
    start = next((m for m in present if m >= floor), present[0] if present else None)
    assert (r.min_month, r.max_month) == (start, present[-1] if present else None)


@SETTINGS
@given(rows=st.lists(st.tuples(st.integers(1, 3), st.sampled_from(["d1", "d2"]),
                               st.sampled_from(["S2900", "22612", None])), max_size=15))
def test_robotic_visits_keep_rows_of_visits_with_the_code(spark, rows):
    data = [(p, d, c, i) for i, (p, d, c) in enumerate(rows)]
    df = spark.createDataFrame(data, "patient_id long, service_date string, procedure_code string, "
                                     "medical_event_id long")
    got = sorted(r.medical_event_id for r in P.keep_robotic_visits(df).collect())
    visits = {(p, d) for p, d, c, _ in data if c == "S2900"}
    assert got == sorted(i for p, d, c, i in data if (p, d) in visits)


@SETTINGS
@given(texts=st.lists(st.one_of(st.none(), st.sampled_from(
    ["2023-12-31", "2024-01-01", "2024-02-29", "2024-2-3", " 2024-01-05", "2024-01-05 ", "junk", "2024", "20240105", "2025-01-01"])), max_size=10))
def test_month_range_with_the_text_range_keeps_the_same_rows(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "service_date string")
    df = df.withColumn("procedure_month", month_text(parse_date_strict("service_date")))
    with_text = P.filter_month_range(df, "2024-01", "2024-12")
    without = P.filter_month_range(df, "2024-01", "2024-12", date_text=None)
    assert Counter(map(tuple, with_text.collect())) == Counter(map(tuple, without.collect()))
