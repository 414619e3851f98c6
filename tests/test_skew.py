"""Hot keys: one patient holding over a third of all events."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from claimspark.operators.extract import procedure_adoption
from claimspark.operators.joins import hot_keys, salted_join


def _skewed(spark, n=3000, hot_share=0.4):
    hot_n = int(n * hot_share)
    big = spark.range(n).select(
        F.when(F.col("id") < hot_n, F.lit(1)).otherwise(F.col("id") % 97 + 2).cast("long").alias("patient_id"),
        (F.col("id") % 500).alias("medical_event_id"),  # ids repeat on purpose
        F.lit("22612").alias("procedure_code"),
        F.lit("2024-01-01").alias("service_date"),
        (F.col("id") % 7).alias("rendering_npi"),
    )
    # patient 1 has two dimension rows (fan-out), patient 50 none
    small = spark.range(1, 100).filter("id != 50").select(
        F.col("id").alias("patient_id"), F.lit("F").alias("patient_gender"))
    small = small.unionByName(spark.range(1).select(F.lit(1).cast("long").alias("patient_id"),
                                                    F.lit("M").alias("patient_gender")))
    return big, small


def test_hot_keys_found(spark):
    big, _ = _skewed(spark)
    hk = hot_keys(big, ["patient_id"], rows_per_split=100).collect()
    assert len(hk) == 1 and hk[0].patient_id == 1 and hk[0]["__salts"] == 12


def test_every_hot_key_is_found_and_split(spark):
    big, small = _skewed(spark)
    hot = hot_keys(big, ["patient_id"], rows_per_split=10)
    assert hot.count() == big.groupBy("patient_id").count().filter("count >= 10").count() > 90
    salted = salted_join(big, small, ["patient_id"], ["medical_event_id", "rendering_npi"], hot)
    plain = big.join(small, "patient_id")
    assert salted.select(*plain.columns).exceptAll(plain).count() == 0 and salted.count() == plain.count()


def test_salted_join_equals_plain_join(spark):
    big, small = _skewed(spark)
    plain = big.join(small, "patient_id", "inner")
    salted = salted_join(big, small, ["patient_id"], ["medical_event_id", "rendering_npi"],
                         hot_keys(big, ["patient_id"], rows_per_split=100))
    cols = plain.columns
    assert salted.select(*cols).exceptAll(plain).count() == 0
    assert plain.exceptAll(salted.select(*cols)).count() == 0
    assert salted.count() == plain.count() == 1200 * 2 + (3000 - 1200) - \
        big.filter("patient_id = 50").count()


def test_hot_key_is_spread_over_pieces(spark):
    big, small = _skewed(spark)
    hk = F.broadcast(hot_keys(big, ["patient_id"], rows_per_split=100))
    pieces = (big.join(hk, "patient_id", "left")
                 .withColumn("piece", F.pmod(F.xxhash64("medical_event_id", "rendering_npi"),
                                             F.col("__salts")))
                 .filter("patient_id = 1").groupBy("piece").count().collect())
    assert len(pieces) >= 8  # 12 requested pieces; the hash spreads 1200 rows over most of them
    assert max(r["count"] for r in pieces) < 400


SKEW_CONF = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4KB",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "0",
}


class _conf:
    """Temporarily set session confs (small skew thresholds, no broadcasts)."""

    def __init__(self, spark, conf):
        self.spark, self.conf = spark, conf

    def __enter__(self):
        self.old = {k: self.spark.conf.get(k, None) for k in self.conf}
        for k, v in self.conf.items():
            self.spark.conf.set(k, v)

    def __exit__(self, *exc):
        for k, v in self.old.items():
            if v is None:
                self.spark.conf.unset(k)
            else:
                self.spark.conf.set(k, v)


def _hot_events(spark):
    return spark.range(60000).select(
        F.when(F.col("id") < 25000, F.lit(1)).otherwise(F.col("id") % 500 + 2).cast("long")
        .alias("patient_id"), F.col("id").alias("medical_event_id"))


def test_aqe_splits_a_hot_patient_in_the_cohort_semi_join(spark):
    """With the id set read from files, both semi-join inputs are shuffle
    stages, so adaptive execution splits the hot patient's partition."""
    from claimspark.operators.joins import semi_join
    from claimspark.plans.inspect import plan_text
    from claimspark.plans.session import scratch_path

    with _conf(spark, SKEW_CONF):
        events = _hot_events(spark)
        path = scratch_path(spark, "ids")
        spark.range(1, 100).select(F.col("id").alias("patient_id")).write.parquet(path)
        ids = spark.read.schema("patient_id long").parquet(path)
        df = semi_join(events, ids, ["patient_id"])
        rows = df.collect()  # executes df's own plan, so explain shows its final plan
        assert len(rows) == 25000 + sum(1 for i in range(25000, 60000) if i % 500 + 2 < 100)
        final = plan_text(df).split("== Initial Plan ==")[0]
        assert "isFinalPlan=true" in plan_text(df)
        assert "skew=true" in final


def _star(spark, hot_column):
    """60,000 events of which 25,000 have one value in ``hot_column``, and their dimensions."""
    hot = F.col("id") < 25000
    patient = F.when(hot, F.lit(1)).otherwise(F.col("id") % 300 + 1) if hot_column == "patient_id" else F.col("id") % 300 + 1
    npi = F.when(hot, F.lit(7)).otherwise(F.col("id") % 400) if hot_column == "rendering_npi" else F.col("id") % 400
    events = spark.range(60000).select(
        patient.cast("long").alias("patient_id"), F.col("id").alias("medical_event_id"),
        F.lit("22612").alias("procedure_code"), F.lit("2024-01-01").alias("service_date"),
        F.lit("11").alias("place_of_service"), npi.cast("long").alias("rendering_npi"),
        F.lit(None).cast("string").alias("diagnosis_codes"), (F.col("id") % 3).alias("kh_plan_id"))
    providers = spark.range(400).select(
        F.col("id").alias("npi"), F.lit("A").alias("first_name"), F.lit("S").alias("primary_specialty"),
        F.lit("CA").alias("provider_state"), F.lit("9").alias("provider_zip"))
    demo = spark.range(1, 301).select(F.col("id").alias("patient_id"), F.lit("1980-01-01").alias("patient_yob"),
                                      F.lit("F").alias("patient_gender"))
    geo = spark.range(1, 301).select(F.col("id").alias("patient_id"), F.lit(1).alias("geo_id"))
    plans = spark.range(3).select(F.col("id").alias("kh_plan_id"), F.lit("P").alias("payer_name"),
                                  F.lit("R").alias("parent_name"))
    return events, providers, demo, geo, plans


@pytest.mark.parametrize("column", ["patient_id", "rendering_npi"])
def test_aqe_splits_a_hot_key_in_the_star_join(spark, column):
    """Both inputs of the patient and of the provider join are shuffles of
    their own, so a key with a large share of all events is split."""
    from claimspark.plans.inspect import plan_text

    with _conf(spark, SKEW_CONF):
        df = procedure_adoption(*_star(spark, column))
        assert len(df.collect()) == 60000
        final = plan_text(df).split("== Initial Plan ==")[0]
        assert "skew=true" in final


def test_robotic_events_equal_a_plain_semi_join(spark):
    """Visits from the robotic events alone keep the rows that the app's own
    self-semi-join of the finished extract keeps, under the geography fan-out."""
    from claimspark.operators import procedures as P
    from claimspark.operators.extract import procedure_adoption as star

    rng = random.Random(4)
    for _ in range(4):
        events = spark.createDataFrame(
            [(rng.choice([None, 1, 2, 3, 4, 5]), i, rng.choice(["S2900", "22612", "22630", None]), rng.choice(["d1", "d2", None]), "11",
              rng.choice([None, 7, 8, 9]), None, rng.choice([0, 1, 2, None])) for i in range(120)],
            "patient_id long, medical_event_id long, procedure_code string, service_date string, place_of_service string, "
            "rendering_npi long, diagnosis_codes string, kh_plan_id long")
        providers = spark.createDataFrame([(7, "A", "S", "CA", "9"), (8, "B", "S", "CA", "9")],
                                          "npi long, first_name string, primary_specialty string, provider_state string, provider_zip string")
        demo = spark.createDataFrame([(p, "1980-01-01", "F") for p in (1, 2, 3, 4)], "patient_id long, patient_yob string, patient_gender string")
        geo = spark.createDataFrame([(1, 1), (2, 1), (2, 2), (3, 1), (5, 1)], "patient_id long, geo_id long")
        plans = spark.createDataFrame([(0, "P", "R"), (1, "Q", "R")], "kh_plan_id long, payer_name string, parent_name string")
        whole = star(events, providers, demo, geo, plans)
        want = P.keep_robotic_visits(whole)
        got = star(P.robotic_events(events, providers, plans), providers, demo, geo, plans)
        assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
