"""Incremental refresh: each run appends only the newly arrived event files."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimspark.plans.session import scratch_path
from claimspark.streaming.refresh import event_stream, refresh_modifier_dataset, run_to_completion


def test_refresh_appends_only_new_files_exactly_once(spark, tables):
    events = tables.medical_events
    root = scratch_path(spark, "refresh-test")
    incoming, target, ckpt = f"{root}/incoming", f"{root}/published", f"{root}/_checkpoint"
    first = events.filter(F.col("patient_id") % 2 == 0)
    second = events.filter(F.col("patient_id") % 2 == 1)

    def run():
        stream = event_stream(spark, incoming, events.schema, max_files_per_trigger=2)
        run_to_completion(refresh_modifier_dataset(stream, target, ckpt))
        return spark.read.schema(events.schema).parquet(target)

    first.write.mode("append").parquet(incoming)
    assert run().count() == first.filter(F.col("modifiers").isNotNull()).count()

    second.write.mode("append").parquet(incoming)
    out = run()
    assert out.count() == events.filter(F.col("modifiers").isNotNull()).count() == 4032
    assert out.exceptAll(events.filter(F.col("modifiers").isNotNull())).count() == 0

    assert run().count() == 4032  # nothing new: nothing appended
