"""The reference's workflows, end to end, on the small test tables.

    python examples/workflows.py [sf_dir]

1. procedure adoption: star join -> base -> staging -> marts (written);
2. the analyst app page for one procedure code (filtered once, five frames);
3. provider filtering: new prescribers between two periods, enriched and
   published; events with a modifier, published and exported;
4. a cohort: rule + time range + claim status -> one table per subject area.

Only small results are shown (``show`` of a few rows); all work runs on Spark.
"""

from __future__ import annotations

import os
import sys
from datetime import date, datetime

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from claimspark import sinks  # noqa: E402
from claimspark.functions.labels import CODE_LABELS, code_for_label  # noqa: E402
from claimspark.operators import cohorts as C  # noqa: E402
from claimspark.operators import providers as V  # noqa: E402
from claimspark.operators.extract import procedure_adoption_from  # noqa: E402
from claimspark.plans.session import build_session, scratch_path  # noqa: E402
from claimspark.plans.workflows import (  # noqa: E402
    run_cohort, run_new_prescribers, run_procedure_models, run_procedure_report,
)
from claimspark.sources.fixtures import claims_tables  # noqa: E402


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    spark = build_session("local[4]", app_name="claimspark-examples", shuffle_partitions=8)
    tables = claims_tables(spark, sf_dir)

    # 1. models and marts (dbt: base/staging views, marts tables)
    paths = run_procedure_models(tables, date(2025, 1, 1), scratch_path(spark, "models"))
    spark.read.parquet(paths["mart_plans_breakdown"]).orderBy(F.desc("procedure_volume")).show(5)

    # 2. the app page: the widget values are parameters
    code = code_for_label(CODE_LABELS["22612"])
    page = run_procedure_report(procedure_adoption_from(tables), scratch_path(spark, "report"),
                                code, "1996-01", "1999-12", robotic_only=True,
                                group_by="payer_name")
    page["top_diagnoses"].show(5)
    page["territory_summary"].show(5)

    # 3. provider filtering
    rx = tables.pharmacy_events
    later = V.snapshot(rx, "fill_date", "1998-01-01", "1999-01-01")
    earlier = V.snapshot(rx, "fill_date", "1997-01-01", "1998-01-01")
    name = run_new_prescribers(later, earlier, tables.providers, "unique_hcps_",
                               datetime.now(), path=scratch_path(spark, "hcps"))
    spark.table(name).show(5)
    modified = V.events_with_modifier(tables.medical_events)
    published = sinks.publish(modified, "final_dataset_from_cohort_run_", datetime.now(),
                              path=scratch_path(spark, "published"))
    exported = sinks.export({published: spark.table(published)}, scratch_path(spark, "export"))
    print("exported:", exported)

    # 4. a cohort with every default output area and entity counts
    cohort = C.Cohort(rule=F.col("procedure_code") == "22612",
                      time_ranges=[("1998-01-01", "1998-01-31")],
                      include_rejected_claims=False, count_entities=True,
                      entities_to_count=("patient", "provider"))
    out = run_cohort(spark, C.area_tables(tables), cohort, "EXAMPLE", scratch_path(spark, "cohort"))
    for area, df in out.items():
        print(area, df.count())
    spark.stop()


if __name__ == "__main__":
    main()
