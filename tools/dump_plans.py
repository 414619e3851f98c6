"""Write PLANS.md: the physical operator tree of every registered query.

Usage: python tools/dump_plans.py [sf_dir] > PLANS.md

Sink queries write their output while being defined (that is their point),
so their tree is the read-back plan.
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from claimspark.plans.inspect import plan_text  # noqa: E402
from claimspark.plans.session import build_session  # noqa: E402
from claimspark.queries import QUERIES  # noqa: E402


GUIDE = """How to read these plans at scale:

- **Fixture layer.** Every claims table is a projection of the test tables. Order lines join their
  orders with a sort-merge join (`merge` hint: both are fact-sized). Nation/region/supplier lookups
  are broadcast by the planner because they are small. On real data these are base tables, and the
  plans start at the scans.
- **Static estimates of joined dimensions.** Without CBO, Spark estimates an inner join's size as
  the product of its inputs, so dimensions built by a join (providers, the patient dimension) show up
  as sort-merge joins here. At run time AQE measures the shuffle output and turns them into broadcast
  joins when the measured size is under the threshold.
- **Star join** (`procedure_adoption` and everything built on it): plans and providers are broadcast
  when small; the event table is read once and shuffled once on `patient_id` against the patient
  dimension (demographics ⋈ geography), which is written first and read back. Both inputs are then
  shuffles of their own, which AQE can split on a hot patient.
- **Aggregates** always show `HashAggregate` → `Exchange` → `HashAggregate`: a partial aggregate per
  task runs before every shuffle.
- **Top-k and previews** end in `TakeOrderedAndProject`: a per-task top-k plus a small merge, no
  global sort.
- **EXCEPT** (`new_prescribers`, `unique_hcps_reverse`): each side is de-duplicated before its
  first exchange. The null-safe anti-join then runs on `(coalesce(k, 0), isnull(k))`.
- **Robotic visits** (`robotic_procedures`): the visit keys come from the robotic events alone and
  are written first; the raw events are semi-joined with them before the star join.
- **Cohort queries** write the id set first, so their semi-joins read it back from files. Both
  inputs are then shuffle stages, which AQE can split on a hot patient. The trees shown are the
  read-back plans.
"""


def summary(plan: str) -> tuple[str, list[str]]:
    tree = plan.split("\n\n")[0]
    notes = []
    for m in re.finditer(r"\((\d+)\) Scan parquet[^\n]*\n(?:[^\n]*\n){0,3}"
                         r"PushedFilters: ([^\n]*)\nReadSchema: ([^\n]*)", plan):
        notes.append(f"scan ({m.group(1)}): pushed {m.group(2)}; reads {m.group(3)}")
    return tree, notes


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = build_session("local[8]", shuffle_partitions=16)
    print("# Physical plans\n")
    print(f"Generated by `tools/dump_plans.py` at `{sf_dir}` (initial adaptive plans: AQE may still "
          "turn a sort-merge join into a broadcast join or split a skewed partition at run time).\n")
    print(GUIDE)
    for key, q in QUERIES.items():
        tree, notes = summary(plan_text(q(spark, sf_dir)))
        print(f"## {key}\n\n```\n{tree.strip()}\n```\n")
        for n in notes:
            print(f"- {n}")
        print()
    spark.stop()


if __name__ == "__main__":
    main()
