"""Whole workflows composed from the operators, ending in write actions.

These are the flows of the reference re-expressed as Spark jobs:

* ``run_procedure_models``: star join -> base -> staging -> three marts;
* ``run_procedure_report``: the app's filter panel -> its five result frames, one pass;
* ``run_cohort``: cohort ids -> one written table per subject area;
* ``run_new_prescribers``: EXCEPT of two periods -> enrichment -> publish.

Lineage is cut only by tables written in the shared folder.
Independent writes are submitted as concurrent jobs so the cluster is not idle
while one output's last tasks finish.
"""

from __future__ import annotations

from collections.abc import Mapping
from concurrent.futures import ThreadPoolExecutor
from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession

from claimspark import sinks
from claimspark.operators import cohorts as C
from claimspark.operators import models as M
from claimspark.operators import procedures as P
from claimspark.operators import providers as V
from claimspark.operators.extract import procedure_adoption_from
from claimspark.operators.joins import key_filter
from claimspark.sources.catalog import DatasetCatalog, scan


# A workflow owns the folder that it writes to: run again after a failure, it
# replaces what the failed run has left there.
RUN_MODE = "overwrite"


def write_all(tables: Mapping[str, DataFrame], paths: Mapping[str, str],
              fmt: str = "parquet", max_parallel: int = 8, mode: str = RUN_MODE) -> dict[str, str]:
    """Write several frames as concurrent Spark jobs; name -> path."""
    def one(name: str) -> tuple[str, str]:
        tables[name].write.mode(mode).format(fmt).save(paths[name])
        return name, paths[name]

    with ThreadPoolExecutor(max_workers=max(1, min(max_parallel, len(tables)))) as pool:
        return dict(pool.map(one, list(tables)))


def run_cohort(spark: SparkSession, subjects: Mapping[str, DataFrame], cohort: C.Cohort,
               cohort_id: str, root: str, fmt: str = "parquet") -> dict[str, DataFrame]:
    """K5 with J8: compute the cohort once and write every requested area.

    1. cohort ids: filtered, de-duplicated and written to the shared folder
       (one pass over events);
    2. the medical-events output is written first;
    3. provider and plan keys are read from that written table (small), not
       from the event table again;
    4. the remaining outputs are written concurrently;
    5. with ``count_entities``, entity counts (A14) are taken from the written
       medical events (no further pass over the event table);
    6. the run's manifest is written last; ``sources.catalog.load_run`` reads
       only runs that have one.
    Many ids are also a Bloom filter above each subject table's scan, so rows of
    other patients are not shuffled.
    Returns area -> the written table, read back (schema known, no inference),
    plus ``"entity-counts"`` when requested.
    """
    for area in cohort.outputs:
        if area not in C.SUBJECT_AREAS:
            raise ValueError(f"unknown output area {area!r}")
        if area not in subjects:
            raise KeyError(f"no table bound for output area {area!r}")
    sinks.withdraw_run(spark, root, cohort_id)
    ids = C.materialized_patients(subjects[C.MEDICAL], cohort)
    keep = key_filter(ids, "patient_id")
    names = {a: sinks.cohort_table_name(cohort_id, a) for a in cohort.outputs}
    paths = {a: f"{root.rstrip('/')}/{names[a]}" for a in cohort.outputs}

    med_path = paths.get(C.MEDICAL)
    if med_path is None:
        cohort_medical = C.restrict(C.MEDICAL, subjects[C.MEDICAL], ids, None, keep)
    else:
        C.restrict(C.MEDICAL, subjects[C.MEDICAL], ids, None, keep) \
            .write.mode(RUN_MODE).format(fmt).save(med_path)
        cohort_medical = spark.read.schema(subjects[C.MEDICAL].schema).format(fmt).load(med_path)

    rest = {}
    for area in cohort.outputs:
        if area == C.MEDICAL:
            continue
        rest[area] = C.restrict(area, subjects[area], ids, cohort_medical, keep)
    write_all(rest, {a: paths[a] for a in rest}, fmt)
    if fmt == "parquet":  # rows are counted from footers
        sinks.commit_run(spark, root, cohort_id, paths)
    out = {a: (cohort_medical if a == C.MEDICAL else
               spark.read.schema(rest[a].schema).format(fmt).load(paths[a]))
           for a in cohort.outputs}
    if cohort.count_entities:
        entities = list(cohort.entities_to_count) or list(cohort.entities)
        out["entity-counts"] = C.entity_counts(cohort_medical, entities)
    return out


def run_released_cohort(spark: SparkSession, catalog: DatasetCatalog, cohort: C.Cohort,
                        cohort_id: str, root: str, fmt: str = "parquet") -> dict[str, DataFrame]:
    """K5 by names (F8's data version): the subject tables of the cohort's release from the catalog.

    Every area is resolved before any is read, so an unknown area or release
    raises and nothing is written.
    """
    areas = dict.fromkeys((C.MEDICAL, *cohort.outputs))
    found = catalog.resolve_many(areas, cohort.version)
    return run_cohort(spark, {a: m.read(spark) for a, m in found.items()}, cohort, cohort_id, root, fmt)


def run_procedure_models(tables, as_of: date | None, root: str,
                         fmt: str = "parquet") -> dict[str, str]:
    """Star join -> base -> staging, written once; the marts read the written
    staging table and are written concurrently (dbt: marts are tables)."""
    stg = M.stg_procedure_events(M.base_procedure_events(procedure_adoption_from(tables)), as_of)
    stg_path = f"{root.rstrip('/')}/stg_procedure_events"
    stg.write.mode(RUN_MODE).format(fmt).save(stg_path)
    spark = stg.sparkSession
    written = spark.read.schema(stg.schema).format(fmt).load(stg_path)
    marts = M.all_marts(written)
    paths = {k: f"{root.rstrip('/')}/{k}" for k in marts}
    write_all(marts, paths, fmt)
    return {"stg_procedure_events": stg_path, **paths}


def run_procedure_report(extract: DataFrame, root: str, code: str, month_lo: str, month_hi: str,
                         robotic_only: bool = False, group_by: str = "provider_state",
                         tag: str = "CLAIMS", as_of: date | None = None,
                         top_k: int = P.TOP_K, fmt: str = "parquet") -> dict[str, DataFrame]:
    """The app's page: filter once, then every chart's frame.

    One pass over the filtered events counts all five frames by grouping sets
    (the app re-reads one eager frame for every chart).  Only the counts are
    written below ``root``; the frames read them, so the star join and the
    filters run once per page and no event is stored.
    """
    filtered = P.select_procedures(P.filter_codes(P.prepare(extract, tag, as_of)), code,
                                   month_lo, month_hi, robotic_only)
    aggregates = P.page_aggregates(filtered, group_by)
    path = f"{root.rstrip('/')}/page"
    aggregates.write.mode(RUN_MODE).format(fmt).save(path)
    written = extract.sparkSession.read.schema(aggregates.schema).format(fmt).load(path)
    return P.page_frames(written, group_by, top_k)


def run_unique_keys(spark: SparkSession, catalog: DatasetCatalog, table_1: str, table_2: str,
                    output: str, key: str = "prescriber_npi", path: str | None = None) -> str:
    """E2 then K3: two datasets by name -> the keys of the first alone, registered as ``output``."""
    keys = V.unique_keys(scan(spark, catalog, table_1), scan(spark, catalog, table_2), key)
    return sinks.register_output(keys, output, path=path)


def run_new_prescribers(later: DataFrame, earlier: DataFrame, providers: DataFrame,
                        base_name: str, at: datetime | None = None,
                        path: str | None = None) -> str:
    """E3 then K2: publish the enriched new prescribers; returns the dataset name."""
    return sinks.publish(V.new_prescribers_enriched(later, earlier, providers),
                         base_name, at, path=path)
