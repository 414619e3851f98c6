"""Sinks (K1-K6): CSV extract, publish, register, export, cohort outputs, models.

Every sink is a distributed write through Spark's commit protocol: task
attempts write to temporary files and only committed tasks become visible, so
a lost executor causes a retried task, not a torn table.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Mapping
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession

from claimspark.functions.names import dataset_suffix
from claimspark.plans.session import delete_path, subfolders
from claimspark.sources.catalog import MANIFEST_SCHEMA, DatasetCatalog, footer_row_counts, manifest_path
from claimspark.sources.files import CSV_DIALECT


# Rows in one CSV file at most: a file whose values may hold line breaks is read
# by one task, so its size has to stay bounded.  No row is left out.
CSV_ROWS_PER_FILE = 1_000_000


def write_extract_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> str:
    """K1: write the extract as header CSV (no index column).

    Values come back as they were: surrounding blanks are kept, quotes are
    doubled inside a quoted value (as other readers expect) and line breaks stay
    inside quotes.  CSV has one empty value: an empty text comes back as null.
    """
    (df.write.mode(mode).options(**CSV_DIALECT)
     .option("maxRecordsPerFile", CSV_ROWS_PER_FILE).csv(path))
    return path


def _save_table(df: DataFrame, name: str, mode: str, path: str | None, fmt: str) -> None:
    writer = df.write.mode(mode).format(fmt)
    if path is not None:
        writer = writer.option("path", path)
    writer.saveAsTable(name)


def publish(df: DataFrame, base: str, at: datetime | None = None,
            path: str | None = None, fmt: str = "parquet") -> str:
    """K2: save ``df`` as a new named dataset ``base + YYYYmmdd_HHMMSS``.

    Never replaces an existing dataset (``errorifexists``).  ``path`` puts the
    data in a chosen (shared) location; otherwise the warehouse is used.
    """
    name = base + dataset_suffix(at or datetime.now())
    _save_table(df, name, "errorifexists", path, fmt)
    return name


def register_output(df: DataFrame, name: str, path: str | None = None,
                    fmt: str = "parquet", keep: int = 1) -> str:
    """K3: register an analytic's output under a fixed name (replaced on re-run).

    Every run writes a version of its own below ``path`` (default: the
    warehouse), and only when that is whole the view ``name`` is pointed at it,
    in one catalog change: a reader sees all old rows or all new ones, and a
    failed run leaves the old ones.  The last ``keep`` replaced versions stay
    for readers that have begun; older ones are removed.
    """
    spark = df.sparkSession
    root = (path or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/{name}__versions").rstrip("/")
    version = f"version-{datetime.now(timezone.utc):%Y%m%dT%H%M%S%f}-{uuid.uuid4().hex[:8]}"
    earlier = sorted(x for x in subfolders(spark, root) if x.startswith("version-"))
    df.write.mode("errorifexists").format(fmt).save(f"{root}/{version}")
    if spark.catalog.tableExists(name) and spark.catalog.getTable(name).tableType != "VIEW":
        spark.sql(f"DROP TABLE {name}")  # registered as a table by an earlier release of this library
    spark.sql(f"CREATE OR REPLACE VIEW {name} AS SELECT * FROM {fmt}.`{root}/{version}`")
    for old in earlier[:max(0, len(earlier) - keep)]:
        delete_path(spark, f"{root}/{old}")
    return name


def export(tables: Mapping[str, DataFrame], root: str, fmt: str = "parquet",
           mode: str = "errorifexists") -> dict[str, str]:
    """K4: write each dataset to ``root/<name>`` (``s3a://...`` or any Hadoop path).

    The full frames are exported, never a preview.
    """
    out = {}
    for name, df in tables.items():
        target = f"{root.rstrip('/')}/{name}"
        df.write.mode(mode).format(fmt).save(target)
        out[name] = target
    return out


def export_datasets(spark: SparkSession, catalog: DatasetCatalog, names: Iterable[str], root: str,
                    fmt: str = "parquet", mode: str = "errorifexists") -> dict[str, str]:
    """K4 by dataset name; an unknown name raises before anything is written."""
    return export({n: m.read(spark) for n, m in catalog.resolve_many(names).items()}, root, fmt, mode)


def cohort_table_name(cohort_id: str, area: str, index: int = 0) -> str:
    """Name of one cohort output, e.g. ``COHORT_RUN_<ID>_0_CLAIMS_MEDICAL_EVENTS``."""
    return f"COHORT_RUN_{cohort_id}_{index}_{area.upper().replace('-', '_')}".upper()


def commit_run(spark: SparkSession, root: str, cohort_id: str, paths: Mapping[str, str]) -> DataFrame:
    """K5: the run's manifest, written last: each area's table, path and rows.

    Until it is there, ``load_run`` refuses the run.  Rows come from the written
    files' footers.
    """
    counts = {r.table_type: r.row_count for r in footer_row_counts(spark, paths).collect()}  # one row per area
    rows = [(area, cohort_table_name(cohort_id, area), paths[area], counts[area]) for area in paths]
    manifest = spark.createDataFrame(rows, MANIFEST_SCHEMA)
    manifest.coalesce(1).write.mode("errorifexists").parquet(manifest_path(root, cohort_id))
    return manifest


def withdraw_run(spark: SparkSession, root: str, cohort_id: str) -> None:
    """Take a run's manifest away before its tables are written anew."""
    delete_path(spark, manifest_path(root, cohort_id))


def write_layout(df: DataFrame, name: str, key: str, buckets: int, partition_by: str | None = None,
                 path: str | None = None, fmt: str = "parquet") -> DataFrame:
    """A table in ``buckets`` buckets of ``key``, sorted by it, and in folders of ``partition_by``.

    Tables of one ``key`` type and bucket number join on it without an exchange, and a
    join on ``partition_by`` reads only the folders that the other side names.
    Rows are rebalanced by key first, which keeps files few and lets adaptive
    execution split a hot key.
    """
    writer = df.hint("rebalance", key).write.mode("overwrite").format(fmt).bucketBy(buckets, key).sortBy(key)
    if partition_by is not None:
        writer = writer.partitionBy(partition_by)
    if path is not None:
        writer = writer.option("path", path)
    writer.saveAsTable(name)
    return df.sparkSession.table(name)


def materialize(df: DataFrame, name: str, kind: str = "view",
                path: str | None = None, fmt: str = "parquet") -> DataFrame:
    """K6: a model as a (temporary) view or a saved table; returns the read-back."""
    spark: SparkSession = df.sparkSession
    if kind == "view":
        df.createOrReplaceTempView(name)
    elif kind == "table":
        _save_table(df, name, "overwrite", path, fmt)
    else:
        raise ValueError(f"kind must be 'view' or 'table', not {kind!r}")
    return spark.table(name)
