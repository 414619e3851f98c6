"""Named datasets (S1) and loading a cohort's output tables by name.

A dataset is an opaque name resolved to one or more physical manifestations
(a catalog table name or a file path).  Like the platform lookup it mirrors,
the first manifestation wins.  A missing name raises a clear error instead of
returning an unbound value.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimspark.functions.names import table_type

# Tables of the driver-generated test data (one parquet file each).
TEST_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels",
    "conversations",
)


def read_parquet(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A parquet table as it is now; a caller who knows the schema spares the
    small job that infers it."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


@dataclass(frozen=True)
class Manifestation:
    """One physical copy of a dataset: a catalog table or a file location."""

    location: str
    format: str = "table"  # "table", "parquet", "csv", ...

    def read(self, spark: SparkSession) -> DataFrame:
        if self.format == "table":
            return spark.table(self.location)
        if self.format == "parquet":
            return read_parquet(spark, self.location)
        return spark.read.format(self.format).load(self.location)


@dataclass
class DatasetCatalog:
    """(dataset name, data release) -> ordered manifestations.

    A dataset without releases is registered under ``None``, which answers for
    any release; a name that has releases only answers for those.
    """

    entries: dict[tuple[str, str | None], list[Manifestation]] = field(default_factory=dict)

    def register(self, name: str, *manifestations: Manifestation, release: str | None = None) -> "DatasetCatalog":
        self.entries.setdefault((name, release), []).extend(manifestations)
        return self

    def releases(self, name: str) -> list[str]:
        return sorted(r for n, r in self.entries if n == name and r is not None)

    def resolve(self, name: str, release: str | None = None) -> Manifestation:
        """The first manifestation; an unknown name or release raises before anything is read."""
        found = self.entries.get((name, release)) or self.entries.get((name, None))
        if found:
            return found[0]
        have = self.releases(name)
        if not have:
            raise KeyError(f"dataset {name!r} is not in the catalog")
        raise KeyError(f"dataset {name!r} has no data release {release!r}; have {have}")

    def resolve_many(self, names: Iterable[str], release: str | None = None) -> dict[str, Manifestation]:
        return {n: self.resolve(n, release) for n in names}


def sf_catalog(sf_dir: str) -> DatasetCatalog:
    cat = DatasetCatalog()
    for t in TEST_TABLES:
        cat.register(t, Manifestation(f"{sf_dir.rstrip('/')}/{t}.parquet", "parquet"))
    return cat


def scan(spark: SparkSession, catalog: DatasetCatalog, name: str, release: str | None = None) -> DataFrame:
    """Full scan of a named dataset (lazy; columns are pruned by Catalyst)."""
    return catalog.resolve(name, release).read(spark)


def load_outputs(spark: SparkSession, table_names: Iterable[str]) -> dict[str, DataFrame]:
    """Load every output table of a cohort keyed by its table type.

    The key is the last two ``_`` parts of the name; on a clash the later
    table wins, as in the workflow this mirrors.
    """
    out: dict[str, DataFrame] = {}
    for name in table_names:
        out[table_type(name)] = spark.table(name)
    return out


MANIFEST_SCHEMA = "area string, table_name string, path string, row_count long"


class IncompleteRun(RuntimeError):
    """A cohort run whose tables are not known to be whole."""


def manifest_path(root: str, cohort_id: str) -> str:
    return f"{root.rstrip('/')}/COHORT_RUN_{cohort_id.upper()}_MANIFEST"


def load_run(spark: SparkSession, root: str, cohort_id: str, fmt: str = "parquet") -> dict[str, DataFrame]:
    """S2 for a run of ``run_cohort``: area -> table, only if the run is whole.

    The manifest is written last, so a run without one is not read; each
    table's rows are counted from its footers and held against the manifest.
    """
    try:
        rows = spark.read.schema(MANIFEST_SCHEMA).parquet(manifest_path(root, cohort_id)).collect()  # one row per area
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = []
    if not rows:
        raise IncompleteRun(f"cohort run {cohort_id!r} below {root!r} has no manifest: it has not ended")
    have = {r.table_type: r.row_count for r in footer_row_counts(spark, {r.area: r.path for r in rows}).collect()}
    torn = sorted(r.area for r in rows if have[r.area] != r.row_count)
    if torn:
        raise IncompleteRun(f"cohort run {cohort_id!r}: other rows than its manifest has in {torn}")
    return {r.area: spark.read.format(fmt).load(r.path) for r in rows}


def row_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """One row per table with its row and column count, in one job.

    Each table contributes a global ``count(*)`` (partial counts per task,
    one row per table reaches the final stage); the union is tiny.
    """
    parts = [
        df.agg(F.count(F.lit(1)).alias("row_count")).select(
            F.lit(key).alias("table_type"),
            F.col("row_count"),
            F.lit(len(df.columns)).alias("column_count"),
        )
        for key, df in tables.items()
    ]
    if not parts:
        raise ValueError("no tables to count")
    result = parts[0]
    for p in parts[1:]:
        result = result.unionByName(p)
    return result


# What makes Spark answer a count from the file footers: its second Parquet source with aggregate push-down.
FOOTER_SETTINGS = {"spark.sql.sources.useV1SourceList": "", "spark.sql.parquet.aggregatePushdown": "true"}


def footer_row_counts(spark: SparkSession, paths: Mapping[str, str]) -> DataFrame:
    """A13 for written Parquet tables: rows and columns of each, from footers alone.

    ``count(*)`` is pushed into the Parquet scan, which reads no data page.  The
    frame belongs to a session of its own with that source switched on, so the
    caller's settings stay as they are.
    """
    own = spark.newSession()
    for key, value in FOOTER_SETTINGS.items():
        own.conf.set(key, value)
    return row_counts({name: own.read.parquet(path) for name, path in paths.items()})
