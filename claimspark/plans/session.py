"""Session settings and the shared folder used for lineage cuts and scratch output.

The library never creates a session inside an operator.  ``build_session`` is a
convenience for scripts, benches and tests; on a cluster the caller's session is
used as is, and every setting below is only a sensible default.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Defaults chosen for the claims workload: adaptive execution on so that
# (a) dimension joins become broadcast joins only after their real, measured
# size is known to be under the threshold, (b) skewed join partitions (one
# provider or one patient holding a large share of all events) are split, and
# (c) the post-shuffle partition count follows the data volume.
SESSION_DEFAULTS: dict[str, str] = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "128MB",
    # split a skewed join partition even when that costs an extra shuffle
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128MB",
    # Static (file-statistics) and runtime (measured shuffle size) broadcast
    # limits.  Anything larger is joined with a shuffle instead.
    "spark.sql.autoBroadcastJoinThreshold": "32MB",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "32MB",
    # A sort-merge join whose post-shuffle partitions are all under this size
    # runs as a shuffled hash join (no sort); larger ones stay sort-merge,
    # which can spill.
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64MB",
    "spark.sql.files.maxPartitionBytes": "128MB",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
}


def recommended_shuffle_partitions(input_bytes: int, cores: int,
                                   target_bytes: int = 128 * 1024 * 1024) -> int:
    """Initial shuffle partition count: about one ``target_bytes`` slice of
    input per partition, at least two per core.  Adaptive execution then
    coalesces small post-shuffle partitions and splits skewed ones, so this
    only has to be large enough that no partition spills badly.
    """
    return max(2 * cores, -(-input_bytes // target_bytes))


def build_session(
    master: str | None = None,
    app_name: str = "claimspark",
    shuffle_partitions: int | None = None,
    extra: dict[str, str] | None = None,
) -> SparkSession:
    """Create (or reuse) a session with the library defaults applied."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(SESSION_DEFAULTS)
    if shuffle_partitions is not None:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    if extra:
        conf.update(extra)
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_root(spark: SparkSession) -> str:
    """The folder, seen by the driver and every executor, for written tables.

    ``spark.checkpoint.dir`` names it.  Where that is unset, the session's
    warehouse is used: it is the other place that a deployment has to share
    between all machines.  A machine-local temporary folder is never chosen.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"


_SCRATCH: list[str] = []


def scratch_path(spark: SparkSession, kind: str) -> str:
    """A fresh, unique path below the shared folder for a written table.

    The path is remembered; ``release_scratch`` removes what was written.
    """
    path = f"{shared_root(spark)}/claimspark-scratch/{kind}-{uuid.uuid4().hex[:12]}"
    _SCRATCH.append(path)
    return path


def save(df: DataFrame, kind: str) -> DataFrame:
    """Cut the lineage: write ``df`` below the shared folder and read it back."""
    spark = df.sparkSession
    path = scratch_path(spark, kind)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """The shuffle files of each action inside go at its end, not when the driver next collects its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def save_and_free(df: DataFrame, kind: str) -> DataFrame:
    """As ``save``; the shuffle files of the write go at its end."""
    with shuffles_freed(df.sparkSession):
        return save(df, kind)


def delete_path(spark: SparkSession, path: str) -> None:
    """Remove a folder through Spark's own file system layer."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def subfolders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders right below ``path``; none if it is not there."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(hadoop):
        return []
    return [x.getPath().getName() for x in fs.listStatus(hadoop) if x.isDirectory()]


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Remove every scratch table made inside the block when it ends.

    Frames returned by lazy operators read their scratch tables, so consume
    (write or collect) them inside the block.
    """
    start = len(_SCRATCH)
    try:
        yield
    finally:
        release_scratch(spark, start)


def release_scratch(spark: SparkSession, start: int = 0) -> None:
    """Remove the scratch tables made since ``start`` (all of them by default)."""
    while len(_SCRATCH) > start:
        delete_path(spark, _SCRATCH.pop())


def byte_setting(spark: SparkSession, key: str) -> int:
    """A size setting (``32MB``, ``10485760b``, ``-1``) in bytes."""
    value = spark.conf.get(key)
    return -1 if value.startswith("-") else spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(value)


def unique_suffix() -> str:
    return f"{os.getpid()}_{uuid.uuid4().hex[:8]}"
