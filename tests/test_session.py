"""Session helpers: partition sizing and the shared folder."""

from __future__ import annotations

from claimspark.plans.session import (
    recommended_shuffle_partitions, save, scratch_path, scratch_scope, shared_root,
)

MB = 1024 * 1024


def test_partitions_follow_input_size_within_bounds():
    assert recommended_shuffle_partitions(40 * MB, 8) == 16           # at least two per core
    assert recommended_shuffle_partitions(1024 * 1024 * MB, 8) == 8192  # ~128 MB per partition
    assert recommended_shuffle_partitions(100 * 1024 ** 4, 8000) == 819_200  # no cap at ~100 TB


def test_scratch_paths_are_unique_and_shared(spark):
    a, b = scratch_path(spark, "x"), scratch_path(spark, "x")
    assert a != b and a.startswith(shared_root(spark)) and b.startswith(shared_root(spark))


def test_scratch_scope_removes_what_it_wrote(spark):
    import os
    from urllib.parse import urlparse

    with scratch_scope(spark):
        df = save(spark.range(5), "scope")
        path = urlparse(df.inputFiles()[0]).path
        assert df.count() == 5 and os.path.exists(path)
    assert not os.path.exists(path)
