from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"
SF_ORACLE = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from claimspark.plans.session import build_session

    warehouse = tmp_path_factory.mktemp("warehouse")
    s = build_session(
        "local[4]", app_name="claimspark-tests", shuffle_partitions=8,
        extra={"spark.sql.warehouse.dir": str(warehouse)},
    )
    if not s.conf.get("spark.checkpoint.dir", None):
        # nothing names a shared folder here: use our own (tests only)
        s.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("ckpt")))
    yield s
    s.stop()


@pytest.fixture(scope="session")
def tables(spark):
    from claimspark.sources.fixtures import claims_tables

    return claims_tables(spark, SF_SMALL)


def rows(df, order=None):
    """Collect a small test frame as sorted tuples."""
    out = [tuple(r) for r in df.collect()]
    return sorted(out, key=lambda t: tuple((v is None, str(v)) for v in t)) if order is None else out
