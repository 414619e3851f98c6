"""Every query of the claims library against its DuckDB oracle on the sf0.001 tables.

(The round driver runs the same comparison at sf0.01; ``tools/check_oracle.py``
runs it at any scale.)
"""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as E
from claimspark.queries import QUERIES
from claimspark.sources.catalog import TEST_TABLES
from tests.conftest import SF_SMALL
from tools.check_oracle import digest, type_diff


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TEST_TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    yield c
    c.close()


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query_matches_oracle(spark, con, key):
    df = E.queries()[key](spark, SF_SMALL)
    s_cols = df.columns
    s_rows = [tuple(r) for r in df.collect()]
    rel = con.execute(E.oracle_sql()[key])
    o_cols = [d[0] for d in rel.description]
    o_rows = rel.fetchall()
    assert sorted(s_cols) == sorted(o_cols)
    assert not type_diff(df.schema, rel.description)
    assert len(s_rows) == len(o_rows)
    assert digest(s_cols, s_rows)[0] == digest(o_cols, o_rows)[0]
