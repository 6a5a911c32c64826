"""Every query with a SQL oracle matches DuckDB on the smallest driver tables
(order-insensitive, columns sorted by name) — the driver's gate, run locally."""

import os

import duckdb
import pytest

from conftest import SF_SMALL

import __spark_entry__ as E  # noqa: E402
from tools.oracle_check import TABLES, digest  # noqa: E402

QUERIES = E.queries()
ORACLE = E.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        p = os.path.join(SF_SMALL, f"{t}.parquet")
        if os.path.exists(p):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_oracle(spark, con, name):
    df = QUERIES[name](spark, SF_SMALL)
    rows = [tuple(r) for r in df.collect()]
    cur = con.execute(ORACLE[name])
    ocols = [d[0] for d in cur.description]
    orows = cur.fetchall()
    h1, c1, _ = digest(df.columns, rows)
    h2, c2, _ = digest(ocols, orows)
    assert c1 == c2
    assert len(rows) == len(orows)
    assert h1 == h2


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


def test_entry_runs(spark):
    df = E.entry(spark)
    assert set(df.columns) >= {"config_id", "peak_shaving_benefit", "trading_revenue"}
    assert df.count() > 0
