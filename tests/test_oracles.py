"""Every named query against its SQL on the smallest tables.

Numbers may differ in their last rounded digit: a mean that lies exactly
between two values is rounded up by one engine and down by the other.
"""

import datetime as dt
import decimal
import math

import duckdb
import pytest

from auditframe.plans import all_oracles, all_queries
from auditframe.sources.inputs import TABLES

QUERIES, ORACLES = all_queries(), all_oracles()


@pytest.fixture(scope="module")
def con(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, dt.date):
        return dt.datetime(v.year, v.month, v.day).isoformat()
    if isinstance(v, (decimal.Decimal, float)) and not isinstance(v, bool):
        return float(v)
    if isinstance(v, int) and not isinstance(v, bool):
        return float(v)
    return v


def table(rows, columns):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    cells = [[plain(r[k]) for k in order] for r in rows]
    key = lambda r: [(v is None, str(v)) for v in r if not isinstance(v, float)] + [
        (0, f"{v:020.3f}") for v in r if isinstance(v, float)
    ]
    return [columns[k] for k in order], sorted(cells, key=key)


# Sums that are rounded at a digit where a tie may fall either way; all other numbers agree to six digits.
TOLERANCE = {"approx_dbus": 1.01e-4}


def same(column, a, b):
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-6, abs_tol=TOLERANCE.get(column, 2e-6))
    return a == b


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query_matches_sql(spark, con, sf_dir, key):
    df = QUERIES[key](spark, sf_dir)
    columns, rows = table([tuple(r) for r in df.collect()], df.columns)
    if key not in ORACLES:
        assert rows
        return
    cur = con.execute(ORACLES[key])
    want_columns, want = table(cur.fetchall(), [d[0] for d in cur.description])
    assert columns == want_columns
    assert len(rows) == len(want)
    bad = [(r, w) for r, w in zip(rows, want) if not all(same(c, x, y) for c, x, y in zip(columns, r, w))]
    assert not bad, [(c, x, y) for r, w in bad[:3] for c, x, y in zip(columns, r, w) if not same(c, x, y)]
