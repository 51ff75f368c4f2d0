"""Every registered query with SQL must give the same rows as that SQL on the smallest tables."""
import os

import pytest

import __spark_entry__ as entry
from check import canon, compare, connect

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = [tuple(canon(r[c]) for c in cols) for r in df.collect()]
    cur = connect(SF).execute(SQL[name])
    desc = [d[0] for d in cur.description]
    assert sorted(desc) == cols
    pos = [desc.index(c) for c in cols]
    assert compare(got, [tuple(canon(r[p]) for p in pos) for r in cur.fetchall()]) is None


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(SQL) <= set(QUERIES)
