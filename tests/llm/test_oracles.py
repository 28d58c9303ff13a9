"""Queries with check SQL, compared value by value on the smallest tables."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(__file__), "..", "..", "tools"))

import check  # noqa: E402

from harborlight.llm import queries  # noqa: E402

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query(spark, con, name):
    df = queries.QUERIES[name](spark, FOLDER)
    cur = con.execute(queries.ORACLES[name])
    assert check.type_notes(df, cur) == ""
    got = check.table(df.columns, df.collect())
    want = check.table([d[0] for d in cur.description], cur.fetchall())
    assert got == want
    assert got[1]
