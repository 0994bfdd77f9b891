"""Operators that SQL can express, over odd documents and over empty tables."""

import pytest

from codescope.llm import queries as Q
from tests.llm.conftest import sql_rows, tidy


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_odd_documents_match_sql(spark, odd_dir, name):
    df = Q.QUERIES[name](spark, odd_dir)
    cols = sorted(df.columns)
    assert tidy(tuple(r[c] for c in cols) for r in df.collect()) == sql_rows(odd_dir, name, cols)


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_empty_tables(spark, empty_dir, name):
    rows = Q.QUERIES[name](spark, empty_dir).collect()
    assert [r.conv_id for r in rows] == ([-7] if name.startswith("op1_") else [])
