"""Corpus queries next to their SQL, and whole row counts for the others."""

import pytest
from compare import connect, difference

from redpen.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", [n for n, (_, sql) in QUERIES.items() if sql])
def test_against_sql(spark, name):
    query, sql = QUERIES[name]
    assert difference(query(spark, SF), connect(SF), sql) is None
