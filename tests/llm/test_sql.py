"""The queries that SQL can express, against their DuckDB text at sf0.01."""

import pytest

import check_oracle as C
from kelasflow.llm.queries import ORACLE_SQL, QUERIES
from tests.conftest import SF01


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, name):
    df = QUERIES[name](spark, SF01)
    cur = C.duck(SF01).execute(ORACLE_SQL[name])
    columns = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(columns)
    assert C.digest(df.columns, [tuple(r) for r in df.collect()]) == C.digest(columns, cur.fetchall())
