"""Every registered query against its DuckDB oracle at sf0.01 (the driver's
correctness gate), plus the smoke entry at sf0.001."""

import pytest

import __spark_entry__ as E
import check_oracle as C
from tests.conftest import SF001, SF01

# The optional training-data queries have tests of their own.
QUERIES = {k: v for k, v in E.queries().items() if k not in E.EXTRA_QUERIES}
SQL = {k: v for k, v in E.oracle_sql().items() if k not in E.EXTRA_QUERIES}


@pytest.fixture(scope="module")
def duck():
    return C.duck(SF01)


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns == ["id", "judul", "deskripsi", "deadline", "created_at", "file_path", "created_by",
                          "kelas", "jumlah_kumpul", "jumlah_siswa"]
    assert SF001.endswith("sf0.001")


def test_every_query_has_oracle_or_is_documented():
    assert set(SQL) == set(QUERIES)
    assert len(QUERIES) >= 70


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF01)
    got = [tuple(r) for r in df.collect()]
    cur = duck.execute(SQL[name])
    dcols = [d[0] for d in cur.description]
    want = cur.fetchall()
    assert sorted(df.columns) == sorted(dcols)
    assert len(got) == len(want)
    assert C.digest(df.columns, got)[0] == C.digest(dcols, want)[0]
