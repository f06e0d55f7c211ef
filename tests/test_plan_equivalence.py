"""The roster expansions (missing lists, student cards) on duplicate rows."""

from kelasflow.operators import progress
from kelasflow.sources.catalog import from_rows
from tests.conftest import ts
from tests.test_edge_cases import school


def with_dups(spark):
    t = school(spark)
    extra = dict(pengumpulan_tugas=[(1, 500, 1, "a", 90, ts(2024, 3, 2)), (2, 500, 1, "b", None, ts(2024, 3, 3)),
                                    (3, 500, 2, "c", None, ts(2024, 3, 3)), (4, 501, None, "d", None, ts(2024, 3, 3)),
                                    (5, 503, 3, "e", 70, ts(2024, 3, 3)), (6, 502, 1, "f", 10, ts(2024, 3, 3))])
    return t.replace(pengumpulan_tugas=from_rows(spark, **extra).pengumpulan_tugas)


def test_multi_class_student_gets_one_row_per_class(spark):
    t = with_dups(spark)
    got = [(r.id, r.nama_kelas, r.nilai) for r in progress.student_assignments(t).where("siswa_id = 2").collect()]
    assert sorted(got, key=repr) == sorted([(500, "XII A", None), (500, "XII B", None), (501, "XII A", None),
                                            (503, "XII B", None)], key=repr)
