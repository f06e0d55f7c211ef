"""Student assignments (both plans) against brute force of the reference's
query, run for every (student, class) pair: duplicate submissions repeat
rows, students in two classes see both, missing authors drop rows."""

from hypothesis import given, settings
from hypothesis import strategies as st

from kelasflow.operators import progress
from kelasflow.sources.catalog import from_rows
from tests.conftest import ts

details = st.lists(st.tuples(st.integers(1, 5), st.sampled_from([1, 2, 3, None])), max_size=8)
bridge = st.lists(st.tuples(st.integers(100, 103), st.sampled_from([1, 2, 3])), max_size=8)
subs = st.lists(st.tuples(st.integers(100, 103), st.integers(1, 6), st.one_of(st.none(), st.integers(0, 100))),
                max_size=8)
AUTHOR = {100: 9, 101: 9, 102: 8, 103: 7}            # author 7 does not exist


def brute(det, br, sb):
    kelas = {1: "K1", 2: "K2"}
    out = []
    for u, k in {(u, k) for u, k in det if k is not None}:
        for t, bk in br:
            if bk != k or bk not in kelas or AUTHOR[t] == 7:
                continue
            mine = [(n, f"f{i}") for i, (tt, su, n) in enumerate(sb) if tt == t and su == u]
            for n, f in (mine or [(None, None)]):
                out.append((u, t, f"G{AUTHOR[t]}", kelas[k], n, f))
    return sorted(out, key=repr)


@settings(max_examples=6, deadline=None)
@given(details, bridge, subs)
def test_student_assignments_match_brute_force(spark, det, br, sb):
    t = from_rows(
        spark,
        users=[(9, "G9", "g9@x", "guru", None, ts(2024, 1, 1)), (8, "G8", "g8@x", "guru", None, ts(2024, 1, 1))],
        kelas=[(1, "K1"), (2, "K2")],
        siswa_details=[(i, u, "J", f"n{i}", k) for i, (u, k) in enumerate(det)],
        tugas=[(t, f"T{t}", "d", None, "f", a, ts(2024, 1, 1)) for t, a in AUTHOR.items()],
        tugas_kelas=list(br),
        pengumpulan_tugas=[(i, tt, u, f"f{i}", n, ts(2024, 1, 2)) for i, (tt, u, n) in enumerate(sb)],
    )
    got = sorted((tuple(r) for r in progress.student_assignments(t)
                  .select("siswa_id", "id", "guru", "nama_kelas", "nilai", "file_kumpul").collect()), key=repr)
    assert got == brute(det, br, sb)
