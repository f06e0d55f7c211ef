"""Per-student and per-teacher statistics against brute force."""

from hypothesis import given, settings
from hypothesis import strategies as st

from kelasflow.operators import courses, progress
from kelasflow.sources.catalog import from_rows
from tests.conftest import ts

det = st.lists(st.tuples(st.integers(1, 4), st.sampled_from([1, 2, 3, None])), max_size=8)
pairs = st.lists(st.tuples(st.integers(100, 104), st.sampled_from([1, 2, 3, 9])), max_size=8)
subs = st.lists(st.tuples(st.integers(100, 105), st.integers(1, 5), st.one_of(st.none(), st.integers(0, 100))),
                max_size=8)


@settings(max_examples=6, deadline=None)
@given(det, pairs, subs)
def test_student_stats_brute_force(spark, d, tk, sb):
    t = from_rows(
        spark,
        users=[(u, f"U{u}", f"u{u}@x", "siswa", None, ts(2024, 1, 1)) for u in range(1, 5)],
        siswa_details=[(i, u, "J", f"n{i}", k) for i, (u, k) in enumerate(d)],
        tugas=[(t, f"T{t}", "d", None, "f", 9, ts(2024, 1, 1)) for t in range(100, 104)],   # 104 missing
        tugas_kelas=list(tk),
        pengumpulan_tugas=[(i, tt, u, "f", n, ts(2024, 1, 2)) for i, (tt, u, n) in enumerate(sb)],
    )
    got = {r.siswa_id: (r.total, r.completed, r.pending) for r in progress.student_assignment_stats(t).collect()}
    want = {}
    for u in range(1, 5):
        total = sum(1 for du, k in d if du == u for tt, kk in tk if kk == k and tt < 104)
        mine = [n for _, su, n in sb if su == u]
        want[u] = (total, sum(n is not None for n in mine), total - len(mine))
    assert got == want


courses_st = st.lists(st.tuples(st.sampled_from([10, 11, 12, None])), max_size=6)
links = st.lists(st.tuples(st.integers(0, 5), st.sampled_from([1, 2, 3, 9])), max_size=10)


@settings(max_examples=6, deadline=None)
@given(det, courses_st, links)
def test_teacher_dashboard_brute_force(spark, d, cs, ln):
    t = from_rows(
        spark,
        users=[(g, f"G{g}", f"g{g}@x", "guru", None, ts(2024, 1, 1)) for g in (10, 11)],
        siswa_details=[(i, u, "J", f"n{i}", k) for i, (u, k) in enumerate(d)],
        courses=[(c, f"C{c}", "d", a, ts(2024, 1, 1), "f") for c, (a,) in enumerate(cs)],
        course_kelas=[(i, c, k) for i, (c, k) in enumerate(ln)],
    )
    got = {r.guru_id: (r.total_mapel, r.total_siswa) for r in courses.teacher_dashboard(t).collect()}
    want = {}
    for g in (10, 11):
        mine = {c for c, (a,) in enumerate(cs) if a == g}
        ks = {k for c, k in ln if c in mine}
        want[g] = (len(mine), sum(1 for _, k in d if k in ks))
    assert got == want
