"""Assignment progress against brute force on random memberships: students
in several classes, duplicate detail rows, NULL classes, unknown classes,
duplicate bridge rows and submissions from anyone."""

from hypothesis import given, settings
from hypothesis import strategies as st

from kelasflow.operators import progress
from kelasflow.sources.catalog import from_rows
from tests.conftest import ts

CLASSES = [1, 2, 3, 4]                    # 4 is not in the class table
details = st.lists(st.tuples(st.integers(1, 6), st.sampled_from(CLASSES + [None])), max_size=12)
bridge = st.lists(st.tuples(st.integers(100, 104), st.sampled_from(CLASSES)), max_size=10)
subs = st.lists(st.tuples(st.integers(100, 105), st.integers(1, 8)), max_size=10)


def brute(det, br, sb):
    known = {1, 2, 3}
    out = {}
    for t in {t for t, _ in br}:
        ks = {k for tt, k in br if tt == t and k in known}
        if not ks:
            continue                                  # needs >= 1 existing class
        students = {u for u, k in det if k in ks}
        n_sub = len({i for i, (tt, _) in enumerate(sb) if tt == t})
        names = ", ".join(sorted({f"K{k}" for k in ks}))
        out[t] = (names, n_sub, len(students))
    return out


@settings(max_examples=6, deadline=None)
@given(details, bridge, subs)
def test_progress_matches_brute_force(spark, det, br, sb):
    t = from_rows(
        spark,
        kelas=[(1, "K1"), (2, "K2"), (3, "K3")],
        siswa_details=[(i, u, "J", f"n{i}", k) for i, (u, k) in enumerate(det)],
        tugas=[(t, f"T{t}", "d", None, "f", 9, ts(2024, 1, 1)) for t in range(100, 105)],
        tugas_kelas=list(br),
        pengumpulan_tugas=[(i, tt, u, "f", None, ts(2024, 1, 2)) for i, (tt, u) in enumerate(sb)],
    )
    got = {r.id: (r.kelas, r.jumlah_kumpul, r.jumlah_siswa) for r in progress.assignment_progress(t).collect()}
    assert got == brute(det, br, sb)
