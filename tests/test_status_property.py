"""Submission status against brute force of the reference's two SQL
statements on random data (NULL students, duplicate bridge rows, students in
several classes, submitters without a class)."""

from hypothesis import given, settings
from hypothesis import strategies as st

from kelasflow.operators import progress
from kelasflow.sources.catalog import from_rows
from tests.conftest import ts

details = st.lists(st.tuples(st.integers(1, 6), st.sampled_from([1, 2, 3, None])), max_size=10)
bridge = st.lists(st.tuples(st.integers(100, 103), st.sampled_from([1, 2, 3])), max_size=8)
subs = st.lists(st.tuples(st.integers(100, 104), st.one_of(st.none(), st.integers(1, 7))), max_size=8)


def brute(det, br, sb, users):
    kelas = {1: "K1", 2: "K2"}                      # class 3 is unknown
    tugas = set(range(100, 104))
    out = []
    for i, (t, u) in enumerate(sb):                 # sudah_kumpul: inner joins
        if t in tugas and u in users:
            for du, k in det:
                if du == u and k in kelas:
                    out.append((t, "sudah_kumpul", u, f"U{u}", kelas[k], f"f{i}", None))
    for t, k in br:                                 # belum_kumpul: NOT IN
        if t not in tugas or k not in kelas:
            continue
        sub_ids = [u for tt, u in sb if tt == t]
        for du, dk in det:
            if dk != k or du not in users:
                continue
            if None in sub_ids or du in sub_ids:
                continue
            out.append((t, "belum_kumpul", du, f"U{du}", kelas[k], None, None))
    return sorted(out, key=repr)


@settings(max_examples=6, deadline=None)
@given(details, bridge, subs)
def test_status_matches_brute_force(spark, det, br, sb):
    users = set(range(1, 6))                        # student 6 and 7 have no user row
    t = from_rows(
        spark,
        users=[(u, f"U{u}", f"u{u}@x", "siswa", None, ts(2024, 1, 1)) for u in users],
        kelas=[(1, "K1"), (2, "K2")],
        siswa_details=[(i, u, "J", f"n{i}", k) for i, (u, k) in enumerate(det)],
        tugas=[(t, f"T{t}", "d", None, "f", 9, ts(2024, 1, 1)) for t in range(100, 104)],
        tugas_kelas=list(br),
        pengumpulan_tugas=[(i, tt, u, f"f{i}", None, ts(2024, 1, 2)) for i, (tt, u) in enumerate(sb)],
    )
    got = sorted((tuple(r) for r in progress.submission_status(t)
                  .select("tugas_id", "status", "id", "name", "kelas", "file_path", "nilai").collect()), key=repr)
    assert got == brute(det, br, sb, users)
