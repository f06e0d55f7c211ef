"""Cascade delete against a brute-force walk of the foreign keys."""

from hypothesis import given, settings
from hypothesis import strategies as st

from kelasflow.operators import changes as W
from kelasflow.sources.catalog import from_rows
from tests.conftest import ts

U = list(range(1, 7))
uid = st.sampled_from(U)


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 4), uid), max_size=4),          # guru_details (id, user)
       st.lists(st.tuples(st.integers(1, 4), st.sampled_from([1, 2])), max_size=5),   # guru_kelas
       st.lists(st.one_of(st.none(), uid), max_size=4),                     # courses.created_by
       st.lists(uid, max_size=4),                                           # tugas.created_by
       st.lists(st.tuples(st.integers(0, 4), st.one_of(st.none(), uid)), max_size=6),  # submissions
       st.lists(uid, max_size=3),                                           # diskusi.created_by
       st.lists(st.tuples(st.integers(0, 3), uid), max_size=5),             # chat (thread, user)
       st.sets(uid, max_size=3),                                            # users to delete
       st.sets(st.integers(0, 4), max_size=2))                              # tugas to delete
def test_cascade_brute_force(spark, gd, gk, cby, tby, sb, dby, chat, dele, dtug):
    gd = list({g: u for g, u in gd}.items())
    t = from_rows(
        spark,
        users=[(u, f"U{u}", f"u{u}@x", "guru", None, ts(2024, 1, 1)) for u in U],
        kelas=[(1, "K1"), (2, "K2")],
        verifications=[(u, u, "approved", ts(2024, 1, 1)) for u in U],
        guru_details=[(g, u, "M", f"n{g}") for g, u in gd],
        guru_kelas=[(i, g, k) for i, (g, k) in enumerate(gk)],
        courses=[(c, "C", "d", a, ts(2024, 1, 1), "f") for c, a in enumerate(cby)],
        tugas=[(i, "T", "d", None, "f", a, ts(2024, 1, 1)) for i, a in enumerate(tby)],
        tugas_kelas=[(i, 1) for i in range(len(tby))],
        pengumpulan_tugas=[(i, tt, u, "f", None, ts(2024, 1, 2)) for i, (tt, u) in enumerate(sb)],
        diskusi=[(i, "J", "I", a, ts(2024, 1, 1)) for i, a in enumerate(dby)],
        chat_diskusi=[(i, d, u, "x", ts(2024, 1, 1)) for i, (d, u) in enumerate(chat)],
    )
    req = {"users": spark.createDataFrame([(u,) for u in dele], "id long")}
    if dtug:
        req["tugas"] = spark.createDataFrame([(x,) for x in dtug], "id long")
    n = W.delete_cascade(t, req).tables
    ids = lambda df, c="id": sorted(r[c] for r in df.collect())
    gone_g = {g for g, u in gd if u in dele}
    gone_t = {i for i, a in enumerate(tby) if a in dele} | set(dtug)
    gone_d = {i for i, a in enumerate(dby) if a in dele}
    assert ids(n.users) == sorted(set(U) - dele)
    assert ids(n.verifications) == sorted(set(U) - dele)
    assert ids(n.guru_details) == sorted(g for g, _ in gd if g not in gone_g)
    assert ids(n.guru_kelas) == sorted(i for i, (g, _) in enumerate(gk) if g not in gone_g)
    assert sorted((r.id, r.created_by) for r in n.courses.collect()) == \
        sorted((c, None if a in dele else a) for c, a in enumerate(cby))
    assert ids(n.tugas) == sorted(i for i in range(len(tby)) if i not in gone_t)
    assert ids(n.tugas_kelas, "tugas_id") == sorted(i for i in range(len(tby)) if i not in gone_t)
    assert ids(n.pengumpulan_tugas) == sorted(i for i, (tt, u) in enumerate(sb) if tt not in gone_t and u not in dele)
    assert ids(n.diskusi) == sorted(i for i in range(len(dby)) if i not in gone_d)
    assert ids(n.chat_diskusi) == sorted(i for i, (d, u) in enumerate(chat) if d not in gone_d and u not in dele)
