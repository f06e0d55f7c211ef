"""Teacher roster against brute force of GROUP BY user, name, email, nip,
mapel with GROUP_CONCAT over the left-joined class rows."""

from hypothesis import given, settings
from hypothesis import strategies as st

from kelasflow.operators import roster
from kelasflow.sources.catalog import from_rows
from tests.conftest import ts

gds = st.lists(st.tuples(st.integers(10, 12), st.sampled_from(["n1", "n2", None]), st.sampled_from(["M", None])),
               max_size=5)
links = st.lists(st.tuples(st.integers(0, 5), st.sampled_from([1, 2, 3])), max_size=8)


def brute(gd, gk):
    names = {1: "K1", 2: "K2"}                     # class 3 unknown -> NULL name
    groups = {}
    for u in (10, 11, 12):
        mine = [(i, n, m) for i, (uu, n, m) in enumerate(gd) if uu == u]
        if not mine:
            groups.setdefault((u, None, None), [])
        for i, n, m in mine:
            g = groups.setdefault((u, n, m), [])
            g.extend(names[k] for gid, k in gk if gid == i and k in names)
    return sorted(((u, n, m, ", ".join(sorted(v)) if v else None) for (u, n, m), v in groups.items()), key=repr)


@settings(max_examples=8, deadline=None)
@given(gds, links)
def test_teacher_roster_brute_force(spark, gd, gk):
    t = from_rows(
        spark,
        users=[(u, f"G{u}", f"g{u}@x", "guru", None, ts(2024, 1, 1)) for u in (10, 11, 12)],
        kelas=[(1, "K1"), (2, "K2")],
        guru_details=[(i, u, m, n) for i, (u, n, m) in enumerate(gd)],
        guru_kelas=[(j, g, k) for j, (g, k) in enumerate(gk)],
    )
    got = sorted((tuple(r) for r in roster.teacher_roster(t).select("id", "nip", "mapel", "kelas").collect()),
                 key=repr)
    assert got == brute(gd, gk)


def brute_search(gd, gk, kw):
    import re
    rx = re.compile(".*" + "".join(".*" if c == "%" else "." if c == "_" else re.escape(c) for c in kw) + ".*",
                    re.IGNORECASE | re.DOTALL)
    hit = lambda v: v is not None and rx.fullmatch(v) is not None
    names = {1: "K1", 2: "K2"}
    rows = []                                        # teacher x detail x class rows of the left joins
    for u in (10, 11, 12):
        mine = [(i, n, m) for i, (uu, n, m) in enumerate(gd) if uu == u]
        for i, n, m in (mine or [(None, None, None)]):
            ks = [names.get(k) for gid, k in gk if i is not None and gid == i] or [None]
            rows += [(u, f"G{u}", f"g{u}@x", n, m, k) for k in ks]
    groups = {}
    for u, name, email, n, m, k in rows:
        if any(hit(v) for v in (name, email, n, m, k)):
            g = groups.setdefault((u, n, m), [])
            if k is not None:
                g.append(k)
    return sorted(((u, n, m, ", ".join(sorted(v)) if v else None) for (u, n, m), v in groups.items()), key=repr)


@settings(max_examples=8, deadline=None)
@given(gds, links, st.sampled_from(["K1", "k2", "_1", "n1", "G11", "m", "zz"]))
def test_teacher_search_brute_force(spark, gd, gk, kw):
    t = from_rows(
        spark,
        users=[(u, f"G{u}", f"g{u}@x", "guru", None, ts(2024, 1, 1)) for u in (10, 11, 12)],
        kelas=[(1, "K1"), (2, "K2")],
        guru_details=[(i, u, m, n) for i, (u, n, m) in enumerate(gd)],
        guru_kelas=[(j, g, k) for j, (g, k) in enumerate(gk)],
    )
    got = sorted((tuple(r) for r in roster.teacher_search(t, kw).select("id", "nip", "mapel", "kelas").collect()),
                 key=repr)
    assert got == brute_search(gd, gk, kw)
