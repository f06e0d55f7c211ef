"""Student create against brute force of its rules."""

import datetime as dt

from hypothesis import given, settings
from hypothesis import strategies as st

from kelasflow.operators import changes as W
from kelasflow.sources.catalog import from_rows
from tests.conftest import ts

email = st.sampled_from(["a@x", "A@X", "b@x", "c@x", "old@x"])
nisn = st.one_of(st.none(), st.sampled_from(["1", "2", "s9", "S9", "HELD"]))


def brute(reqs):
    """The requests one by one: a refused one takes neither e-mail nor number."""
    emails, numbers = {"old@x": ""}, {"held": ""}
    out, ok = {}, []
    for rid, e, n in sorted(reqs):
        if e.lower() in emails:
            out[rid] = "email_taken" + emails[e.lower()]
        elif n is not None and n.lower() in numbers:
            out[rid] = "nisn_taken" + numbers[n.lower()]
        else:
            emails[e.lower()] = "_in_batch"
            if n is not None:
                numbers[n.lower()] = "_in_batch"
            ok.append(rid)
    for i, rid in enumerate(ok):
        out[rid] = 100 + i + 1          # max user id 100 + rank
    return out


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(email, nisn), min_size=1, max_size=7))
def test_student_create_brute_force(spark, reqs):
    t = from_rows(spark, users=[(100, "Old", "OLD@x", "siswa", None, ts(2024, 1, 1))],
                  siswa_details=[(1, 100, "J", "held", None)])
    data = [(i + 1, f"N{i}", e, n, "J", None) for i, (e, n) in enumerate(reqs)]
    req = spark.createDataFrame(data, "request_id long, name string, email string, nisn string, "
                                      "jurusan string, kelas string")
    ch = W.student_create(t, req, dt.datetime(2024, 3, 1))
    got = {r.request_id: r.reason for r in ch.rejects.collect()}
    got.update({r.request_id: r.user_id for r in ch.emitted["accepted"].collect()})
    assert got == brute([(i + 1, e, n) for i, (e, n) in enumerate(reqs)])
