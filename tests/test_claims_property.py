"""Unique claims settled in windows against a replay of the requests one by one."""

import random

import pytest

from kelasflow.operators import changes as W
from kelasflow.operators import claims
from kelasflow.operators.claims import settle_claims
from kelasflow.sources.catalog import from_rows
from tests.conftest import ts

KINDS = ("email", "nisn")


class Replay:
    """Holders of e-mails and numbers while requests come one by one."""

    def __init__(self, **held):
        self.owner = {k: {v.lower(): u for u, vs in held[k].items() for v in vs} for k in KINDS}
        self.mine = {k: {u: {v.lower() for v in vs} for u, vs in held[k].items()} for k in KINDS}
        self.late = {k: set() for k in KINDS}           # values taken in the batch

    def ask(self, user, email, nisn):
        given = {"email": email and email.lower(), "nisn": nisn and nisn.lower()}
        for k in KINDS:
            if given[k] is not None and self.owner[k].get(given[k], user) != user:
                return f"{k}_taken" + ("_in_batch" if given[k] in self.late[k] else "")
        for k in KINDS:
            if given[k] is None and k == "email":
                continue
            new = {given[k]} - {None}
            for v in self.mine[k].get(user, set()) - new:
                del self.owner[k][v]
                self.late[k].discard(v)
            for v in new - self.mine[k].get(user, set()):
                self.owner[k][v] = user
                self.late[k].add(v)
            self.mine[k][user] = new
        return None


def verdicts(spark, requests, email, nisn):
    df = spark.createDataFrame(requests, "request_id long, user_id long, email string, nisn string")
    held = {k: spark.createDataFrame([(u, v) for u, vs in h.items() for v in vs], "user_id long, key string")
            for k, h in (("email", email), ("nisn", nisn))}
    return {r.request_id: r.reason for r in settle_claims(df, held, frozenset(["email"])).collect()}


@pytest.mark.parametrize("seed", range(6))
def test_claims_equal_a_replay(spark, seed):
    rnd = random.Random(seed)
    users, values = rnd.randint(2, 9), rnd.randint(2, 9)
    email = {u: [f"E{u}"] for u in range(users)}
    nisn = {u: [f"n{u}", f"m{u}"][:rnd.randint(0, 2)] for u in range(users)}
    requests = [(i - 5, rnd.randrange(users + 2), rnd.choice([None, *(f"{c}{x}" for x in range(values) for c in "eE")]),
                 rnd.choice([None, *(f"{c}{x}" for x in range(values) for c in "nm")])) for i in range(40)]
    world = Replay(email=email, nisn=nisn)
    assert verdicts(spark, requests, email, nisn) == {r[0]: world.ask(*r[1:]) for r in requests}


def test_a_hundred_thousand_requests_with_a_hot_value_and_a_hot_user(spark):
    rnd = random.Random(9)
    email, nisn = {u: [f"e{u}"] for u in range(20_000)}, {u: [f"n{u}"] for u in range(20_000)}
    requests = [(i, 77 if rnd.random() < 0.1 else rnd.randrange(22_000),
                 "hot" if rnd.random() < 0.33 else rnd.choice([None, f"e{rnd.randrange(40_000)}"]),
                 rnd.choice([None, f"n{rnd.randrange(40_000)}"])) for i in range(100_000)]
    world = Replay(email=email, nisn=nisn)
    assert verdicts(spark, requests, email, nisn) == {r[0]: world.ask(*r[1:]) for r in requests}


def test_a_save_after_somebody_elses_refused_one(spark):
    """The refused request takes nothing, so the next one may have its e-mail."""
    t = from_rows(spark, users=[(i, f"U{i}", f"u{i}@x", "siswa", None, ts(2024, 1, 1)) for i in (1, 2, 3)],
                  siswa_details=[(i, i, "J", f"S{i}", None) for i in (1, 2, 3)])
    req = spark.createDataFrame([(1, 1, "A", "z@x", "s2", "J", None), (2, 3, "B", "Z@x", "S9", "J", None),
                                 (3, 1, "C", None, "s3", "J", None), (4, 2, None, "u3@x", None, "J", None),
                                 (5, 1, "D", None, "S2", "K", None)],
                                "request_id long, user_id long, name string, email string, nisn string, jurusan string, kelas string")
    ch = W.student_upsert(t, req)
    # 3 moved from S3 to S9 and from u3@x to Z@x; 2 gave up S2 with request 4
    assert {r.request_id: r.reason for r in ch.rejects.collect()} == {1: "nisn_taken", 3: "superseded"}
    assert sorted((r.id, r.name, r.email) for r in ch.tables.users.collect()) == [
        (1, "D", "u1@x"), (2, "U2", "u3@x"), (3, "B", "Z@x")]
    assert {r.user_id: r.nisn for r in ch.tables.siswa_details.collect()} == {1: "S2", 2: None, 3: "S9"}


def test_no_requests(spark):
    assert verdicts(spark, [], {1: ["a"]}, {1: ["b"]}) == {}


def chained(n, users=23, emails=15, numbers=13):
    """Requests of few users for fewer values: nearly each outcome hangs on the one before."""
    rnd = random.Random(5)
    return [(i, rnd.randrange(users), f"e{rnd.randrange(emails)}", f"n{rnd.randrange(numbers)}") for i in range(n)]


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    """Every round writes frames: their number must not follow the length of the chain."""
    written = []
    real = claims.materialize
    monkeypatch.setattr(claims, "materialize", lambda df, name: written.append(name) or real(df, name))
    requests, world = chained(2_000), Replay(email={}, nisn={})
    assert verdicts(spark, requests, {}, {}) == {r[0]: world.ask(*r[1:]) for r in requests}
    assert len(written) < 15


@pytest.mark.parametrize("window", [7, 64])
def test_windows_hand_on_what_is_held(spark, monkeypatch, window):
    monkeypatch.setattr(claims, "WINDOW", window)
    requests = chained(100) + [(1_000 + i, 100 + i, f"e{i % 15}" if i % 2 else None, f"n{i % 13}") for i in range(60)]
    email, nisn = {3: ["E1"], 200: ["e2"], 201: ["e3"]}, {4: ["n1", "n2"], 200: ["n3"]}
    world = Replay(email=email, nisn=nisn)
    assert verdicts(spark, requests, email, nisn) == {r[0]: world.ask(*r[1:]) for r in requests}
