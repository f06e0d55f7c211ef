"""Write paths as batch change jobs.

Every job takes the current snapshot (a :class:`Tables` bundle) and a
DataFrame of change requests, and returns a :class:`Change`: the new
snapshot (only the touched tables are replaced), a ``rejects`` frame
(``request_id``, ``reason``) and any rows the write emits elsewhere (log
rows, verification rows).  Nothing is updated in place: parquet in, parquet
out; with a table format the same plans become ``MERGE``.  All outputs are
computed from one snapshot, so a batch is applied atomically and replaying
it is a no-op where the reference's checks make it one.

Request frames carry a ``request_id`` that must be unique within the batch
(outcomes are keyed by it); it orders requests inside a batch (later wins for updates, first wins for inserts) and seeds the ids of
inserted rows, which are ``max(id)`` + rank, assigned without a
single-partition window.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kelasflow.functions.ids import assign_ids, next_id
from kelasflow.functions.shared import materialize
from kelasflow.operators.activity import ntz
from kelasflow.operators.claims import BEFORE, settle_claims
from kelasflow.schema import ROLES
from kelasflow.sources.catalog import Tables


@dataclass
class Change:
    tables: Tables
    rejects: DataFrame
    emitted: dict[str, DataFrame] = field(default_factory=dict)

    def checkpoint(self) -> "Change":
        """Materialise the touched tables, rejects and emitted rows with a
        reliable ``checkpoint()`` into the cluster's ``spark.checkpoint.dir``
        and return a Change over them.  Chain jobs on the result: without it
        each job's plan embeds the previous jobs' plans, and the plan grows
        with every step (and a lost executor would recompute all of them)."""
        from kelasflow.session import checkpoint_root
        checkpoint_root(self.tables.spark)
        changed = self.tables.__dict__.get("changed", set(self.tables.frames))
        frames = {n: (df.checkpoint() if n in changed else df) for n, df in self.tables.frames.items()}
        out = Tables(self.tables.spark, frames)
        out.__dict__["changed"] = set(changed)
        return Change(out, self.rejects.checkpoint(), {k: v.checkpoint() for k, v in self.emitted.items()})


def _cut(df: DataFrame) -> DataFrame:
    """Materialise an intermediate result under the cluster's checkpoint dir.
    Used at the stage boundaries of the multi-step jobs: later steps reference
    the result several times, and without the cut each reference would carry
    (and recompute) the whole chain of dedupe joins before it.  It is written
    as Parquet, several times smaller than the rows of a ``checkpoint()``."""
    return materialize(df, "cut")


def _reject(df: DataFrame, reason: str | Column) -> DataFrame:
    r = F.lit(reason) if isinstance(reason, str) else reason
    return df.select(F.col("request_id").cast("bigint").alias("request_id"), r.alias("reason"))


def _no_rejects(t: Tables) -> DataFrame:
    return t.spark.createDataFrame([], "request_id bigint, reason string")


def _union(frames) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _split(df: DataFrame, winners: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows whose request_id is a winner, the rest).  Joins on the unique
    request id, so no key is hot here."""
    w = winners.select("request_id")
    return df.join(w, "request_id", "left_semi"), df.join(w, "request_id", "left_anti")


def _latest(df: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Split requests into the last one per key (highest request_id) and the
    superseded rest.  A mergeable aggregate, not a window: a key holding a
    large share of the requests is combined map-side instead of sorted in
    one task."""
    return _split(df, df.groupBy(*keys).agg(F.max("request_id").alias("request_id")))


def _first(df: DataFrame, keys: list[str], order: list[str]) -> tuple[DataFrame, DataFrame]:
    """Split requests into the first one per key under ``order`` (which ends
    with request_id, a total order) and the later duplicates."""
    win = df.groupBy(*keys).agg(F.min_by("request_id", F.struct(*order)).alias("request_id"))
    return _split(df, win)


# ---------------------------------------------------------------- W01 classes
def find_or_create_classes(t: Tables, requests: DataFrame, name_col: str = "kelas") -> tuple[DataFrame, DataFrame]:
    """Resolve free-text class names to class ids, creating unknown ones.

    Names are trimmed; blank or NULL resolves to NULL.  Matching is
    case-insensitive (the store's collation).  A new name gets
    ``max(id) + rank`` in name order, so the ids do not depend on request
    order.  Returns ``(kelas snapshot, requests + kelas_id)``.
    """
    req = requests.withColumn("_nama", F.nullif(F.trim(F.col(name_col)), F.lit("")))
    known = t.kelas.select(F.col("id").alias("_kid"), F.lower("nama_kelas").alias("_key"))
    wanted = (req.where(F.col("_nama").isNotNull())
              .groupBy(F.lower("_nama").alias("_key")).agg(F.min("_nama").alias("nama_kelas")))
    new = _cut(assign_ids(wanted.join(known, "_key", "left_anti"), ["_key"], next_id(t.kelas), name="id"))
    kelas = t.kelas.unionByName(new.select(F.col("id").cast("int"), "nama_kelas"))
    lookup = known.unionByName(new.select(F.col("id").alias("_kid"), "_key"))
    resolved = (req.join(lookup, F.lower("_nama") == lookup._key, "left")
                .withColumn("kelas_id", F.col("_kid").cast("int")).drop("_kid", "_key", "_nama"))
    return kelas, resolved


# ------------------------------------------------- refusals shared by the jobs
def _existing(req: DataFrame, col: str, parent: DataFrame, reason: str) -> tuple[DataFrame, DataFrame]:
    """(requests whose ``col`` is an id of ``parent``, rejects of the others)."""
    ids = parent.select(F.col("id").alias(col))
    return req.join(ids, col, "left_semi"), _reject(req.join(ids, col, "left_anti"), reason)


def _existing_few_strange(req: DataFrame, col: str, parent: DataFrame, reason: str) -> tuple[DataFrame, DataFrame]:
    """As :func:`_existing` for very many requests: the ids that do not exist
    are found first and written, so the requests are shuffled only if these
    are too many to be sent to all tasks."""
    ids = parent.select(F.col("id").alias(col))
    strange = _cut(req.select(col).where(F.col(col).isNotNull()).distinct().join(ids, col, "left_anti"))
    given = req.where(F.col(col).isNotNull())
    unknown = req.where(F.col(col).isNull()).unionByName(given.join(strange, col, "left_semi").select(*req.columns))
    return given.join(strange, col, "left_anti").select(*req.columns), _reject(unknown, reason)


def _settled(req: DataFrame, held: dict[str, DataFrame], keeps_on_null: frozenset[str] = frozenset(),
             user: str = "user_id") -> tuple[DataFrame, DataFrame]:
    """(requests that get the unique values they claim, rejects of the
    others), as if they came one by one (:func:`claims.settle_claims`)."""
    verdicts = settle_claims(req.select("request_id", F.col(user).alias("user_id"), *held), held, keeps_on_null)
    judged = _cut(req.join(verdicts, "request_id"))
    refused = judged.where(F.col("reason").isNotNull())
    return judged.where(F.col("reason").isNull()).drop("reason"), _reject(refused, F.col("reason"))


def _held(df: DataFrame, holder: str, col: str) -> DataFrame:
    return df.select(F.col(holder).alias("user_id"), F.col(col).alias("key"))


def _updated_users(t: Tables, accepted: DataFrame) -> DataFrame:
    """``users`` with name and e-mail of the accepted requests: of each the
    last that is not NULL; without one the old value stays."""
    given = [c for c in ("name", "email") if c in accepted.columns]
    if not given:
        return t.users
    last = [F.max(F.when(F.col(c).isNotNull(), F.struct("request_id", c)))[c].alias(f"_{c}") for c in given]
    r = accepted.groupBy(F.col("user_id").alias("id")).agg(*last)
    return t.users.join(r, "id", "left").select(
        *[F.coalesce(f"_{c}", c).alias(c) if c in given else F.col(c) for c in t.users.columns])


# ---------------------------------------------------------- W02 student upsert
def student_upsert(t: Tables, requests: DataFrame) -> Change:
    """Requests ``(request_id, user_id, nisn, jurusan, kelas)``; the
    self-service form also sends ``name`` and ``email``.

    The batch has the outcome of its requests one by one: the user must
    exist, and neither e-mail nor NISN may be another user's at that point;
    an accepted request frees what its user held before.  Of a user's
    accepted requests the last one stands (the others are ``superseded``).  A
    user with detail rows has all of them updated; others get a new row.  Of
    name and e-mail the last value that is not NULL stands.
    """
    ok, unknown = _existing(requests, "user_id", t.users, "unknown_user")
    held = {"email": _held(t.users, "id", "email")} if "email" in requests.columns else {}
    held["nisn"] = _held(t.siswa_details, "user_id", "nisn")
    ok, refused = _settled(ok, held, frozenset(["email"]))
    last, superseded = _latest(ok, ["user_id"])
    rejects = [unknown, refused, _reject(superseded, "superseded")]
    last = _cut(last)
    kelas, resolved = find_or_create_classes(t, last)
    resolved = resolved.select("user_id", F.col("nisn").alias("_nisn"), F.col("jurusan").alias("_jurusan"),
                               F.col("kelas_id").alias("_kelas_id"), "request_id")
    sd = t.siswa_details
    hit = F.col("request_id").isNotNull()
    updated = (sd.join(resolved, "user_id", "left")
               .select("id", "user_id", *[F.when(hit, F.col(f"_{c}")).otherwise(F.col(c)).alias(c)
                                          for c in ("jurusan", "nisn", "kelas_id")]))
    inserts = assign_ids(resolved.join(sd.select("user_id"), "user_id", "left_anti"), ["request_id"], next_id(sd))
    inserted = inserts.select("id", "user_id", F.col("_jurusan").alias("jurusan"), F.col("_nisn").alias("nisn"),
                              F.col("_kelas_id").alias("kelas_id"))
    return Change(t.replace(siswa_details=updated.unionByName(inserted), kelas=kelas, users=_updated_users(t, ok)),
                  _union(rejects), {"accepted": last.select("request_id", "user_id")})


# ------------------------------------------------- W03 / W04 / W09 user create
def _create_users(t: Tables, requests: DataFrame, role: Column, unique_detail: tuple[str, str] | None,
                  as_of: dt.datetime) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Shared part of the create jobs: returns (accepted + new user id, new
    users rows, rejects).  Every request is a person of its own; a refused
    one takes nothing."""
    nobody = F.lit(BEFORE).alias("user_id")         # holders in the snapshot need no name: none of them asks
    held = {"email": t.users.select(nobody, F.col("email").alias("key"))}
    if unique_detail:
        table, col = unique_detail
        held[col] = t[table].select(nobody, F.col(col).alias("key"))
    ok, refused = _settled(requests.withColumn("_role", role), held, user="request_id")
    ok = _cut(assign_ids(ok, ["request_id"], next_id(t.users), name="user_id"))
    users = ok.select(F.col("user_id").alias("id"), "name", "email", F.col("_role").alias("role"),
                      F.lit(None).cast("string").alias("foto"), ntz(as_of).alias("created_at"))
    return ok, users, _cut(refused)


def _verifications(t: Tables, ok: DataFrame, status: str, as_of: dt.datetime) -> DataFrame:
    v = assign_ids(ok.select("request_id", "user_id"), ["request_id"], next_id(t.verifications))
    return v.select("id", "user_id", F.lit(status).alias("status"), ntz(as_of).alias("requested_at"))


def _logs(t: Tables, rows: DataFrame, action: Column, as_of: dt.datetime) -> DataFrame:
    lg = assign_ids(rows.select("request_id", "user_id", action.alias("action")), ["request_id"],
                    next_id(t.activity_logs))
    return lg.select("id", "user_id", "action", ntz(as_of).alias("created_at"))


def student_create(t: Tables, requests: DataFrame, as_of: dt.datetime) -> Change:
    """Requests ``(request_id, name, email, nisn, jurusan, kelas)``: reject a
    known e-mail or NISN (also one that an earlier accepted request took);
    otherwise add the user, an *approved* verification and a detail row
    (class found or created)."""
    ok, users, rejects = _create_users(t, requests, F.lit("siswa"), ("siswa_details", "nisn"), as_of)
    ver = _verifications(t, ok, "approved", as_of)
    kelas, resolved = find_or_create_classes(t, ok)
    det = assign_ids(resolved, ["request_id"], next_id(t.siswa_details))
    det = det.select("id", "user_id", "jurusan", "nisn", "kelas_id")
    return Change(t.replace(users=t.users.unionByName(users), verifications=t.verifications.unionByName(ver),
                            siswa_details=t.siswa_details.unionByName(det), kelas=kelas), rejects,
                  {"users": users, "verifications": ver, "siswa_details": det,
                   "accepted": ok.select("request_id", "user_id")})


def teacher_create(t: Tables, requests: DataFrame, as_of: dt.datetime) -> Change:
    """Requests ``(request_id, name, email, nip, mapel)``: as student_create,
    with NIP uniqueness and a teacher detail row."""
    ok, users, rejects = _create_users(t, requests, F.lit("guru"), ("guru_details", "nip"), as_of)
    ver = _verifications(t, ok, "approved", as_of)
    det = assign_ids(ok.select("request_id", "user_id", "mapel", "nip"), ["request_id"], next_id(t.guru_details))
    det = det.select("id", "user_id", "mapel", "nip")
    return Change(t.replace(users=t.users.unionByName(users), verifications=t.verifications.unionByName(ver),
                            guru_details=t.guru_details.unionByName(det)), rejects,
                  {"users": users, "verifications": ver, "guru_details": det,
                   "accepted": ok.select("request_id", "user_id")})


def register_users(t: Tables, requests: DataFrame, as_of: dt.datetime) -> Change:
    """Requests ``(request_id, name, email, role)``.  Admin role refused,
    unknown and missing roles refused, known e-mail refused; others fan out
    to a user, a *pending* verification and a ``User registered as <role>``
    log row."""
    admin = requests.where(F.col("role") == "admin")
    known = F.coalesce(F.col("role").isin(*ROLES), F.lit(False))
    strange = requests.where(~known)
    rest = requests.where(known & (F.col("role") != "admin"))
    ok, users, rejects = _create_users(t, rest, F.col("role"), None, as_of)
    ver = _verifications(t, ok, "pending", as_of)
    logs = _logs(t, ok, F.concat(F.lit("User registered as "), F.col("role")), as_of)
    return Change(t.replace(users=t.users.unionByName(users), verifications=t.verifications.unionByName(ver),
                            activity_logs=t.activity_logs.unionByName(logs)),
                  _union([rejects, _reject(admin, "admin_not_allowed"), _reject(strange, "unknown_role")]),
                  {"users": users, "verifications": ver, "activity_logs": logs,
                   "accepted": ok.select("request_id", "user_id")})


# ---------------------------------------------------------- W05 teacher upsert
def teacher_upsert(t: Tables, requests: DataFrame) -> Change:
    """Requests ``(request_id, user_id, name, email, nip, mapel)``, and
    optionally ``kelas`` (array or CSV).

    Settled one by one as in :func:`student_upsert`, with e-mail and NIP as
    the unique values; of a user's accepted requests the last one stands, of
    name and e-mail the last that is not NULL.  Detail rows are updated or
    inserted.
    With ``kelas`` not NULL the class list of the teacher is replaced, for
    accepted requests only.
    """
    ok, unknown = _existing(requests, "user_id", t.users, "unknown_user")
    ok, refused = _settled(ok, {"email": _held(t.users, "id", "email"), "nip": _held(t.guru_details, "user_id", "nip")},
                           frozenset(["email"]))
    last, superseded = _latest(ok, ["user_id"])
    last = _cut(last)
    d = last.select("user_id", F.col("nip").alias("_nip"), F.col("mapel").alias("_mapel"), "request_id")
    gd = t.guru_details
    hit = F.col("request_id").isNotNull()
    upd = (gd.join(d, "user_id", "left")
           .select("id", "user_id", F.when(hit, F.col("_mapel")).otherwise(F.col("mapel")).alias("mapel"),
                   F.when(hit, F.col("_nip")).otherwise(F.col("nip")).alias("nip")))
    ins = assign_ids(d.join(gd.select("user_id"), "user_id", "left_anti"), ["request_id"], next_id(gd))
    ins = ins.select("id", "user_id", F.col("_mapel").alias("mapel"), F.col("_nip").alias("nip"))
    new = t.replace(users=_updated_users(t, ok), guru_details=upd.unionByName(ins))
    if "kelas" in requests.columns:
        lists = (last.where(F.col("kelas").isNotNull())
                 .join(new.guru_details.select(F.col("id").alias("guru_id"), "user_id"), "user_id")
                 .select("request_id", "guru_id", "kelas"))
        new = replace_bridge(new, "guru_kelas", lists).tables
    return Change(new, _union([unknown, refused, _reject(superseded, "superseded")]),
                  {"accepted": last.select("request_id", "user_id")})


# ------------------------------------------------------ W06 / W07 bridge tables
BRIDGES = {  # bridge table -> (parent key column, parent table)
    "guru_kelas": ("guru_id", "guru_details"),
    "course_kelas": ("course_id", "courses"),
    "tugas_kelas": ("tugas_id", "tugas"),
    "diskusi_kelas": ("diskusi_id", "diskusi"),
}
BRIDGE_OF = {parent: bridge for bridge, (_, parent) in BRIDGES.items()}


def _exploded_classes(requests: DataFrame, parent_col: str) -> DataFrame:
    """Requests ``(request_id, <parent>, kelas)`` with ``kelas`` an array or a
    comma-separated string -> one row per trimmed non-blank name."""
    arr = F.col("kelas")
    if dict(requests.dtypes)["kelas"] == "string":
        arr = F.split(F.col("kelas"), ",")
    return (requests.select("request_id", parent_col, F.explode_outer(arr).alias("_name"))
            .select("request_id", parent_col, F.nullif(F.trim("_name"), F.lit("")).alias("_name")))


def replace_bridge(t: Tables, bridge: str, requests: DataFrame) -> Change:
    """For every parent named in a request (last request per parent
    wins), drop all its class pairs and insert the given classes; unknown
    class names are ignored, duplicates collapse.  Requests for a parent that
    does not exist are refused."""
    pcol, parent = BRIDGES[bridge]
    known, unknown = _existing(requests, pcol, t[parent], "unknown_parent")
    last, superseded = _latest(known, [pcol])
    names = _exploded_classes(last, pcol)
    k = t.kelas.select(F.col("id").alias("kelas_id"), F.lower("nama_kelas").alias("_key"))
    pairs = (names.join(k, F.lower("_name") == k._key).select("request_id", pcol, "kelas_id")
             .dropDuplicates([pcol, "kelas_id"]))
    old = t[bridge]
    kept = old.join(last.select(pcol), pcol, "left_anti")
    if "id" in old.columns:
        pairs = assign_ids(pairs, [pcol, "kelas_id"], next_id(old))
    new = kept.unionByName(pairs.select(*old.columns))
    return Change(t.replace(**{bridge: new}), _union([_reject(superseded, "superseded"), unknown]))


REQUIRED = {  # parent table -> fields that must be non-blank (W07)
    "courses": ["name"],
    "tugas": ["judul", "deskripsi", "deadline"],
    "diskusi": ["judul", "isi"],
}


def create_with_classes(t: Tables, parent: str, requests: DataFrame, as_of: dt.datetime) -> Change:
    """Insert parents (course, assignment, thread) with their class
    pairs.  Requests carry the parent's columns (no id) plus ``kelas``
    (array or CSV).  Missing required fields and authors that do not exist
    are rejected; a course must name at least one class.  Names of unknown
    classes make no pair, and a course that names only such ones is stored
    without pairs."""
    bridge = BRIDGE_OF[parent]
    pcol = BRIDGES[bridge][0]
    blank = reduce(lambda a, b: a | b,
                   [F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == "" for c in REQUIRED[parent]])
    bad = requests.where(blank)
    ok = requests.where(~blank)
    authors = t.users.select(F.col("id").alias("created_by"))
    stray = ok.where(F.col("created_by").isNotNull()).join(authors, "created_by", "left_anti")
    ok = ok.join(stray.select("request_id"), "request_id", "left_anti")
    names = _exploded_classes(ok.withColumn(pcol, F.lit(None).cast("bigint")), pcol)
    k = t.kelas.select(F.col("id").alias("kelas_id"), F.lower("nama_kelas").alias("_key"))
    pairs = names.join(k, F.lower("_name") == k._key).select("request_id", "kelas_id").dropDuplicates()
    rejects = [_reject(bad, "missing_required_field"), _reject(stray, "unknown_author")]
    if parent == "courses":
        named = names.where(F.col("_name").isNotNull()).select("request_id").distinct()
        rejects.append(_reject(ok.join(named, "request_id", "left_anti"), "no_class"))
        ok = ok.join(named, "request_id", "left_semi")
    ok = assign_ids(ok, ["request_id"], next_id(t[parent]))
    cols = t[parent].columns
    rows = ok.select(*[F.col(c) if c in ok.columns else (ntz(as_of) if c == "created_at" else F.lit(None))
                       .cast(dict(t[parent].dtypes)[c]).alias(c) for c in cols])
    links = pairs.join(ok.select("request_id", F.col("id").alias(pcol)), "request_id")
    old = t[bridge]
    if "id" in old.columns:
        links = assign_ids(links, [pcol, "kelas_id"], next_id(old))
    return Change(t.replace(**{parent: t[parent].unionByName(rows), bridge: old.unionByName(links.select(*old.columns))}),
                  _union(rejects), {parent: rows, "links": links.select("request_id", pcol, "kelas_id"),
                                    "accepted": ok.select("request_id", "id")})


# ---------------------------------------------------- W08 verification status
def verification_transition(t: Tables, requests: DataFrame, as_of: dt.datetime) -> Change:
    """Requests ``(request_id, verification_id, status)``.  Only approved /
    rejected may be set; unknown ids are rejected; last request per id wins.
    Each applied change emits a ``Verification <status>`` log row."""
    valid = requests.where(F.col("status").isin("approved", "rejected"))
    bad = requests.join(valid.select("request_id"), "request_id", "left_anti")
    known = valid.join(t.verifications.select(F.col("id").alias("verification_id")), "verification_id", "left_semi")
    unknown = valid.join(known.select("request_id"), "request_id", "left_anti")
    last, superseded = _latest(known, ["verification_id"])
    r = last.select(F.col("verification_id").alias("id"), F.col("status").alias("_status"), "request_id")
    v = (t.verifications.join(r, "id", "left")
         .select("id", "user_id", F.coalesce("_status", "status").alias("status"), "requested_at"))
    applied = r.join(t.verifications.select("id", "user_id"), "id")
    logs = _logs(t, applied, F.concat(F.lit("Verification "), F.col("_status")), as_of)
    return Change(t.replace(verifications=v, activity_logs=t.activity_logs.unionByName(logs)),
                  _union([_reject(bad, "invalid_status"), _reject(unknown, "unknown_verification"),
                          _reject(superseded, "superseded")]),
                  {"activity_logs": logs})


# ------------------------------------------------- W10 first-write-wins submit
def submit_first_wins(t: Tables, requests: DataFrame, after: int | None = None) -> Change:
    """Requests ``(request_id, tugas_id, siswa_id, file_path, submitted_at)``.

    The assignment and the student must exist.  A pair that already has a
    submission is rejected; within the batch the earliest request (by time,
    then id) of a pair wins.  New rows get ids after the largest stored one
    (``after``, where the caller keeps it), in request order.  Replaying the batch rejects every request.
    """
    key = ["tugas_id", "siswa_id"]
    asked = _cut(requests)
    known, stray = _existing_few_strange(asked, "tugas_id", t.tugas, "unknown_assignment")
    known, nobody = _existing_few_strange(known, "siswa_id", t.users, "unknown_student")
    # only the pairs asked for are looked up in the table, whichever side Spark moves
    have = t.pengumpulan_tugas.select(*key).join(known.select(*key).distinct(), key, "left_semi").distinct()
    first = known.groupBy(*key).agg(F.min_by("request_id", F.struct("submitted_at", "request_id")).alias("_first"))
    outcome = (F.when(F.col("_has"), "already_submitted").when(F.col("request_id") == F.col("_first"), "accepted")
               .otherwise("duplicate_in_batch"))
    judged = _cut(known.join(have.withColumn("_has", F.lit(True)), key, "left").join(first, key)     # one pass over the table
                  .withColumn("_outcome", outcome).drop("_has", "_first"))
    win, lost = judged.where("_outcome = 'accepted'").drop("_outcome"), judged.where("_outcome <> 'accepted'")
    ided = assign_ids(win, ["request_id"], next_id(t.pengumpulan_tugas) if after is None else F.lit(after))
    rows = ided.select("id", "tugas_id", "siswa_id", "file_path",
                       F.lit(None).cast("int").alias("nilai"), F.col("submitted_at").alias("dikumpulkan_at"))
    return Change(t.replace(pengumpulan_tugas=t.pengumpulan_tugas.unionByName(rows)),
                  _union([stray, nobody, _reject(lost, F.col("_outcome"))]),
                  {"accepted": ided.select("request_id", "tugas_id", "siswa_id", "id"), "pengumpulan_tugas": rows})


def duplicate_submissions(t: Tables) -> DataFrame:
    """Audit of old duplicates the store could hold (no unique key)."""
    return (t.pengumpulan_tugas.groupBy("tugas_id", "siswa_id").agg(F.count(F.lit(1)).alias("n"))
            .where(F.col("n") > 1))


# ------------------------------------------------------------ W11 grade post
def post_grades(t: Tables, requests: DataFrame) -> Change:
    """Requests ``(request_id, tugas_id, siswa_id, nilai)``; the last per pair
    wins and sets the grade on *every* submission row of the pair.  Pairs
    with no submission are rejected.  No range check (as the server);
    A03 reports grades outside 0..100."""
    last, superseded = _latest(requests, ["tugas_id", "siswa_id"])
    have = t.pengumpulan_tugas.select("tugas_id", "siswa_id")
    none = last.join(have, ["tugas_id", "siswa_id"], "left_anti")
    g = last.select("tugas_id", "siswa_id", F.col("nilai").alias("_nilai"), F.lit(True).alias("_hit"))
    pt = (t.pengumpulan_tugas.join(g, ["tugas_id", "siswa_id"], "left")
          .select("id", "tugas_id", "siswa_id", "file_path",
                  F.when(F.col("_hit"), F.col("_nilai")).otherwise(F.col("nilai")).alias("nilai"),
                  "dikumpulkan_at"))
    return Change(t.replace(pengumpulan_tugas=pt),
                  _union([_reject(superseded, "superseded"), _reject(none, "no_submission")]))


# ----------------------------------------------------- W12 owner-checked edit
def update_owned(t: Tables, parent: str, requests: DataFrame) -> Change:
    """Requests ``(request_id, id, owner_id, <fields>)`` for courses, tugas
    or diskusi.  A request is applied only when ``owner_id`` is the row's
    author (others are rejected first, so they cannot shadow the owner's
    edit); of the owner's requests for one row the last wins.  NULL fields
    (e.g. no new file) keep the old value.  With a column ``kelas`` (array or
    CSV) the row's class list is replaced by the same request where it is not
    NULL; a refused request changes neither the fields nor the classes."""
    rows = t[parent]
    owners = rows.select("id", F.col("created_by").alias("owner_id"))
    named = requests.select("request_id", "id", "owner_id")         # texts and classes of the last ones only
    owned = _cut(named.join(owners, ["id", "owner_id"], "left_semi"))
    denied = named.join(owned.select("request_id"), "request_id", "left_anti")
    winners = owned.groupBy("id").agg(F.max("request_id").alias("request_id")).select("request_id")
    superseded = owned.join(winners, "request_id", "left_anti")
    last = _cut(requests.join(_cut(winners), "request_id", "left_semi").join(owners, ["id", "owner_id"], "left_semi"))
    fields = [c for c in requests.columns if c in rows.columns and c not in ("id", "created_by")]
    r = last.select("id", F.lit(True).alias("_hit"), *[F.col(c).alias(f"_{c}") for c in fields])
    new = rows.join(r, "id", "left").select(
        *[F.when(F.col("_hit"), F.coalesce(f"_{c}", c)).otherwise(F.col(c)).alias(c) if c in fields else F.col(c)
          for c in rows.columns])
    out = t.replace(**{parent: new})
    if "kelas" in requests.columns:
        bridge = BRIDGE_OF[parent]
        lists = last.where(F.col("kelas").isNotNull()).select(
            "request_id", F.col("id").alias(BRIDGES[bridge][0]), "kelas")
        out = replace_bridge(out, bridge, lists).tables
    return Change(out, _union([_reject(superseded, "superseded"), _reject(denied, "not_owner_or_missing")]),
                  {"accepted": last.select("request_id", "id")})


# ---------------------------------------------------------- W13 delete cascade
def delete_owned(t: Tables, parent: str, requests: DataFrame) -> Change:
    """Requests ``(request_id, id, owner_id)`` to delete assignments, threads
    or courses.  Only the row's author may; others, and ids that do not
    exist, are refused.  The accepted rows go with all that hangs on them."""
    own = t[parent].select("id", F.col("created_by").alias("owner_id"))
    ok = _cut(requests.join(own, ["id", "owner_id"], "left_semi"))
    denied = requests.join(ok.select("request_id"), "request_id", "left_anti")
    gone = delete_cascade(t, {parent: ok.select("id")})
    return Change(gone.tables, _reject(denied, "not_owner_or_missing"), {"accepted": ok.select("request_id", "id")})


def delete_cascade(t: Tables, deletes: dict[str, DataFrame]) -> Change:
    """Delete rows by id (``deletes``: table -> frame with an ``id`` column)
    and follow every foreign key: CASCADE removes child rows, SET NULL
    (course author, student class) clears the reference.  Parents are
    resolved top-down (users -> details/assignments/threads -> bridges and
    leaves), each level an anti join against the deleted key set, which is
    written once and read by all its children."""
    def ids(name):
        d = deletes.get(name)
        return None if d is None else _cut(d.select(F.col("id").cast("bigint").alias("id")).distinct())

    def gone(df, col, *key_sets):
        sets = [k for k in key_sets if k is not None]
        for k in sets:
            df = df.join(k.withColumnRenamed("id", col), col, "left_anti")
        return df

    def setnull(df, col, keys):
        if keys is None:
            return df
        hit = keys.select(F.col("id").alias(col), F.lit(True).alias("_hit"))
        return (df.join(hit, col, "left").withColumn(col, F.when(F.col("_hit"), F.lit(None)).otherwise(F.col(col))
                                                      .cast(dict(df.dtypes)[col]))
                .drop("_hit").select(*df.columns))

    d_users, d_kelas = ids("users"), ids("kelas")
    users = gone(t.users, "id", d_users)
    kelas = gone(t.kelas, "id", d_kelas)

    def cascaded(table, owner_col):
        own = ids(table)
        by_user = t[table].join(d_users.withColumnRenamed("id", owner_col), owner_col, "left_semi").select("id") \
            if d_users is not None else None
        parts = [p for p in (own, by_user) if p is not None]
        return _cut(reduce(DataFrame.unionByName, parts).distinct()) if parts else None

    d_guru = cascaded("guru_details", "user_id")
    d_tugas = cascaded("tugas", "created_by")
    d_disk = cascaded("diskusi", "created_by")
    d_course = ids("courses")
    out = dict(
        users=users, kelas=kelas,
        verifications=gone(t.verifications, "user_id", d_users),
        activity_logs=gone(t.activity_logs, "user_id", d_users),
        siswa_details=setnull(gone(t.siswa_details, "user_id", d_users), "kelas_id", d_kelas),
        guru_details=gone(t.guru_details, "id", d_guru),
        guru_kelas=gone(t.guru_kelas, "guru_id", d_guru) if d_kelas is None
        else gone(gone(t.guru_kelas, "guru_id", d_guru), "kelas_id", d_kelas),
        courses=setnull(gone(t.courses, "id", d_course), "created_by", d_users),
        course_kelas=gone(t.course_kelas, "course_id", d_course) if d_kelas is None
        else gone(gone(t.course_kelas, "course_id", d_course), "kelas_id", d_kelas),
        course_enrollments=gone(gone(t.course_enrollments, "course_id", d_course), "student_id", d_users),
        tugas=gone(t.tugas, "id", d_tugas),
        tugas_kelas=gone(t.tugas_kelas, "tugas_id", d_tugas) if d_kelas is None
        else gone(gone(t.tugas_kelas, "tugas_id", d_tugas), "kelas_id", d_kelas),
        pengumpulan_tugas=gone(gone(t.pengumpulan_tugas, "tugas_id", d_tugas), "siswa_id", d_users),
        diskusi=gone(t.diskusi, "id", d_disk),
        diskusi_kelas=gone(t.diskusi_kelas, "diskusi_id", d_disk) if d_kelas is None
        else gone(gone(t.diskusi_kelas, "diskusi_id", d_disk), "kelas_id", d_kelas),
        chat_diskusi=gone(gone(t.chat_diskusi, "diskusi_id", d_disk), "user_id", d_users),
    )
    return Change(t.replace(**out), _no_rejects(t))


def row_counts(t: Tables, names=None) -> DataFrame:
    """Rows per table of a snapshot (one small aggregate per table)."""
    names = names or list(t.frames)
    return _union([t[n].agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(n).alias("table_name"), "n_rows")
                   for n in names])


# ------------------------------------------------------- W14 / W15 appends
def append_messages(t: Tables, requests: DataFrame) -> Change:
    """Requests ``(request_id, diskusi_id, user_id, isi, created_at)``; blank
    messages, unknown threads and unknown users are refused; ids = max + rank."""
    blank = requests.where(F.coalesce(F.col("isi"), F.lit("")) == "")
    ok = requests.where(F.coalesce(F.col("isi"), F.lit("")) != "")
    unknown = ok.join(t.diskusi.select(F.col("id").alias("diskusi_id")), "diskusi_id", "left_anti")
    ok = ok.join(t.diskusi.select(F.col("id").alias("diskusi_id")), "diskusi_id", "left_semi")
    ok, nobody = _existing(ok, "user_id", t.users, "unknown_user")
    ided = assign_ids(ok, ["request_id"], next_id(t.chat_diskusi))
    rows = ided.select(*t.chat_diskusi.columns)
    return Change(t.replace(chat_diskusi=t.chat_diskusi.unionByName(rows)),
                  _union([_reject(blank, "blank_message"), _reject(unknown, "unknown_thread"), nobody]),
                  {"chat_diskusi": rows, "accepted": ided.select("request_id", "id")})


SIGN_IN_ACTIONS = {"admin": "Admin logged in", "default": "User logged in"}  # fixed texts of the reference


def log_sign_ins(t: Tables, events: DataFrame) -> Change:
    """``(request_id, user_id, created_at)`` sign-ins -> log rows with
    the role-dependent action text; users that do not exist are refused."""
    role = t.users.select(F.col("id").alias("user_id"), "role")
    known, nobody = _existing(events, "user_id", t.users, "unknown_user")
    ev = known.join(role, "user_id")
    act = F.when(F.col("role") == "admin", SIGN_IN_ACTIONS["admin"]).otherwise(SIGN_IN_ACTIONS["default"])
    rows = assign_ids(ev.withColumn("action", act), ["request_id"], next_id(t.activity_logs))
    rows = rows.select(*t.activity_logs.columns)
    return Change(t.replace(activity_logs=t.activity_logs.unionByName(rows)), nobody, {"activity_logs": rows})
