"""Registered change jobs (W01, W08, W10, W11, W13) with request frames
derived from the test tables.  The request builders only shape rows into the
request schema; the jobs do the work."""

import datetime as dt

from pyspark.sql import functions as F

from kelasflow.operators import changes as W
from kelasflow.plans.registry import register

SUBMIT_CUTOFF = "1995-06-17 00:00:00"   # submissions before it form the snapshot
APPLY_AT = dt.datetime(2024, 1, 31, 8, 0)


# An admin types class names: subject (region) names padded with
# blanks (new classes), existing class names in lower case (matched
# case-insensitively) and blank entries (ignored).
@register("w01_find_or_create_classes", """
SELECT raw, k2.id AS kelas_id FROM reqs r
LEFT JOIN (SELECT id, lower(nama_kelas) AS key FROM kelas
           UNION ALL SELECT id, key FROM created) k2 ON k2.key = lower(nullif(trim(r.raw), ''))
""", ctes="""
subj AS (SELECT DISTINCT mapel FROM guru_details),
reqs AS (SELECT '  ' || mapel || ' ' AS raw FROM subj
         UNION ALL SELECT lower(nama_kelas) FROM kelas
         UNION ALL SELECT '   ' FROM subj),
wanted AS (SELECT lower(nullif(trim(raw), '')) AS key, min(nullif(trim(raw), '')) AS nama_kelas FROM reqs
           WHERE nullif(trim(raw), '') IS NOT NULL GROUP BY 1),
created AS (SELECT (SELECT max(id) FROM kelas) + row_number() OVER (ORDER BY key) AS id, key, nama_kelas
            FROM wanted w WHERE NOT EXISTS (SELECT 1 FROM kelas k WHERE lower(k.nama_kelas) = w.key))
""")
def w01(t):
    regions = t.guru_details.select("mapel").distinct()
    reqs = (regions.select(F.concat(F.lit("  "), F.col("mapel"), F.lit(" ")).alias("raw"))
            .unionByName(t.kelas.select(F.lower("nama_kelas").alias("raw")))
            .unionByName(regions.select(F.lit("   ").alias("raw"))))
    _, resolved = W.find_or_create_classes(t, reqs, "raw")
    return resolved.select("raw", "kelas_id")


# Every pending verification gets a reviewer decision; a third are left
# "pending", which a reviewer may not set (rejected as invalid).
_DECISION = "CASE id % 3 WHEN 0 THEN 'approved' WHEN 1 THEN 'rejected' ELSE 'pending' END"


def _decisions(t):
    return (t.verifications.where(F.col("status") == "pending")
            .select(F.col("id").alias("request_id"), F.col("id").alias("verification_id"),
                    F.expr(_DECISION).alias("status")))


@register("w08_verification_transition", f"""
SELECT request_id, CASE WHEN status IN ('approved', 'rejected') THEN status ELSE 'invalid_status' END AS outcome
FROM (SELECT id AS request_id, {_DECISION} AS status FROM verifications WHERE status = 'pending')
""")
def w08(t):
    ch = W.verification_transition(t, _decisions(t), APPLY_AT)
    applied = _decisions(t).join(ch.rejects, "request_id", "left_anti").select("request_id",
                                                                               F.col("status").alias("outcome"))
    return applied.unionByName(ch.rejects.withColumnRenamed("reason", "outcome"))


@register("w08_verification_logs", f"""
SELECT (SELECT max(id) FROM activity_logs) + row_number() OVER (ORDER BY id) AS id, user_id,
       'Verification ' || s AS action
FROM (SELECT id, user_id, {_DECISION} AS s FROM verifications WHERE status = 'pending')
WHERE s IN ('approved', 'rejected')
""")
def w08_logs(t):
    ch = W.verification_transition(t, _decisions(t), APPLY_AT)
    return ch.emitted["activity_logs"].select("id", "user_id", "action")


# Submissions before the cutoff are the snapshot, later ones arrive as
# requests (the same pair may arrive again; first one wins).
def _submit_split(t):
    pt = t.pengumpulan_tugas
    cut = F.expr(f"TIMESTAMP_NTZ'{SUBMIT_CUTOFF}'")
    snap = t.replace(pengumpulan_tugas=pt.where(F.col("dikumpulkan_at") < cut))
    reqs = pt.where(F.col("dikumpulkan_at") >= cut).select(
        F.col("id").alias("request_id"), "tugas_id", "siswa_id", "file_path",
        F.col("dikumpulkan_at").alias("submitted_at"))
    return snap, reqs


@register("w10_submit_first_wins", f"""
SELECT request_id, 'already_submitted' AS outcome FROM req r
WHERE EXISTS (SELECT 1 FROM existing e WHERE e.tugas_id = r.tugas_id AND e.siswa_id = r.siswa_id)
UNION ALL
SELECT request_id, CASE WHEN rn = 1 THEN 'accepted' ELSE 'duplicate_in_batch' END
FROM (SELECT r.*, row_number() OVER (PARTITION BY tugas_id, siswa_id ORDER BY submitted_at, request_id) AS rn
      FROM req r WHERE NOT EXISTS (SELECT 1 FROM existing e WHERE e.tugas_id = r.tugas_id AND e.siswa_id = r.siswa_id))
""", ctes=f"""
existing AS (SELECT * FROM pengumpulan_tugas WHERE dikumpulkan_at < TIMESTAMP '{SUBMIT_CUTOFF}'),
req AS (SELECT id AS request_id, tugas_id, siswa_id, file_path, dikumpulkan_at AS submitted_at
        FROM pengumpulan_tugas WHERE dikumpulkan_at >= TIMESTAMP '{SUBMIT_CUTOFF}')
""")
def w10(t):
    snap, reqs = _submit_split(t)
    ch = W.submit_first_wins(snap, reqs)
    ok = ch.emitted["accepted"].select("request_id", F.lit("accepted").alias("outcome"))
    return ok.unionByName(ch.rejects.withColumnRenamed("reason", "outcome"))


# A grade arrives for every ungraded submission row.
def _grade_requests(t):
    return (t.pengumpulan_tugas.where(F.col("nilai").isNull())
            .select(F.col("id").alias("request_id"), "tugas_id", "siswa_id",
                    (F.col("id") % 101).cast("int").alias("nilai")))


@register("w11_post_grades", """
SELECT p.id, p.tugas_id, p.siswa_id, CASE WHEN l.request_id IS NOT NULL THEN l.nilai ELSE p.nilai END AS nilai
FROM pengumpulan_tugas p
LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tugas_id, siswa_id ORDER BY request_id DESC) AS rn
                          FROM req) WHERE rn = 1) l
  ON l.tugas_id = p.tugas_id AND l.siswa_id = p.siswa_id
""", ctes="""
req AS (SELECT id AS request_id, tugas_id, siswa_id, CAST(id % 101 AS INTEGER) AS nilai
        FROM pengumpulan_tugas WHERE nilai IS NULL)
""")
def w11(t):
    ch = W.post_grades(t, _grade_requests(t))
    return ch.tables.pengumpulan_tugas.select("id", "tugas_id", "siswa_id", "nilai")


# Delete every teacher account that has no class assignment.
def _idle_teachers(t):
    with_class = t.guru_details.join(t.guru_kelas.select(F.col("guru_id").alias("id")), "id", "left_semi")
    return (t.users.where(F.col("role") == "guru")
            .join(with_class.select(F.col("user_id").alias("id")), "id", "left_anti").select("id"))


_COUNTS_AFTER_DELETE = """
SELECT 'users' AS table_name, count(*) AS n_rows FROM users WHERE id NOT IN (SELECT id FROM del)
UNION ALL SELECT 'kelas', count(*) FROM kelas
UNION ALL SELECT 'verifications', count(*) FROM verifications v WHERE NOT EXISTS (SELECT 1 FROM del WHERE del.id = v.user_id)
UNION ALL SELECT 'activity_logs', count(*) FROM activity_logs a WHERE NOT EXISTS (SELECT 1 FROM del WHERE del.id = a.user_id)
UNION ALL SELECT 'siswa_details', count(*) FROM siswa_details s WHERE NOT EXISTS (SELECT 1 FROM del WHERE del.id = s.user_id)
UNION ALL SELECT 'guru_details', count(*) FROM guru_details g WHERE NOT EXISTS (SELECT 1 FROM del WHERE del.id = g.user_id)
UNION ALL SELECT 'guru_kelas', count(*) FROM guru_kelas gk WHERE NOT EXISTS (SELECT 1 FROM dgd WHERE dgd.id = gk.guru_id)
UNION ALL SELECT 'courses', count(*) FROM courses
UNION ALL SELECT 'courses.created_by_null', count(*) FROM courses c
  WHERE c.created_by IS NULL OR EXISTS (SELECT 1 FROM del WHERE del.id = c.created_by)
UNION ALL SELECT 'course_kelas', count(*) FROM course_kelas
UNION ALL SELECT 'course_enrollments', count(*) FROM course_enrollments ce
  WHERE NOT EXISTS (SELECT 1 FROM del WHERE del.id = ce.student_id)
UNION ALL SELECT 'tugas', count(*) FROM tugas t WHERE NOT EXISTS (SELECT 1 FROM dtg WHERE dtg.id = t.id)
UNION ALL SELECT 'tugas_kelas', count(*) FROM tugas_kelas tk WHERE NOT EXISTS (SELECT 1 FROM dtg WHERE dtg.id = tk.tugas_id)
UNION ALL SELECT 'pengumpulan_tugas', count(*) FROM pengumpulan_tugas p
  WHERE NOT EXISTS (SELECT 1 FROM dtg WHERE dtg.id = p.tugas_id) AND NOT EXISTS (SELECT 1 FROM del WHERE del.id = p.siswa_id)
UNION ALL SELECT 'diskusi', count(*) FROM diskusi d WHERE NOT EXISTS (SELECT 1 FROM ddk WHERE ddk.id = d.id)
UNION ALL SELECT 'diskusi_kelas', count(*) FROM diskusi_kelas dk WHERE NOT EXISTS (SELECT 1 FROM ddk WHERE ddk.id = dk.diskusi_id)
UNION ALL SELECT 'chat_diskusi', count(*) FROM chat_diskusi c
  WHERE NOT EXISTS (SELECT 1 FROM ddk WHERE ddk.id = c.diskusi_id) AND NOT EXISTS (SELECT 1 FROM del WHERE del.id = c.user_id)
"""


@register("w13_delete_cascade_counts", _COUNTS_AFTER_DELETE, ctes="""
del AS (SELECT u.id FROM users u WHERE u.role = 'guru' AND NOT EXISTS (
          SELECT 1 FROM guru_details g JOIN guru_kelas gk ON gk.guru_id = g.id WHERE g.user_id = u.id)),
dgd AS (SELECT id FROM guru_details WHERE user_id IN (SELECT id FROM del)),
dtg AS (SELECT id FROM tugas WHERE created_by IN (SELECT id FROM del)),
ddk AS (SELECT id FROM diskusi WHERE created_by IN (SELECT id FROM del))
""")
def w13(t):
    ch = W.delete_cascade(t, {"users": _idle_teachers(t)})
    n = ch.tables
    counts = W.row_counts(n, [x for x in n.frames])
    nulls = n.courses.where(F.col("created_by").isNull()).agg(F.count(F.lit(1)).alias("n_rows")) \
        .select(F.lit("courses.created_by_null").alias("table_name"), "n_rows")
    return counts.unionByName(nulls)


# ---------------------------------------------------------------- create jobs
# Replay: the snapshot holds the people who joined before the cutoff; every
# person of the tables then arrives as a request (e-mail upper-cased), so
# earlier ones collide with the snapshot and later ones are created.
JOIN_CUTOFF = {"users": "1995-06-21 00:00:00", "siswa": "1995-06-21 00:00:00", "guru": "1995-01-06 00:00:00"}


def _joined_before(kind):
    return F.col("created_at") < F.expr(f"TIMESTAMP_NTZ'{JOIN_CUTOFF[kind]}'")


def _outcomes(ch, id_col):
    ok = ch.emitted["accepted"].select("request_id", F.lit("created").alias("outcome"),
                                       F.col(id_col).alias("new_id"))
    return ok.unionByName(ch.rejects.select("request_id", F.col("reason").alias("outcome"),
                                            F.lit(None).cast("bigint").alias("new_id")))


def _replay_ctes(src: str, kinds: list[tuple[str, str, bool]]) -> str:
    """CTEs that replay the requests of ``src`` (request_id, user_id, one column
    per kind) on what ``held`` holds: ``verdicts`` has '' or the refusal.

    ``kinds``: name, SELECT of (u, key) held, whether a NULL keeps the old
    value.  A step decides every open request that is the first of its user,
    of the values it claims and of those its user holds; the keyed state has
    the holder of a value (h), the value of a user (u) and the verdicts (r).
    """
    claims = " UNION ALL ".join(
        f"SELECT request_id AS t, user_id AS u, '{k}' AS kind, {i} AS nr, lower({k}) AS key FROM {src}"
        + (f" WHERE {k} IS NOT NULL" if keeps else "") for i, (k, _, keeps) in enumerate(kinds))
    held = " UNION ALL ".join(f"SELECT '{k}' AS kind, u, lower(key) AS key FROM ({sql})" for k, sql, _ in kinds)
    return f"""
claims AS MATERIALIZED ({claims}),
held AS (SELECT * FROM ({held}) WHERE key IS NOT NULL AND (kind, key) IN (SELECT kind, key FROM claims)
         UNION SELECT * FROM ({held}) WHERE key IS NOT NULL AND (kind, u) IN (SELECT kind, u FROM claims)),
replay(k, who, word) USING KEY (k) AS (
  SELECT 'h|' || kind || '|' || key, u, 'taken' FROM held
  UNION ALL SELECT 'u|' || kind || '|' || u, u, key FROM held
  UNION
  (WITH open AS (SELECT * FROM claims WHERE 'r|' || t NOT IN (SELECT k FROM recurring.replay)),
   own AS (SELECT o.*, s.word AS had FROM open o LEFT JOIN recurring.replay s ON s.k = 'u|' || o.kind || '|' || o.u),
   res AS (SELECT t, 'U' || u AS r FROM open UNION SELECT t, kind || key FROM open WHERE key IS NOT NULL
           UNION SELECT t, kind || had FROM own WHERE had IS NOT NULL),
   late AS (SELECT DISTINCT t FROM (SELECT t, min(t) OVER (PARTITION BY r) AS m FROM res) WHERE m < t),
   now AS (SELECT o.*, s.word AS how, s.who FROM own o LEFT JOIN recurring.replay s ON s.k = 'h|' || o.kind || '|' || o.key
           WHERE o.t NOT IN (SELECT t FROM late)),
   ver AS (SELECT t, coalesce(arg_min(kind || '_' || how, nr) FILTER (who IS NOT NULL AND who <> u), '') AS reason
           FROM now GROUP BY t),
   chg AS (SELECT now.* FROM now JOIN ver USING (t) WHERE reason = '' AND had IS DISTINCT FROM now.key)
   SELECT 'r|' || t, t, reason FROM ver
   UNION ALL SELECT 'h|' || kind || '|' || had, NULL, 'free' FROM chg WHERE had IS NOT NULL
   UNION ALL SELECT 'h|' || kind || '|' || key, u, 'taken_in_batch' FROM chg WHERE key IS NOT NULL
   UNION ALL SELECT 'u|' || kind || '|' || u, u, key FROM chg)),
verdicts AS (SELECT request_id, coalesce(replay.word, '') AS reason FROM {src} LEFT JOIN replay ON k = 'r|' || request_id)
"""


def _create_sql(req_cte: str, kind: str, admin_rule: bool = False,
                detail: str | None = None, held_sql: str | None = None, snap: str | None = None) -> tuple[str, str]:
    """(body, ctes) of the oracle shared by the create jobs: the requests are
    replayed one by one, each a person of its own; new ids = snapshot max +
    rank of request id."""
    body = """
SELECT request_id, 'created' AS outcome,
       coalesce((SELECT max(id) FROM snap), 0) + row_number() OVER (ORDER BY request_id) AS new_id
FROM verdicts WHERE reason = ''
UNION ALL SELECT request_id, reason, NULL FROM verdicts WHERE reason <> ''
""" + ("UNION ALL SELECT request_id, 'admin_not_allowed', NULL FROM req WHERE role = 'admin'\n" if admin_rule else "")
    kinds = [("email", "SELECT -1 AS u, email AS key FROM snap", True)]
    if detail:
        kinds.append((detail, f"SELECT -1 AS u, {detail} AS key FROM ({held_sql})", True))
    ctes = f"""
snap AS ({snap or f"SELECT * FROM users WHERE created_at < TIMESTAMP '{JOIN_CUTOFF[kind]}'"}),
req AS ({req_cte}),
asked AS (SELECT *, request_id AS user_id FROM req {"WHERE role <> 'admin'" if admin_rule else ""}),
{_replay_ctes("asked", kinds)}
"""
    return body, ctes


_W09 = _create_sql("SELECT id AS request_id, name, upper(email) AS email, role FROM users", "users",
                   admin_rule=True)


@register("w09_register_users", _W09[0], ctes=_W09[1])
def w09(t):
    snap = t.replace(users=t.users.where(_joined_before("users")))
    req = t.users.select(F.col("id").alias("request_id"), "name", F.upper("email").alias("email"), "role")
    return _outcomes(W.register_users(snap, req, APPLY_AT), "user_id")


_W03 = _create_sql("""SELECT u.id AS request_id, u.name, upper(u.email) AS email, sd.nisn, sd.jurusan,
       k.nama_kelas AS kelas
FROM users u LEFT JOIN siswa_details sd ON sd.user_id = u.id LEFT JOIN kelas k ON k.id = sd.kelas_id
WHERE u.role = 'siswa'""", "siswa", detail="nisn",
                   held_sql="SELECT nisn FROM siswa_details WHERE user_id IN (SELECT id FROM snap)")


def _student_requests(t):
    sd = t.siswa_details.select(F.col("user_id").alias("request_id"), "nisn", "jurusan", "kelas_id")
    k = t.kelas.select(F.col("id").alias("kelas_id"), F.col("nama_kelas").alias("kelas"))
    return (t.users.where(F.col("role") == "siswa")
            .select(F.col("id").alias("request_id"), "name", F.upper("email").alias("email"))
            .join(sd, "request_id", "left").join(k, "kelas_id", "left").drop("kelas_id"))


@register("w03_student_create", _W03[0], ctes=_W03[1])
def w03(t):
    before = t.users.where(_joined_before("siswa"))
    snap = t.replace(users=before,
                     siswa_details=t.siswa_details.join(before.select(F.col("id").alias("user_id")), "user_id",
                                                        "left_semi"))
    return _outcomes(W.student_create(snap, _student_requests(t), APPLY_AT), "user_id")


_W04 = _create_sql("""SELECT u.id AS request_id, u.name, upper(u.email) AS email, gd.nip, gd.mapel
FROM users u LEFT JOIN guru_details gd ON gd.user_id = u.id WHERE u.role = 'guru'""", "guru", detail="nip",
                   held_sql="SELECT nip FROM guru_details WHERE user_id IN (SELECT id FROM snap)")


@register("w04_teacher_create", _W04[0], ctes=_W04[1])
def w04(t):
    before = t.users.where(_joined_before("guru"))
    snap = t.replace(users=before,
                     guru_details=t.guru_details.join(before.select(F.col("id").alias("user_id")), "user_id",
                                                      "left_semi"))
    gd = t.guru_details.select(F.col("user_id").alias("request_id"), "nip", "mapel")
    req = (t.users.where(F.col("role") == "guru")
           .select(F.col("id").alias("request_id"), "name", F.upper("email").alias("email"))
           .join(gd, "request_id", "left"))
    return _outcomes(W.teacher_create(snap, req, APPLY_AT), "user_id")


# W03 / W04 with clashes: every verification (assignment) asks for a new
# person; e-mails and numbers repeat within the batch and in the tables, so a
# value is free again for a later request when the earlier one was refused.
_NEW_STUDENTS = """
SELECT id AS request_id, 'Baru ' || id AS name,
       CASE WHEN id % 5 = 0 THEN 'CUSTOMER#' || lpad(CAST(id % 2000 AS VARCHAR), 9, '0') || '@siswa.example.org'
            ELSE 'Baru' || (id * 7 % 1900) || '@siswa.example.org' END AS email,
       CASE WHEN id % 4 <> 0 THEN (CASE WHEN id % 9 = 0 THEN '' ELSE 's' END) || lpad(CAST(id % 3000 AS VARCHAR), 10, '0') END AS nisn
FROM verifications"""
_W03_CLASH = _create_sql(_NEW_STUDENTS, "siswa", detail="nisn", held_sql="SELECT nisn FROM siswa_details",
                         snap="SELECT * FROM users")


def _new_students(t):
    i = F.col("id")
    return t.verifications.select(
        i.alias("request_id"), F.concat(F.lit("Baru "), i.cast("string")).alias("name"),
        F.when(i % 5 == 0, F.concat(F.lit("CUSTOMER#"), F.lpad((i % 2000).cast("string"), 9, "0")))
        .otherwise(F.concat(F.lit("Baru"), (i * 7 % 1900).cast("string"))).alias("_who"),
        F.when(i % 4 != 0, F.concat(F.when(i % 9 == 0, "").when(i % 2 == 0, "S").otherwise("s"),
                                    F.lpad((i % 3000).cast("string"), 10, "0"))).alias("nisn"),
        F.col("status").alias("jurusan"), F.lit(None).cast("string").alias("kelas")).withColumn(
        "email", F.concat("_who", F.lit("@siswa.example.org"))).drop("_who")


@register("w03_student_create_clashes", _W03_CLASH[0], ctes=_W03_CLASH[1])
def w03_clashes(t):
    return _outcomes(W.student_create(t, _new_students(t), APPLY_AT), "user_id")


_W04_CLASH = _create_sql("""
SELECT id AS request_id, 'Guru baru ' || id AS name, 'Supplier#' || lpad(CAST(id % 400 AS VARCHAR), 9, '0') || '@guru.example.org' AS email,
       lpad(CAST(id * 3 % 700 AS VARCHAR), 18, '0') AS nip FROM tugas""", "guru", detail="nip",
                         held_sql="SELECT nip FROM guru_details", snap="SELECT * FROM users")


@register("w04_teacher_create_clashes", _W04_CLASH[0], ctes=_W04_CLASH[1])
def w04_clashes(t):
    i = F.col("id")
    req = t.tugas.select(
        i.alias("request_id"), F.concat(F.lit("Guru baru "), i.cast("string")).alias("name"),
        F.concat(F.lit("Supplier#"), F.lpad((i % 400).cast("string"), 9, "0"), F.lit("@guru.example.org")).alias("email"),
        F.lpad((i * 3 % 700).cast("string"), 18, "0").alias("nip"), F.col("deskripsi").alias("mapel"))
    return _outcomes(W.teacher_create(t, req, APPLY_AT), "user_id")


# Assignments created after the cutoff arrive as create requests with
# their class names as one comma-separated field.
TASK_CUTOFF = "1996-01-01 00:00:00"


@register("w07_create_assignments", f"""
SELECT a.request_id, a.new_id AS tugas_id, k.id AS kelas_id
FROM acc a LEFT JOIN names n ON n.request_id = a.request_id
LEFT JOIN kelas k ON lower(k.nama_kelas) = lower(n.name)
WHERE n.name IS NULL OR k.id IS NOT NULL
""", ctes=f"""
snap AS (SELECT * FROM tugas WHERE created_at < TIMESTAMP '{TASK_CUTOFF}'),
req AS (SELECT t.id AS request_id, t.judul, t.deskripsi, t.deadline, t.file_path, t.created_by,
               (SELECT string_agg(k.nama_kelas, ',' ORDER BY k.nama_kelas) FROM tugas_kelas tk
                  JOIN kelas k ON k.id = tk.kelas_id WHERE tk.tugas_id = t.id) AS kelas
        FROM tugas t WHERE t.created_at >= TIMESTAMP '{TASK_CUTOFF}'),
acc AS (SELECT request_id, kelas,
               coalesce((SELECT max(id) FROM snap), 0) + row_number() OVER (ORDER BY request_id) AS new_id
        FROM req WHERE coalesce(trim(judul), '') <> '' AND coalesce(trim(deskripsi), '') <> ''
          AND deadline IS NOT NULL),
names AS (SELECT DISTINCT request_id, name FROM (
            SELECT request_id, nullif(trim(s), '') AS name
            FROM (SELECT request_id, unnest(string_split(kelas, ',')) AS s FROM acc)) WHERE name IS NOT NULL)
""")
def w07(t):
    cut = F.col("created_at") < F.expr(f"TIMESTAMP_NTZ'{TASK_CUTOFF}'")
    snap_tugas = t.tugas.where(cut)
    snap = t.replace(tugas=snap_tugas,
                     tugas_kelas=t.tugas_kelas.join(snap_tugas.select(F.col("id").alias("tugas_id")), "tugas_id",
                                                    "left_semi"))
    k = t.kelas.select(F.col("id").alias("kelas_id"), "nama_kelas")
    csv = (t.tugas_kelas.join(k, "kelas_id").groupBy("tugas_id")
           .agg(F.array_join(F.array_sort(F.collect_list("nama_kelas")), ",").alias("kelas")))
    req = (t.tugas.where(~cut).join(csv, t.tugas.id == csv.tugas_id, "left")
           .select(F.col("id").alias("request_id"), "judul", "deskripsi", "deadline", "file_path", "created_by",
                   "kelas"))
    ch = W.create_with_classes(snap, "tugas", req, APPLY_AT)
    acc = ch.emitted["accepted"].select("request_id", F.col("id").alias("tugas_id"))
    links = ch.emitted["links"].select("request_id", "kelas_id")
    return acc.join(links, "request_id", "left").select("request_id", "tugas_id", "kelas_id")


# Messages after the cutoff arrive as append requests.
CHAT_CUTOFF = "2024-01-03 00:00:00"


@register("w14_append_messages", f"""
SELECT request_id, coalesce((SELECT max(id) FROM chat_diskusi WHERE created_at < TIMESTAMP '{CHAT_CUTOFF}'), 0)
         + row_number() OVER (ORDER BY request_id) AS new_id
FROM (SELECT id AS request_id FROM chat_diskusi c
      WHERE c.created_at >= TIMESTAMP '{CHAT_CUTOFF}' AND coalesce(c.isi, '') <> ''
        AND c.diskusi_id IN (SELECT id FROM diskusi))
""")
def w14(t):
    cut = F.col("created_at") < F.expr(f"TIMESTAMP_NTZ'{CHAT_CUTOFF}'")
    snap = t.replace(chat_diskusi=t.chat_diskusi.where(cut))
    req = t.chat_diskusi.where(~cut).select(F.col("id").alias("request_id"), "diskusi_id", "user_id", "isi",
                                            "created_at")
    ch = W.append_messages(snap, req)
    return ch.emitted["accepted"].select("request_id", F.col("id").alias("new_id"))


# Every thread's classes are replaced by the classes its author teaches.
@register("w06_replace_thread_classes", """
SELECT id, diskusi_id, kelas_id FROM diskusi_kelas WHERE diskusi_id NOT IN (SELECT diskusi_id FROM req)
UNION ALL
SELECT (SELECT max(id) FROM diskusi_kelas) + row_number() OVER (ORDER BY diskusi_id, kelas_id), diskusi_id, kelas_id
FROM pairs
""", ctes="""
req AS (SELECT d.id AS request_id, d.id AS diskusi_id,
               (SELECT string_agg(k.nama_kelas, ',' ORDER BY k.nama_kelas) FROM guru_details g
                  JOIN guru_kelas gk ON gk.guru_id = g.id JOIN kelas k ON k.id = gk.kelas_id
                WHERE g.user_id = d.created_by) AS kelas
        FROM diskusi d),
names AS (SELECT diskusi_id, nullif(trim(s), '') AS name
          FROM (SELECT diskusi_id, unnest(string_split(kelas, ',')) AS s FROM req)),
pairs AS (SELECT DISTINCT n.diskusi_id, k.id AS kelas_id FROM names n JOIN kelas k ON lower(k.nama_kelas) = lower(n.name))
""")
def w06(t):
    k = t.kelas.select(F.col("id").alias("kelas_id"), "nama_kelas")
    teaches = (t.guru_details.select(F.col("id").alias("guru_id"), F.col("user_id").alias("created_by"))
               .join(t.guru_kelas.select("guru_id", "kelas_id"), "guru_id").join(k, "kelas_id")
               .groupBy("created_by").agg(F.array_join(F.array_sort(F.collect_list("nama_kelas")), ",")
                                          .alias("kelas")))
    req = (t.diskusi.join(teaches, "created_by", "left")
           .select(F.col("id").alias("request_id"), F.col("id").alias("diskusi_id"), "kelas"))
    ch = W.replace_bridge(t, "diskusi_kelas", req)
    return ch.tables.diskusi_kelas.select("id", "diskusi_id", "kelas_id")


# Every chat message is also a request to replace its thread's body with
# the message text, sent by the message's author; only the thread's author
# may do so, and of the author's requests the last one wins.
@register("w12_owner_checked_thread_edit", """
SELECT d.id, d.judul, coalesce(l.isi, d.isi) AS isi, d.created_by, d.created_at
FROM diskusi d LEFT JOIN (
  SELECT * FROM (SELECT r.*, row_number() OVER (PARTITION BY r.id ORDER BY r.request_id DESC) AS rn
                 FROM req r JOIN diskusi d2 ON d2.id = r.id AND d2.created_by = r.owner_id) WHERE rn = 1) l
  ON l.id = d.id
""", ctes="req AS (SELECT id AS request_id, diskusi_id AS id, user_id AS owner_id, isi FROM chat_diskusi)")
def w12(t):
    req = t.chat_diskusi.select(F.col("id").alias("request_id"), F.col("diskusi_id").alias("id"),
                                F.col("user_id").alias("owner_id"), "isi")
    ch = W.update_owned(t, "diskusi", req)
    return ch.tables.diskusi.select("id", "judul", "isi", "created_by", "created_at")


# Every user allowed to sign in (Q41's rule) signs in once at APPLY_AT.
@register("w15_sign_in_logs", """
SELECT (SELECT max(id) FROM activity_logs) + row_number() OVER (ORDER BY u.id) AS id, u.id AS user_id,
       CASE WHEN u.role = 'admin' THEN 'Admin logged in' ELSE 'User logged in' END AS action
FROM users u
LEFT JOIN (SELECT user_id, status,
                  row_number() OVER (PARTITION BY user_id ORDER BY requested_at DESC, id DESC) AS rn
           FROM verifications) lv ON lv.user_id = u.id AND lv.rn = 1
WHERE u.role = 'admin' OR coalesce(lv.status = 'approved', FALSE)
""")
def w15(t):
    from kelasflow.operators import activity
    ok = activity.latest_verification(t).where("login_eligible")
    ev = ok.select(F.col("user_id").alias("request_id"), "user_id",
                   F.expr(f"TIMESTAMP_NTZ'{APPLY_AT.isoformat(sep=' ')}'").alias("created_at"))
    ch = W.log_sign_ins(t, ev)
    return ch.emitted["activity_logs"].select("id", "user_id", "action")


# Save requests made of the verifications and assignments, several
# per person, with values that others hold, values claimed twice, new values,
# new classes and people who do not exist.
_W02_REQ = f"""
req AS (SELECT id AS request_id, user_id + CASE WHEN id % 7 = 0 THEN 5000000 ELSE 0 END AS user_id,
               'Siswa ' || CAST(id AS VARCHAR) AS name,
               CASE WHEN id % 3 = 0 THEN 'Siswa' || CAST(id % 900 AS VARCHAR) || '@siswa.example.org' END AS email,
               lpad(CAST(id % 4000 AS VARCHAR), 10, '0') AS nisn, status AS jurusan,
               ' kelas_' || CAST(25 + id % 60 AS VARCHAR) AS kelas FROM verifications),
known AS (SELECT * FROM req WHERE user_id IN (SELECT id FROM users)),
{_replay_ctes("known", [("email", "SELECT id AS u, email AS key FROM users", True),
                        ("nisn", "SELECT user_id AS u, nisn AS key FROM siswa_details", False)])},
valid AS (SELECT known.* FROM known JOIN verdicts USING (request_id) WHERE reason = ''),
said AS (SELECT user_id, arg_max(name, request_id) AS name, arg_max(email, request_id) FILTER (email IS NOT NULL) AS email
         FROM valid GROUP BY user_id),
won AS (SELECT max(request_id) AS request_id FROM valid GROUP BY user_id),
lst AS (SELECT * FROM valid WHERE request_id IN (SELECT request_id FROM won)),
fresh AS (SELECT lower(trim(kelas)) AS k FROM lst WHERE lower(trim(kelas)) NOT IN (SELECT lower(nama_kelas) FROM kelas) GROUP BY 1),
room AS (SELECT id, lower(nama_kelas) AS k FROM kelas
         UNION ALL SELECT (SELECT max(id) FROM kelas) + row_number() OVER (ORDER BY k), k FROM fresh),
placed AS (SELECT lst.*, room.id AS kelas_id FROM lst LEFT JOIN room ON room.k = lower(trim(lst.kelas)))
"""


def _student_saves(t):
    i = F.col("id")
    text = i.cast("string")
    return t.verifications.select(
        i.alias("request_id"), (F.col("user_id") + F.when(i % 7 == 0, 5_000_000).otherwise(0)).alias("user_id"),
        F.concat(F.lit("Siswa "), text).alias("name"),
        F.when(i % 3 == 0, F.concat(F.lit("Siswa"), (i % 900).cast("string"), F.lit("@siswa.example.org"))).alias("email"),
        F.lpad((i % 4000).cast("string"), 10, "0").alias("nisn"), F.col("status").alias("jurusan"),
        F.concat(F.lit(" kelas_"), (i % 60 + 25).cast("string")).alias("kelas"))


def _upsert_outcomes(ch):
    done = ch.emitted["accepted"].select("request_id", F.lit("accepted").alias("outcome"))
    return done.unionByName(ch.rejects.withColumnRenamed("reason", "outcome"))


_OUTCOMES = """
SELECT request_id, 'unknown_user' AS outcome FROM req WHERE user_id NOT IN (SELECT id FROM users)
UNION ALL SELECT request_id, reason FROM verdicts WHERE reason <> ''
UNION ALL SELECT request_id, CASE WHEN request_id IN (SELECT request_id FROM won) THEN 'accepted' ELSE 'superseded' END
FROM valid
"""


@register("w02_student_upsert_outcomes", _OUTCOMES, ctes=_W02_REQ)
def w02_outcomes(t):
    return _upsert_outcomes(W.student_upsert(t, _student_saves(t)))


@register("w02_student_profile_upsert", """
SELECT d.id, d.user_id, coalesce(p.jurusan, d.jurusan) AS jurusan, coalesce(p.nisn, d.nisn) AS nisn,
       CASE WHEN p.request_id IS NULL THEN d.kelas_id ELSE p.kelas_id END AS kelas_id
FROM siswa_details d LEFT JOIN placed p USING (user_id)
UNION ALL
SELECT (SELECT max(id) FROM siswa_details) + row_number() OVER (ORDER BY request_id), user_id, jurusan, nisn, kelas_id
FROM placed ANTI JOIN siswa_details USING (user_id)
""", ctes=_W02_REQ)
def w02(t):
    return W.student_upsert(t, _student_saves(t)).tables.siswa_details.select("id", "user_id", "jurusan", "nisn",
                                                                             "kelas_id")


@register("w02_student_upsert_users", """
SELECT u.id, coalesce(l.name, u.name) AS name, coalesce(l.email, u.email) AS email
FROM users u LEFT JOIN said l ON l.user_id = u.id
""", ctes=_W02_REQ)
def w02_users(t):
    return W.student_upsert(t, _student_saves(t)).tables.users.select("id", "name", "email")


_W05_REQ = f"""
req AS (SELECT id AS request_id, created_by + CASE WHEN id % 11 = 0 THEN 5000000 ELSE 0 END AS user_id,
               'Guru ' || CAST(id AS VARCHAR) AS name, 'GURU' || CAST(id % 150 AS VARCHAR) || '@example.org' AS email,
               lpad(CAST(id % 130 AS VARCHAR), 18, '0') AS nip, deskripsi AS mapel,
               CASE WHEN id % 2 = 0 THEN 'kelas_25, KELAS_' || CAST(25 + id % 40 AS VARCHAR) END AS kelas FROM tugas),
known AS (SELECT * FROM req WHERE user_id IN (SELECT id FROM users)),
{_replay_ctes("known", [("email", "SELECT id AS u, email AS key FROM users", True),
                        ("nip", "SELECT user_id AS u, nip AS key FROM guru_details", False)])},
valid AS (SELECT known.* FROM known JOIN verdicts USING (request_id) WHERE reason = ''),
said AS (SELECT user_id, arg_max(name, request_id) AS name, arg_max(email, request_id) FILTER (email IS NOT NULL) AS email
         FROM valid GROUP BY user_id),
won AS (SELECT max(request_id) AS request_id FROM valid GROUP BY user_id),
lst AS (SELECT * FROM valid WHERE request_id IN (SELECT request_id FROM won)),
detail AS (
  SELECT d.id, d.user_id, coalesce(l.mapel, d.mapel) AS mapel, coalesce(l.nip, d.nip) AS nip
  FROM guru_details d LEFT JOIN lst l USING (user_id)
  UNION ALL
  SELECT (SELECT max(id) FROM guru_details) + row_number() OVER (ORDER BY request_id), user_id, mapel, nip
  FROM lst ANTI JOIN guru_details USING (user_id))
"""


def _teacher_saves(t):
    i = F.col("id")
    return t.tugas.select(
        i.alias("request_id"), (F.col("created_by") + F.when(i % 11 == 0, 5_000_000).otherwise(0)).alias("user_id"),
        F.concat(F.lit("Guru "), i.cast("string")).alias("name"),
        F.concat(F.lit("GURU"), (i % 150).cast("string"), F.lit("@example.org")).alias("email"),
        F.lpad((i % 130).cast("string"), 18, "0").alias("nip"), F.col("deskripsi").alias("mapel"),
        F.when(i % 2 == 0, F.concat(F.lit("kelas_25, KELAS_"), (i % 40 + 25).cast("string"))).alias("kelas"))


@register("w05_teacher_upsert_outcomes", _OUTCOMES, ctes=_W05_REQ)
def w05_outcomes(t):
    return _upsert_outcomes(W.teacher_upsert(t, _teacher_saves(t)))


@register("w05_teacher_profile_upsert", "SELECT * FROM detail", ctes=_W05_REQ)
def w05(t):
    return W.teacher_upsert(t, _teacher_saves(t)).tables.guru_details.select("id", "user_id", "mapel", "nip")


@register("w05_teacher_upsert_users", """
SELECT u.id, coalesce(l.name, u.name) AS name, coalesce(l.email, u.email) AS email
FROM users u LEFT JOIN said l ON l.user_id = u.id
""", ctes=_W05_REQ)
def w05_users(t):
    return W.teacher_upsert(t, _teacher_saves(t)).tables.users.select("id", "name", "email")


@register("w05_teacher_upsert_classes", """
SELECT guru_id, kelas_id FROM guru_kelas WHERE guru_id NOT IN (SELECT id FROM listed)
UNION ALL SELECT DISTINCT listed.id, kelas.id FROM listed, kelas
WHERE list_contains(list_transform(string_split(lower(listed.kelas), ','), lambda x: trim(x)), lower(nama_kelas))
""", ctes=_W05_REQ + ", listed AS (SELECT detail.id, lst.kelas FROM lst JOIN detail USING (user_id) WHERE lst.kelas IS NOT NULL)")
def w05_classes(t):
    return W.teacher_upsert(t, _teacher_saves(t)).tables.guru_kelas.select("guru_id", "kelas_id")


# The table that W10 leaves behind; request ids here overlap the stored ids.
@register("w10_stored_submissions", f"""
SELECT id, tugas_id, siswa_id, nilai, dikumpulkan_at FROM existing
UNION ALL
SELECT (SELECT max(id) FROM existing) + row_number() OVER (ORDER BY request_id), tugas_id, siswa_id, NULL, submitted_at
FROM (SELECT tugas_id, siswa_id, min(submitted_at) AS submitted_at, arg_min(request_id, (submitted_at, request_id)) AS request_id
      FROM req ANTI JOIN existing USING (tugas_id, siswa_id) GROUP BY ALL)
""", ctes=f"""
existing AS (SELECT * FROM pengumpulan_tugas WHERE dikumpulkan_at < TIMESTAMP '{SUBMIT_CUTOFF}'),
req AS (SELECT id - (SELECT min(id) FROM existing) AS request_id, tugas_id, siswa_id, dikumpulkan_at AS submitted_at
        FROM pengumpulan_tugas WHERE dikumpulkan_at >= TIMESTAMP '{SUBMIT_CUTOFF}')
""")
def w10_stored(t):
    snap, reqs = _submit_split(t)
    low = snap.pengumpulan_tugas.agg(F.min("id")).scalar()
    ch = W.submit_first_wins(snap, reqs.withColumn("request_id", F.col("request_id") - low))
    return ch.tables.pengumpulan_tugas.select("id", "tugas_id", "siswa_id", "nilai", "dikumpulkan_at")


# W12 / W13 with owners: every submission asks, in the name of a teacher, to
# edit its assignment (or one of the courses) together with its classes.
_EDIT_REQ = """
req AS (SELECT id AS request_id, tugas_id AS id, 10000000 + siswa_id % 3 + (SELECT min(created_by) FROM tugas) % 100 AS owner_id,
               'Judul ' || CAST(id AS VARCHAR) AS judul,
               CASE WHEN id % 2 = 0 THEN 'KELAS_' || CAST(25 + siswa_id % 40 AS VARCHAR) || ',tidak ada' END AS kelas
        FROM pengumpulan_tugas),
ok AS (SELECT req.* FROM req SEMI JOIN (SELECT id, created_by AS owner_id FROM tugas) USING (id, owner_id)),
lst AS (SELECT * FROM ok WHERE request_id IN (SELECT max(request_id) FROM ok GROUP BY id))
"""


def _assignment_edits(t):
    low = t.tugas.agg(F.min("created_by")).scalar()
    return t.pengumpulan_tugas.select(
        F.col("id").alias("request_id"), F.col("tugas_id").alias("id"),
        (F.lit(10_000_000) + F.col("siswa_id") % 3 + low % 100).alias("owner_id"),
        F.concat(F.lit("Judul "), F.col("id").cast("string")).alias("judul"),
        F.when(F.col("id") % 2 == 0, F.concat(F.lit("KELAS_"), (F.col("siswa_id") % 40 + 25).cast("string"),
                                              F.lit(",tidak ada"))).alias("kelas"))


@register("w12_owner_checked_assignment_edit", """
SELECT tugas.id, coalesce(lst.judul, tugas.judul) AS judul, deskripsi, deadline, created_by
FROM tugas LEFT JOIN lst ON lst.id = tugas.id
""", ctes=_EDIT_REQ)
def w12_assignment(t):
    ch = W.update_owned(t, "tugas", _assignment_edits(t))
    return ch.tables.tugas.select("id", "judul", "deskripsi", "deadline", "created_by")


@register("w12_assignment_edit_classes", """
SELECT tugas_id, kelas_id FROM tugas_kelas WHERE tugas_id NOT IN (SELECT id FROM lst WHERE kelas IS NOT NULL)
UNION ALL SELECT lst.id, kelas.id FROM lst, kelas WHERE nama_kelas = string_split(lst.kelas, ',')[1]
""", ctes=_EDIT_REQ)
def w12_assignment_classes(t):
    return W.update_owned(t, "tugas", _assignment_edits(t)).tables.tugas_kelas.select("tugas_id", "kelas_id")


@register("w12_assignment_edit_outcomes", """
SELECT request_id, CASE WHEN request_id IN (SELECT request_id FROM lst) THEN 'accepted' ELSE 'superseded' END AS outcome
FROM ok
UNION ALL SELECT request_id, 'not_owner_or_missing' FROM req WHERE request_id NOT IN (SELECT request_id FROM ok)
""", ctes=_EDIT_REQ)
def w12_assignment_outcomes(t):
    return _upsert_outcomes(W.update_owned(t, "tugas", _assignment_edits(t)))


# Courses: every enrolment asks for a new description in a teacher's name; the
# class names come as an array.
_COURSE_REQ = """
req AS (SELECT course_id * 1000000 + student_id AS request_id, course_id AS id, 10000000 + student_id % 100 AS owner_id,
               'Isi ' || CAST(student_id AS VARCHAR) AS description,
               ['KELAS_' || CAST(25 + student_id % 30 AS VARCHAR), ' kelas_26 '] AS kelas FROM course_enrollments),
ok AS (SELECT req.* FROM req SEMI JOIN (SELECT id, created_by AS owner_id FROM courses) USING (id, owner_id)),
lst AS (SELECT * FROM ok WHERE request_id IN (SELECT max(request_id) FROM ok GROUP BY id)),
links AS (SELECT DISTINCT lst.id AS course_id, kelas.id AS kelas_id FROM lst, kelas
          WHERE list_contains(list_transform(lst.kelas, lambda x: lower(trim(x))), lower(nama_kelas)))
"""


def _course_edits(t):
    return t.course_enrollments.select(
        (F.col("course_id") * 1_000_000 + F.col("student_id")).alias("request_id"), F.col("course_id").alias("id"),
        (F.lit(10_000_000) + F.col("student_id") % 100).alias("owner_id"),
        F.concat(F.lit("Isi "), F.col("student_id").cast("string")).alias("description"),
        F.array(F.concat(F.lit("KELAS_"), (F.col("student_id") % 30 + 25).cast("string")), F.lit(" kelas_26 "))
        .alias("kelas"))


@register("w12_owner_checked_course_edit", """
SELECT courses.id, name, coalesce(lst.description, courses.description) AS description, created_by
FROM courses LEFT JOIN lst ON lst.id = courses.id
""", ctes=_COURSE_REQ)
def w12_course(t):
    return W.update_owned(t, "courses", _course_edits(t)).tables.courses.select("id", "name", "description", "created_by")


@register("w12_course_edit_classes", """
SELECT course_id, kelas_id FROM course_kelas WHERE course_id NOT IN (SELECT id FROM lst)
UNION ALL SELECT course_id, kelas_id FROM links
""", ctes=_COURSE_REQ)
def w12_course_classes(t):
    return W.update_owned(t, "courses", _course_edits(t)).tables.course_kelas.select("course_id", "kelas_id")


# W07 for courses: enrolments ask for courses; the list is empty, unknown or known.
_NEW_COURSES = """
req AS (SELECT course_id * 1000000 + student_id AS request_id, 'Kursus ' || CAST(student_id AS VARCHAR) AS name,
               10000000 + student_id % 120 AS created_by,
               CASE student_id % 3 WHEN 0 THEN [' '] WHEN 1 THEN ['tidak ada'] ELSE ['kelas_25', 'KELAS_26', ''] END AS kelas
        FROM course_enrollments),
bad AS (SELECT request_id, CASE WHEN created_by NOT IN (SELECT id FROM users) THEN 'unknown_author'
                                WHEN kelas = [' '] THEN 'no_class' END AS reason FROM req),
acc AS (SELECT req.*, (SELECT max(id) FROM courses) + row_number() OVER (ORDER BY request_id) AS new_id
        FROM req JOIN bad USING (request_id) WHERE reason IS NULL)
"""


def _course_requests(t):
    s = F.col("student_id")
    return t.course_enrollments.select(
        (F.col("course_id") * 1_000_000 + s).alias("request_id"), F.concat(F.lit("Kursus "), s.cast("string")).alias("name"),
        (F.lit(10_000_000) + s % 120).alias("created_by"),
        F.when(s % 3 == 0, F.array(F.lit(" "))).when(s % 3 == 1, F.array(F.lit("tidak ada")))
        .otherwise(F.array(F.lit("kelas_25"), F.lit("KELAS_26"), F.lit(""))).alias("kelas"))


@register("w07_create_courses", """
SELECT request_id, new_id, NULL AS reason FROM acc
UNION ALL SELECT request_id, NULL, reason FROM bad WHERE reason IS NOT NULL
""", ctes=_NEW_COURSES)
def w07_courses(t):
    ch = W.create_with_classes(t, "courses", _course_requests(t), APPLY_AT)
    ok = ch.emitted["accepted"].select("request_id", F.col("id").alias("new_id"), F.lit(None).cast("string").alias("reason"))
    return ok.unionByName(ch.rejects.select("request_id", F.lit(None).cast("bigint").alias("new_id"), "reason"))


@register("w07_create_course_classes", """
SELECT request_id, new_id AS course_id, kelas.id AS kelas_id FROM acc, kelas
WHERE len(acc.kelas) = 3 AND lower(nama_kelas) IN ('kelas_25', 'kelas_26')
""", ctes=_NEW_COURSES)
def w07_course_classes(t):
    return W.create_with_classes(t, "courses", _course_requests(t), APPLY_AT).emitted["links"]


# W13 with owners: the teachers named by the submissions delete assignments.
@register("w13_owned_assignment_delete", """
SELECT 'request' AS what, request_id AS id, CASE WHEN request_id IN (SELECT request_id FROM ok) THEN 'accepted'
       ELSE 'not_owner_or_missing' END AS detail FROM req
UNION ALL SELECT 'tugas', id, judul FROM tugas WHERE id NOT IN (SELECT id FROM ok)
UNION ALL SELECT 'tugas_kelas', tugas_id, CAST(kelas_id AS VARCHAR) FROM tugas_kelas WHERE tugas_id NOT IN (SELECT id FROM ok)
UNION ALL SELECT 'pengumpulan_tugas', id, file_path FROM pengumpulan_tugas WHERE tugas_id NOT IN (SELECT id FROM ok)
""", ctes=_EDIT_REQ)
def w13_owned(t):
    ch = W.delete_owned(t, "tugas", _assignment_edits(t).select("request_id", "id", "owner_id"))
    n = ch.tables
    out = _upsert_outcomes(ch).select(F.lit("request").alias("what"), F.col("request_id").alias("id"),
                                      F.col("outcome").alias("detail"))
    for name, key, text in (("tugas", "id", "judul"), ("tugas_kelas", "tugas_id", "kelas_id"),
                            ("pengumpulan_tugas", "id", "file_path")):
        out = out.unionByName(n[name].select(F.lit(name).alias("what"), F.col(key).cast("bigint").alias("id"),
                                             F.col(text).cast("string").alias("detail")))
    return out


# W13 contents: the rows that hang on the deleted teachers, table by table.
@register("w13_delete_cascade_rows", """
SELECT 'courses' AS what, c.id, CASE WHEN del.id IS NULL THEN CAST(c.created_by AS VARCHAR) END AS detail
FROM courses c LEFT JOIN del ON del.id = c.created_by
UNION ALL SELECT 'tugas', id, judul FROM tugas WHERE created_by NOT IN (SELECT id FROM del)
UNION ALL SELECT 'diskusi', id, judul FROM diskusi WHERE created_by NOT IN (SELECT id FROM del)
UNION ALL SELECT 'guru_details', id, nip FROM guru_details WHERE user_id NOT IN (SELECT id FROM del)
UNION ALL SELECT 'chat_diskusi', c.id, CAST(c.user_id AS VARCHAR) FROM chat_diskusi c
WHERE c.user_id NOT IN (SELECT id FROM del)
  AND c.diskusi_id NOT IN (SELECT id FROM diskusi WHERE created_by IN (SELECT id FROM del))
""", ctes="""
del AS (SELECT u.id FROM users u WHERE u.role = 'guru' AND NOT EXISTS (
          SELECT 1 FROM guru_details g JOIN guru_kelas gk ON gk.guru_id = g.id WHERE g.user_id = u.id))
""")
def w13_rows(t):
    n = W.delete_cascade(t, {"users": _idle_teachers(t)}).tables
    parts = [n[name].select(F.lit(name).alias("what"), F.col("id").cast("bigint").alias("id"),
                            F.col(text).cast("string").alias("detail"))
             for name, text in (("courses", "created_by"), ("tugas", "judul"), ("diskusi", "judul"),
                                ("guru_details", "nip"), ("chat_diskusi", "user_id"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
