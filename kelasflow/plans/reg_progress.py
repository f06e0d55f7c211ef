"""Registered assignment queries (Q25-Q31, Q35, Q36)."""

from kelasflow.operators import progress as P
from kelasflow.plans import params as X
from kelasflow.plans.registry import register

# Three counts per assignment, each made on its own, then put side by side.
_PROGRESS_SQL = """
WITH lists AS (
  SELECT tugas_id AS id, array_to_string(list_sort(list(DISTINCT nama_kelas)), ', ') AS kelas
  FROM tugas_kelas INNER JOIN (SELECT id AS kelas_id, nama_kelas FROM kelas) USING (kelas_id) GROUP BY tugas_id),
received AS (
  SELECT tugas_id AS id, count(*) AS n, count(*) - count(nilai) AS n_open FROM pengumpulan_tugas GROUP BY tugas_id),
reached AS (
  SELECT id, count(*) AS n
  FROM (SELECT tugas_id AS id, user_id FROM tugas_kelas INNER JOIN siswa_details USING (kelas_id)
        WHERE kelas_id IN (SELECT id FROM kelas) GROUP BY ALL)
  GROUP BY id)
SELECT id, judul, deskripsi, deadline, created_at, file_path, created_by, lists.kelas,
       coalesce(received.n, 0) AS jumlah_kumpul, coalesce(reached.n, 0) AS jumlah_siswa
FROM tugas INNER JOIN lists USING (id) LEFT JOIN received USING (id) LEFT JOIN reached USING (id)
WHERE TRUE {cond}
"""


@register("q25_assignment_progress", _PROGRESS_SQL.format(cond=""))
def q25(t):
    return P.assignment_progress(t)


@register("q26_assignment_progress_due_soon", _PROGRESS_SQL.format(
    cond=f"AND date_diff('day', DATE '{X.AS_OF_TASK}', deadline) BETWEEN 0 AND {X.DAYS_SOON}"))
def q26(t):
    return P.assignment_progress(t, "deadline", X.AS_OF_TASK, X.DAYS_SOON)


@register("q27_assignment_progress_ungraded", _PROGRESS_SQL.format(cond="AND received.n_open > 0"))
def q27(t):
    return P.assignment_progress(t, "ungraded", X.AS_OF_TASK)


@register("q28_assignment_progress_completed", _PROGRESS_SQL.format(
    cond=f"AND date_diff('day', DATE '{X.AS_OF_TASK}', deadline) < 0"))
def q28(t):
    return P.assignment_progress(t, "completed", X.AS_OF_TASK)


@register("q29_assignment_progress_unknown_type", _PROGRESS_SQL.format(cond=""))
def q29(t):
    return P.assignment_progress(t, "no-such-type", X.AS_OF_TASK)


@register("u07_assignment_progress_due_7_days", _PROGRESS_SQL.format(
    cond=f"AND date_diff('day', DATE '{X.AS_OF_TASK}', deadline) BETWEEN 0 AND {X.DAYS_CARD}"))
def u07(t):
    return P.assignment_progress(t, "deadline", X.AS_OF_TASK, X.DAYS_CARD)


@register("q30_assignment_classes", """
WITH lists AS (
  SELECT tugas_id AS id, list_sort(list(nama_kelas)) AS kelas
  FROM tugas_kelas INNER JOIN (SELECT id AS kelas_id, nama_kelas FROM kelas) USING (kelas_id) GROUP BY tugas_id)
SELECT id, judul, deskripsi, deadline, file_path, created_by, created_at, kelas FROM tugas INNER JOIN lists USING (id)
UNION ALL
SELECT id, judul, deskripsi, deadline, file_path, created_by, created_at, CAST([] AS VARCHAR[])
FROM tugas ANTI JOIN lists USING (id)
""")
def q30(t):
    return P.assignment_classes(t)


@register("q31_submission_status", """
WITH placed AS (
  SELECT user_id, kelas_id, name, nama_kelas AS kelas FROM siswa_details
  INNER JOIN (SELECT id AS user_id, name FROM users) USING (user_id)
  INNER JOIN (SELECT id AS kelas_id, nama_kelas FROM kelas) USING (kelas_id)),
handed AS (SELECT tugas_id, siswa_id AS user_id, file_path, nilai FROM pengumpulan_tugas
           WHERE tugas_id IN (SELECT id FROM tugas)),
expected AS (
  SELECT tugas_id, user_id, name, kelas FROM tugas_kelas INNER JOIN placed USING (kelas_id)
  WHERE tugas_id IN (SELECT id FROM tugas))
SELECT tugas_id, 'sudah_kumpul' AS status, user_id AS id, name, kelas, file_path, nilai
FROM handed INNER JOIN placed USING (user_id)
UNION ALL
SELECT tugas_id, 'belum_kumpul', user_id, name, kelas, NULL, NULL
FROM expected ANTI JOIN handed USING (tugas_id, user_id)
WHERE tugas_id NOT IN (SELECT tugas_id FROM handed WHERE user_id IS NULL)
""")
def q31(t):
    return P.submission_status(t)


# Cards with the student's own submission, then those without one.
STUDENT_CARDS_SQL = """
WITH member AS (SELECT user_id AS siswa_id, kelas_id FROM siswa_details WHERE kelas_id IS NOT NULL GROUP BY ALL),
offer AS (
  SELECT kelas_id, nama_kelas, tugas.*, guru FROM tugas
  INNER JOIN (SELECT tugas_id AS id, kelas_id FROM tugas_kelas) USING (id)
  INNER JOIN (SELECT id AS kelas_id, nama_kelas FROM kelas) USING (kelas_id)
  INNER JOIN (SELECT id AS created_by, name AS guru FROM users) USING (created_by)),
card AS (SELECT * FROM member INNER JOIN offer USING (kelas_id)),
own AS (SELECT tugas_id AS id, siswa_id, nilai, file_path AS file_kumpul FROM pengumpulan_tugas)
SELECT siswa_id, id, judul, deskripsi, deadline, created_at, file_path, guru, nama_kelas, nilai, file_kumpul
FROM card INNER JOIN own USING (id, siswa_id)
UNION ALL
SELECT siswa_id, id, judul, deskripsi, deadline, created_at, file_path, guru, nama_kelas, NULL, NULL
FROM card ANTI JOIN own USING (id, siswa_id)
"""


@register("q35_student_assignments", STUDENT_CARDS_SQL)
def q35(t):
    return P.student_assignments(t)


@register("q36_student_assignment_stats", """
WITH given AS (SELECT kelas_id, count(*) AS n FROM tugas_kelas WHERE tugas_id IN (SELECT id FROM tugas) GROUP BY kelas_id),
due AS (SELECT user_id AS siswa_id, sum(n) AS n FROM siswa_details INNER JOIN given USING (kelas_id) GROUP BY user_id),
handed AS (SELECT siswa_id, count(*) AS n, count(nilai) AS graded FROM pengumpulan_tugas GROUP BY siswa_id)
SELECT siswa_id, CAST(coalesce(due.n, 0) AS BIGINT) AS total, coalesce(graded, 0) AS completed,
       CAST(coalesce(due.n, 0) - coalesce(handed.n, 0) AS BIGINT) AS pending
FROM (SELECT id AS siswa_id FROM users WHERE role = 'siswa') LEFT JOIN due USING (siswa_id)
LEFT JOIN handed USING (siswa_id)
""")
def q36(t):
    return P.student_assignment_stats(t)
