"""Registered roster / search / profile queries (Q07-Q14, Q22, Q33, Q42)."""

from pyspark.sql import functions as F

from kelasflow.operators import roster as R
from kelasflow.plans import params as X
from kelasflow.plans.registry import register

# People of a role beside what their detail rows say, brought together first.
_STUDENTS = """
SELECT id, name, email, nisn, jurusan, kelas
FROM (SELECT id, name, email FROM users WHERE role = 'siswa')
LEFT JOIN (SELECT user_id AS id, nisn, jurusan, nama_kelas AS kelas FROM siswa_details
           LEFT JOIN (SELECT id AS kelas_id, nama_kelas FROM kelas) USING (kelas_id)) USING (id)
WHERE TRUE {cond}
"""
# One row per teacher and class first; the list is made of the rows that pass.
_TEACHERS = """
WITH taught AS (SELECT guru_id, nama_kelas FROM guru_kelas
                INNER JOIN (SELECT id AS kelas_id, nama_kelas FROM kelas) USING (kelas_id)),
detail AS (SELECT user_id AS id, nip, mapel, nama_kelas FROM (SELECT id AS guru_id, user_id, nip, mapel FROM guru_details)
           LEFT JOIN taught USING (guru_id))
SELECT id, name, email, nip, mapel,
       nullif(array_to_string(list_sort(list(nama_kelas) FILTER (nama_kelas IS NOT NULL)), ', '), '') AS kelas
FROM (SELECT id, name, email FROM users WHERE role = 'guru') LEFT JOIN detail USING (id)
WHERE TRUE {cond}
GROUP BY ALL
"""
# Key sets the keyed variants are run with, derived from the data:
# students with a pending verification; teachers who opened a thread.
_PENDING_IDS = "(SELECT user_id FROM verifications WHERE status = 'pending')"
_SUBJECT_IDS = f"(SELECT user_id FROM guru_details WHERE mapel = '{X.SUBJECT}')"



def _pending_ids(t):
    return t.verifications.where(F.col("status") == "pending").select("user_id")


def _subject_ids(t):
    return t.guru_details.where(F.col("mapel") == X.SUBJECT).select("user_id")


def _any_of(cols, kw):
    """Some column contains the keyword: a search in all of them, one per line."""
    pattern = kw.replace("_", ".").replace("%", ".*")
    return f"AND regexp_matches(concat_ws(chr(10), {', '.join(cols)}), '{pattern}', 'i')"


@register("q07_student_roster", _STUDENTS.format(cond=""))
def q07(t):
    return R.student_roster(t)


@register("q08_student_roster_by_ids", _STUDENTS.format(cond=f"AND id IN {_PENDING_IDS}"))
def q08(t):
    return R.student_roster(t, _pending_ids(t))


STUDENT_SEARCH_SQL = _STUDENTS.format(
    cond=_any_of(["name", "email", "nisn", "jurusan", "kelas"], X.STUDENT_KEYWORD))


@register("q09_student_search", STUDENT_SEARCH_SQL)
def q09(t):
    return R.student_search(t, X.STUDENT_KEYWORD)


@register("q10_student_filter_jurusan", _STUDENTS.format(cond=_any_of(["jurusan"], X.FILTER_JURUSAN)))
def q10(t):
    return R.student_filter(t, jurusan=X.FILTER_JURUSAN)


@register("q10_student_filter_jurusan_kelas", _STUDENTS.format(
    cond=_any_of(["jurusan"], X.FILTER_JURUSAN) + " " + _any_of(["kelas"], X.FILTER_KELAS)))
def q10b(t):
    return R.student_filter(t, jurusan=X.FILTER_JURUSAN, kelas=X.FILTER_KELAS)


@register("q11_teacher_roster", _TEACHERS.format(cond=""))
def q11(t):
    return R.teacher_roster(t)


@register("q12_teacher_roster_by_ids", _TEACHERS.format(cond=f"AND id IN {_SUBJECT_IDS}"))
def q12(t):
    return R.teacher_roster(t, _subject_ids(t))


_TEACHER_TEXTS = ["name", "email", "nip", "mapel", "nama_kelas"]


@register("q13_teacher_search", _TEACHERS.format(cond=_any_of(_TEACHER_TEXTS, X.TEACHER_KEYWORD)))
def q13(t):
    return R.teacher_search(t, X.TEACHER_KEYWORD)


@register("q13_teacher_search_by_class", _TEACHERS.format(cond=_any_of(_TEACHER_TEXTS, X.FILTER_TEACHER_KELAS)))
def q13b(t):
    return R.teacher_search(t, X.FILTER_TEACHER_KELAS)


@register("q14_teacher_filter", _TEACHERS.format(
    cond=_any_of(["mapel"], X.FILTER_MAPEL) + " " + _any_of(["nama_kelas"], X.FILTER_TEACHER_KELAS)))
def q14(t):
    return R.teacher_filter(t, mapel=X.FILTER_MAPEL, kelas=X.FILTER_TEACHER_KELAS)


@register("q22_teacher_profiles", """
SELECT id, name, email, foto, nip, mapel FROM (SELECT user_id AS id, nip, mapel FROM guru_details)
RIGHT JOIN (SELECT id, name, email, foto FROM users WHERE role = 'guru') USING (id)
""")
def q22(t):
    return R.teacher_profiles(t)


@register("q33_student_profiles", f"""
SELECT s.*, foto FROM ({_STUDENTS.format(cond='')}) s INNER JOIN (SELECT id, foto FROM users) USING (id)
""")
def q33(t):
    return R.student_profiles(t)


@register("q42_users_by_email", f"""
SELECT id, name, email, role FROM users
SEMI JOIN (SELECT lower(email) AS mail FROM users WHERE id IN {_PENDING_IDS}) ON mail = lower(email)
""")
def q42(t):
    emails = t.users.join(_pending_ids(t).withColumnRenamed("user_id", "id"), "id", "left_semi") \
        .select(F.upper("email").alias("email"))
    return R.users_by_email(t, emails)
