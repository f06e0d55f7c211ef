"""Registered forum queries (Q37-Q40)."""

from pyspark.sql import functions as F

from kelasflow.operators import forum as D
from kelasflow.plans.reg_courses import FIRST_CLASS
from kelasflow.plans.registry import register


_POSTED = """
posted AS (SELECT id, kelas_id, nama_kelas FROM (SELECT diskusi_id AS id, kelas_id FROM diskusi_kelas)
           INNER JOIN (SELECT id AS kelas_id, nama_kelas FROM kelas) USING (kelas_id)),
thread AS (SELECT diskusi.*, guru FROM diskusi INNER JOIN (SELECT id AS created_by, name AS guru FROM users)
           USING (created_by))
"""


@register("q37_student_threads", """
SELECT siswa_id, id, judul, isi, created_by, created_at, guru, nama_kelas
FROM thread INNER JOIN posted USING (id)
INNER JOIN (SELECT user_id AS siswa_id, kelas_id FROM siswa_details GROUP BY ALL) USING (kelas_id)
""", ctes=_POSTED)
def q37(t):
    return D.student_threads(t)


@register("q38_teacher_threads", """
SELECT thread.*, kelas FROM thread
INNER JOIN (SELECT id, array_to_string(list_sort(list(nama_kelas)), ', ') AS kelas FROM posted GROUP BY id) USING (id)
""", ctes=_POSTED)
def q38(t):
    return D.teacher_threads(t)


@register("q39_thread_detail", f"""
SELECT id, judul, isi, kelas FROM diskusi
INNER JOIN (SELECT id, array_to_string(list_sort(list(nama_kelas)), ',') AS kelas FROM posted GROUP BY id) USING (id)
SEMI JOIN (SELECT diskusi_id AS id FROM diskusi_kelas WHERE kelas_id = {FIRST_CLASS}) USING (id)
""", ctes=_POSTED)
def q39(t):
    return D.thread_detail(t, t.diskusi_kelas.where(F.col("kelas_id") == FIRST_CLASS).select("diskusi_id"))


@register("q40_thread_messages", """
SELECT chat_diskusi.*, name, role FROM chat_diskusi
INNER JOIN (SELECT id AS user_id, name, role FROM users) USING (user_id)
""")
def q40(t):
    return D.thread_messages(t)
