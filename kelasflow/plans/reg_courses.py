"""Registered course / class queries."""

from pyspark.sql import functions as F

from kelasflow.operators import courses as C
from kelasflow.plans import params as X
from kelasflow.plans.registry import register


@register("q15_class_list", "SELECT id, nama_kelas FROM kelas")
def q15(t):
    return C.class_list(t)


# Courses with the teacher who wrote them; courses of others have none here.
_WRITTEN = """
written AS (SELECT courses.*, teacher FROM courses
            INNER JOIN (SELECT id AS created_by, name AS teacher FROM users WHERE role = 'guru') USING (created_by))
"""
FIRST_CLASS = 25        # one class: its courses, threads and the like are the key sets of keyed variants


@register("q16_course_catalog",
          "SELECT * EXCLUDE (teacher), teacher AS created_by_name FROM written", ctes=_WRITTEN)
def q16(t):
    return C.course_catalog(t)


@register("q17_teacher_course_total", "SELECT count(*) AS total FROM written", ctes=_WRITTEN)
def q17(t):
    return C.teacher_course_total(t)


@register("q18_course_catalog_by_ids", f"""
SELECT * EXCLUDE (teacher), teacher AS creator_name FROM written
SEMI JOIN (SELECT course_id AS id FROM course_kelas WHERE kelas_id = {FIRST_CLASS}) USING (id)
""", ctes=_WRITTEN)
def q18(t):
    return C.course_catalog(t, t.course_kelas.where(F.col("kelas_id") == FIRST_CLASS).select("course_id"),
                            author_col="creator_name")


@register("q19_enrollment_counts", """
SELECT c.id AS course_id, count(ce.student_id) AS total
FROM courses c LEFT JOIN course_enrollments ce ON ce.course_id = c.id GROUP BY c.id
""")
def q19(t):
    return C.enrollment_counts(t)


@register("q20_enrolled_students", """
WITH place AS (SELECT user_id AS id, jurusan, nisn, nama_kelas AS kelas FROM siswa_details
               LEFT JOIN (SELECT id AS kelas_id, nama_kelas FROM kelas) USING (kelas_id)),
person AS (SELECT id, name, email, kelas, jurusan, nisn FROM users LEFT JOIN place USING (id))
SELECT course_id, person.* FROM person INNER JOIN (SELECT course_id, student_id AS id FROM course_enrollments) USING (id)
""")
def q20(t):
    return C.enrolled_students(t)


@register("q21_courses_by_teacher", """
SELECT c.created_by AS guru_id, c.id, c.name, c.description,
       (SELECT string_agg(k.nama_kelas, ', ' ORDER BY k.nama_kelas)
          FROM course_kelas ck JOIN kelas k ON k.id = ck.kelas_id WHERE ck.course_id = c.id) AS kelas
FROM courses c WHERE c.created_by IN (SELECT id FROM users WHERE role = 'guru')
""")
def q21(t):
    return C.courses_by_teacher(t)


@register("q23_teacher_dashboard", """
SELECT u.id AS guru_id,
       (SELECT count(*) FROM courses c WHERE c.created_by = u.id) AS total_mapel,
       CAST(coalesce((SELECT sum(n) FROM (SELECT DISTINCT ck.kelas_id FROM courses c
                       JOIN course_kelas ck ON ck.course_id = c.id WHERE c.created_by = u.id) dk
                     JOIN (SELECT kelas_id, count(*) AS n FROM siswa_details GROUP BY kelas_id) s
                       ON s.kelas_id = dk.kelas_id), 0) AS BIGINT) AS total_siswa
FROM users u WHERE u.role = 'guru'
""")
def q23(t):
    return C.teacher_dashboard(t)


_COURSE_CLASSES = """
WITH headcount AS (SELECT kelas_id, count(*) AS n FROM siswa_details GROUP BY kelas_id),
room AS (SELECT id AS kelas_id, nama_kelas AS jurusan, coalesce(n, 0) AS jumlah_siswa
         FROM kelas LEFT JOIN headcount ON kelas_id = id)
SELECT created_by AS guru_id, course_id, name AS course_name, jurusan, jumlah_siswa
FROM (SELECT course_id, kelas_id FROM course_kelas) INNER JOIN room USING (kelas_id)
INNER JOIN written ON written.id = course_id
WHERE TRUE {cond}
"""


@register("q24_teacher_course_classes", _COURSE_CLASSES.format(cond=""), ctes=_WRITTEN)
def q24(t):
    return C.teacher_course_classes(t)


@register("u06_course_class_search", _COURSE_CLASSES.format(
    cond=f"AND (contains(lower(name), '{X.COURSE_KEYWORD}') OR contains(lower(jurusan), '{X.COURSE_KEYWORD}'))"),
          ctes=_WRITTEN)
def u06(t):
    return C.course_class_search(t, X.COURSE_KEYWORD)


@register("q32_class_students", """
SELECT k.nama_kelas AS kelas, u.name, sd.nisn, sd.jurusan
FROM siswa_details sd JOIN users u ON sd.user_id = u.id JOIN kelas k ON k.id = sd.kelas_id
""")
def q32(t):
    return C.class_students(t)


@register("q34_student_materials", """
WITH upload AS (
  SELECT id, courses.name, description, file_path, strftime(created_at, '%d-%m-%Y') AS tanggal_upload, guru
  FROM courses INNER JOIN (SELECT id AS created_by, name AS guru FROM users) USING (created_by)),
shelf AS (SELECT kelas_id, upload.* FROM upload INNER JOIN (SELECT course_id AS id, kelas_id FROM course_kelas) USING (id))
SELECT siswa_id, id, name, description, file_path, tanggal_upload, guru
FROM shelf INNER JOIN (SELECT user_id AS siswa_id, kelas_id FROM siswa_details GROUP BY ALL) USING (kelas_id)
""")
def q34(t):
    return C.student_materials(t)
