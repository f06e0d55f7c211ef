"""Registered derived-column views."""

from kelasflow.operators import derived_views as V
from kelasflow.plans import params as X
from kelasflow.plans.reg_progress import _PROGRESS_SQL, STUDENT_CARDS_SQL
from kelasflow.plans.reg_roster import _STUDENTS, STUDENT_SEARCH_SQL
from kelasflow.plans.registry import register


def _initials(col):
    return f"upper(array_to_string(list_transform(string_split({col}, ' '), lambda x: substring(x, 1, 1)), ''))"


@register("u01_u09_u16_student_cards", f"""
SELECT id, name, {_initials('name')} AS initials, coalesce(nullif(nisn, ''), '-') AS nisn,
       coalesce(nullif(jurusan, ''), '-') AS jurusan, coalesce(nullif(kelas, ''), '-') AS kelas,
       coalesce(nullif(kelas, ''), email) AS label
FROM ({_STUDENTS.format(cond='')})
""")
def u01(t):
    return V.student_cards(t)


@register("u01_u02_teacher_cards", f"""
SELECT id, name, {_initials('name')} AS initials, string_split(coalesce(mapel, ''), ',') AS subjects
FROM (SELECT user_id AS id, mapel FROM guru_details) RIGHT JOIN (SELECT id, name FROM users WHERE role = 'guru') USING (id)
""")
def u02(t):
    return V.teacher_cards(t)


@register("u10_student_search_count", f"SELECT count(*) AS total FROM ({STUDENT_SEARCH_SQL})")
def u10(t):
    return V.search_count(t, X.STUDENT_KEYWORD)


@register("u03_u04_u15_progress_cards", f"""
SELECT id, created_by, jumlah_kumpul, jumlah_siswa,
       CASE WHEN jumlah_siswa = 0 THEN 0 ELSE CAST(round(jumlah_kumpul / jumlah_siswa * 100) AS INTEGER) END AS persen,
       CAST(ceil((epoch(CAST(deadline AS TIMESTAMP)) - epoch(TIMESTAMP '{X.NOW_TASK.isoformat(sep=' ')}')) / 86400)
            AS INTEGER) AS sisa_hari,
       strftime(deadline, '%-d/%-m/%Y') AS deadline_text, strftime(created_at, '%-d/%-m/%Y') AS dibuat_text
FROM p
""", ctes=f"p AS ({_PROGRESS_SQL.format(cond='')})")
def u03(t):
    return V.progress_cards(t, X.NOW_TASK)


@register("u05_student_assignment_status", """
SELECT siswa_id, id, nilai, file_kumpul,
       CASE WHEN nilai IS NOT NULL THEN 'Graded' WHEN coalesce(file_kumpul, '') <> '' THEN 'Submitted'
            ELSE 'Pending' END AS status,
       CASE WHEN nilai IS NOT NULL THEN CAST(nilai AS VARCHAR) || '/100' ELSE '-' END AS nilai_text
FROM a
""", ctes=f"a AS ({STUDENT_CARDS_SQL})")
def u05(t):
    return V.student_assignment_status(t)


@register("u12_grade_bands", """
SELECT t.created_by AS guru_id,
       CASE WHEN p.nilai >= 90 THEN 'Sangat Baik (90-100)' WHEN p.nilai >= 80 THEN 'Baik (80-89)'
            WHEN p.nilai >= 70 THEN 'Cukup (70-79)' ELSE 'Kurang (<70)' END AS band,
       count(*) AS total
FROM pengumpulan_tugas p JOIN tugas t ON t.id = p.tugas_id WHERE p.nilai IS NOT NULL
GROUP BY guru_id, band
""")
def u12(t):
    return V.grade_bands(t)


@register("u13_subject_month_average", """
SELECT p.siswa_id, g.mapel, CAST(month(p.dikumpulkan_at) AS INTEGER) AS bulan, avg(p.nilai) AS rata_rata
FROM pengumpulan_tugas p JOIN tugas t ON t.id = p.tugas_id JOIN guru_details g ON g.user_id = t.created_by
WHERE p.nilai IS NOT NULL
GROUP BY p.siswa_id, g.mapel, bulan
""")
def u13(t):
    return V.subject_month_average(t)


@register("u14_submission_links", f"""
SELECT id, CASE WHEN starts_with(file_path, 'http') THEN file_path ELSE '{X.FILE_BASE_URL}' || file_path END
       AS file_url
FROM pengumpulan_tugas
""")
def u14(t):
    return V.submission_links(t, X.FILE_BASE_URL)
