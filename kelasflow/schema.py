"""Learning-schema table definitions (column name -> Spark type).

Timestamps are ``TIMESTAMP_NTZ`` (wall-clock values, no zone), dates are
``DATE``; ids are ``BIGINT`` except class ids, which are ``INT``.
"""

from __future__ import annotations

from pyspark.sql import types as T

L, I, S = T.LongType(), T.IntegerType(), T.StringType()
TS, D = T.TimestampNTZType(), T.DateType()


def _st(*cols) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in cols])


SCHEMAS: dict[str, T.StructType] = {
    "users": _st(("id", L), ("name", S), ("email", S), ("role", S), ("foto", S), ("created_at", TS)),
    "kelas": _st(("id", I), ("nama_kelas", S)),
    "siswa_details": _st(("id", L), ("user_id", L), ("jurusan", S), ("nisn", S), ("kelas_id", I)),
    "guru_details": _st(("id", L), ("user_id", L), ("mapel", S), ("nip", S)),
    "guru_kelas": _st(("id", L), ("guru_id", L), ("kelas_id", I)),
    "courses": _st(("id", L), ("name", S), ("description", S), ("created_by", L),
                   ("created_at", TS), ("file_path", S)),
    "course_kelas": _st(("id", L), ("course_id", L), ("kelas_id", I)),
    "course_enrollments": _st(("course_id", L), ("student_id", L)),
    "tugas": _st(("id", L), ("judul", S), ("deskripsi", S), ("deadline", D), ("file_path", S),
                 ("created_by", L), ("created_at", TS)),
    "tugas_kelas": _st(("tugas_id", L), ("kelas_id", I)),
    "pengumpulan_tugas": _st(("id", L), ("tugas_id", L), ("siswa_id", L), ("file_path", S),
                             ("nilai", I), ("dikumpulkan_at", TS)),
    "verifications": _st(("id", L), ("user_id", L), ("status", S), ("requested_at", TS)),
    "activity_logs": _st(("id", L), ("user_id", L), ("action", S), ("created_at", TS)),
    "diskusi": _st(("id", L), ("judul", S), ("isi", S), ("created_by", L), ("created_at", TS)),
    "diskusi_kelas": _st(("id", L), ("diskusi_id", L), ("kelas_id", I)),
    "chat_diskusi": _st(("id", L), ("diskusi_id", L), ("user_id", L), ("isi", S), ("created_at", TS)),
}

# Fixed values of the reference's domains (ENUM columns of its DDL).
ROLES = ("admin", "guru", "siswa")
VERIFICATION_STATUSES = ("pending", "approved", "rejected")
