"""People: student and teacher rosters, keyword search, filters, profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelasflow.functions.aggregates import sorted_list
from kelasflow.functions.predicates import ilike_any, keyed, optional_contains
from kelasflow.sources.catalog import Tables

STUDENT_SEARCH_COLS = ["name", "email", "nisn", "jurusan", "kelas"]
TEACHER_SEARCH_COLS = ["name", "email", "nip", "mapel"]


def _students(t: Tables, ids: DataFrame | None = None) -> DataFrame:
    """Students with their detail rows and class name (left joins: students
    without details or class keep NULLs)."""
    u = keyed(t.users.where(F.col("role") == "siswa"), "id", ids)
    sd = t.siswa_details.select(F.col("user_id").alias("id"), "nisn", "jurusan", "kelas_id")
    k = t.kelas.select(F.col("id").alias("kelas_id"), F.col("nama_kelas").alias("kelas"))
    return u.join(sd, "id", "left").join(k, "kelas_id", "left")


def student_roster(t: Tables, ids: DataFrame | None = None) -> DataFrame:
    """id, name, email, nisn, jurusan, kelas for every student (or the given ids)."""
    return _students(t, ids).select("id", "name", "email", "nisn", "jurusan", "kelas")


def student_search(t: Tables, keyword: str) -> DataFrame:
    """Roster rows where any of name/email/nisn/jurusan/kelas contains the
    keyword (case-insensitive, ``%``/``_`` act as wildcards)."""
    return student_roster(t).where(ilike_any(STUDENT_SEARCH_COLS, keyword))


def student_filter(t: Tables, jurusan: str | None = None, kelas: str | None = None) -> DataFrame:
    """Roster rows matching every non-empty filter (substring, case-insensitive)."""
    return student_roster(t).where(optional_contains({"jurusan": jurusan, "kelas": kelas}))


def student_profiles(t: Tables, ids: DataFrame | None = None) -> DataFrame:
    return _students(t, ids).select("id", "name", "email", "foto", "nisn", "jurusan", "kelas")


def _teacher_rows(t: Tables, ids: DataFrame | None = None) -> DataFrame:
    """Teacher x detail row x class rows (left joins all the way)."""
    u = keyed(t.users.where(F.col("role") == "guru"), "id", ids).select("id", "name", "email")
    gd = t.guru_details.select(F.col("user_id").alias("id"), F.col("id").alias("gd_id"), "nip", "mapel")
    gk = t.guru_kelas.select(F.col("guru_id").alias("gd_id"), "kelas_id")
    k = t.kelas.select(F.col("id").alias("kelas_id"), "nama_kelas")
    return u.join(gd, "id", "left").join(gk, "gd_id", "left").join(k, "kelas_id", "left")


def _teacher_group(rows: DataFrame) -> DataFrame:
    return (rows.groupBy("id", "name", "email", "nip", "mapel")
            .agg(sorted_list("nama_kelas", ", ").alias("kelas")))


def teacher_roster(t: Tables, ids: DataFrame | None = None) -> DataFrame:
    """id, name, email, nip, mapel and the sorted class list per teacher
    (one row per teacher and distinct nip/mapel).

    Class names are first gathered per teacher-detail row (keyed by its
    id, map-side combined), so the final grouping on the dependent columns
    sees one row per detail row instead of one per class."""
    u = keyed(t.users.where(F.col("role") == "guru"), "id", ids).select("id", "name", "email")
    gd = t.guru_details.select(F.col("user_id").alias("id"), F.col("id").alias("gd_id"), "nip", "mapel")
    k = t.kelas.select(F.col("id").alias("kelas_id"), "nama_kelas")
    per_gd = (t.guru_kelas.select(F.col("guru_id").alias("gd_id"), "kelas_id").join(k, "kelas_id")
              .groupBy("gd_id").agg(F.collect_list("nama_kelas").alias("_names")))
    names = F.array_sort(F.flatten(F.collect_list("_names")))
    return (u.join(gd, "id", "left").join(per_gd, "gd_id", "left")
            .groupBy("id", "name", "email", "nip", "mapel")
            .agg(F.when(F.size(names) > 0, F.array_join(names, ", ")).alias("kelas")))


def teacher_search(t: Tables, keyword: str) -> DataFrame:
    """Keyword filter applied to teacher x class rows *before* grouping: a
    teacher matched only through a class name lists just the matching
    classes."""
    cond = ilike_any(TEACHER_SEARCH_COLS + ["nama_kelas"], keyword)
    return _teacher_group(_teacher_rows(t).where(cond))


def teacher_filter(t: Tables, mapel: str | None = None, kelas: str | None = None) -> DataFrame:
    """Optional subject / class filters before grouping (same narrowing)."""
    return _teacher_group(_teacher_rows(t).where(optional_contains({"mapel": mapel, "nama_kelas": kelas})))


def teacher_profiles(t: Tables, ids: DataFrame | None = None) -> DataFrame:
    u = keyed(t.users.where(F.col("role") == "guru"), "id", ids)
    gd = t.guru_details.select(F.col("user_id").alias("id"), "nip", "mapel")
    return u.join(gd, "id", "left").select("id", "name", "email", "foto", "nip", "mapel")


def users_by_email(t: Tables, emails: DataFrame, email_col: str | None = None) -> DataFrame:
    """Users whose e-mail equals one of the given addresses, ignoring case
    (the store compares e-mails case-insensitively)."""
    e = emails.select(F.lower(F.col(email_col or emails.columns[0])).alias("_e")).distinct()
    return (t.users.join(e, F.lower(F.col("email")) == F.col("_e"), "left_semi")
            .select("id", "name", "email", "role"))


