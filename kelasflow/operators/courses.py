"""Courses and classes: catalogue, enrolments, teacher dashboards, materials."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelasflow.functions.aggregates import sorted_list
from kelasflow.functions.expansion import expand
from kelasflow.functions.predicates import contains_ci, keyed
from kelasflow.sources.catalog import Tables

COURSE_COLS = ["id", "name", "description", "created_by", "created_at", "file_path"]


def _teachers(t: Tables) -> DataFrame:
    return t.users.where(F.col("role") == "guru")


def class_list(t: Tables) -> DataFrame:
    return t.kelas.select("id", "nama_kelas")


def course_catalog(t: Tables, ids: DataFrame | None = None, author_col: str = "created_by_name") -> DataFrame:
    """Courses whose author is a teacher, with the author's name.  (The
    reference's LEFT JOIN is cancelled by its WHERE on the author's role, so
    courses by an admin or by nobody are not listed; written as inner.)"""
    c = keyed(t.courses, "id", ids)
    a = _teachers(t).select(F.col("id").alias("created_by"), F.col("name").alias(author_col))
    return c.join(a, "created_by").select(*COURSE_COLS, author_col)


def teacher_course_total(t: Tables) -> DataFrame:
    """Number of courses written by teachers (differs from the admin count)."""
    return course_catalog(t).agg(F.count(F.lit(1)).alias("total"))


def enrollment_counts(t: Tables, course_ids: DataFrame | None = None) -> DataFrame:
    """Enrolled students per course, 0 for courses with none (enrolments are
    pre-aggregated per course before the join)."""
    n = t.course_enrollments.groupBy("course_id").agg(F.count("student_id").alias("total"))
    c = keyed(t.courses, "id", course_ids).select(F.col("id").alias("course_id"))
    return c.join(n, "course_id", "left").select("course_id", F.coalesce("total", F.lit(0)).alias("total"))


def enrolled_students(t: Tables, course_ids: DataFrame | None = None) -> DataFrame:
    """Per enrolment: the student's id, name, e-mail and (left-joined) class,
    programme and student number."""
    ce = keyed(t.course_enrollments, "course_id", course_ids)
    u = t.users.select(F.col("id").alias("student_id"), "name", "email")
    sd = t.siswa_details.select(F.col("user_id").alias("student_id"), "jurusan", "nisn", "kelas_id")
    k = t.kelas.select(F.col("id").alias("kelas_id"), F.col("nama_kelas").alias("kelas"))
    return (ce.join(u, "student_id").join(sd, "student_id", "left").join(k, "kelas_id", "left")
            .select("course_id", F.col("student_id").alias("id"), "name", "email", "kelas", "jurusan", "nisn"))


def _course_class_names(t: Tables, sep: str = ", ") -> DataFrame:
    k = t.kelas.select(F.col("id").alias("kelas_id"), "nama_kelas")
    return (t.course_kelas.join(k, "kelas_id").groupBy("course_id")
            .agg(sorted_list("nama_kelas", sep).alias("kelas")))


def courses_by_teacher(t: Tables, teacher_ids: DataFrame | None = None) -> DataFrame:
    """Per teacher: their courses with the sorted list of linked classes."""
    g = keyed(_teachers(t), "id", teacher_ids).select(F.col("id").alias("created_by"))
    c = t.courses.join(g, "created_by", "left_semi")
    names = _course_class_names(t)
    return (c.join(names, c.id == names.course_id, "left")
            .select(F.col("created_by").alias("guru_id"), "id", "name", "description", "kelas"))


def class_sizes(t: Tables) -> DataFrame:
    """Detail rows per class id (what the reference counts as class size)."""
    return (t.siswa_details.where(F.col("kelas_id").isNotNull())
            .groupBy("kelas_id").agg(F.count(F.lit(1)).alias("jumlah_siswa")))


def teacher_dashboard(t: Tables, teacher_ids: DataFrame | None = None) -> DataFrame:
    """Per teacher: courses written and students reached, where each class
    linked to any of their courses counts once (its detail-row count).

    The reference loops over classes issuing one COUNT each; here it is one
    distinct (teacher, class) set joined to pre-aggregated class sizes.
    """
    g = keyed(_teachers(t), "id", teacher_ids).select(F.col("id").alias("guru_id"))
    c = t.courses.select(F.col("id").alias("course_id"), F.col("created_by").alias("guru_id"))
    n_courses = c.groupBy("guru_id").agg(F.count(F.lit(1)).alias("total_mapel"))
    reach = (c.join(t.course_kelas.select("course_id", "kelas_id"), "course_id")
             .select("guru_id", "kelas_id").distinct()
             .join(class_sizes(t), "kelas_id")
             .groupBy("guru_id").agg(F.sum("jumlah_siswa").alias("total_siswa")))
    return (g.join(n_courses, "guru_id", "left").join(reach, "guru_id", "left")
            .select("guru_id", F.coalesce("total_mapel", F.lit(0)).alias("total_mapel"),
                    F.coalesce("total_siswa", F.lit(0)).cast("bigint").alias("total_siswa")))


def teacher_course_classes(t: Tables, teacher_ids: DataFrame | None = None, ordered: bool = False) -> DataFrame:
    """Per teacher course x linked class: course name, class name and class
    size (0 for an empty class; the correlated COUNT becomes a left join to
    pre-aggregated sizes)."""
    g = keyed(_teachers(t), "id", teacher_ids).select(F.col("id").alias("created_by"))
    c = (t.courses.join(g, "created_by", "left_semi")
         .select(F.col("id").alias("course_id"), F.col("created_by").alias("guru_id"),
                 F.col("name").alias("course_name")))
    k = t.kelas.select(F.col("id").alias("kelas_id"), F.col("nama_kelas").alias("jurusan"))
    out = (c.join(t.course_kelas.select("course_id", "kelas_id"), "course_id").join(k, "kelas_id")
           .join(class_sizes(t), "kelas_id", "left")
           .select("guru_id", "course_id", "course_name", "jurusan",
                   F.coalesce("jumlah_siswa", F.lit(0)).alias("jumlah_siswa")))
    # ordered: per teacher by class name (course id as tie-break)
    return out.orderBy("guru_id", "jurusan", "course_id") if ordered else out


def course_class_search(t: Tables, keyword: str) -> DataFrame:
    """Teacher course/class rows whose course or class name contains the
    keyword, case-insensitively (plain substring, no wildcards)."""
    return teacher_course_classes(t).where(contains_ci("course_name", keyword) | contains_ci("jurusan", keyword))


def class_students(t: Tables, class_names: DataFrame | None = None) -> DataFrame:
    """Per class: its students' names, student numbers and programmes."""
    k = keyed(t.kelas, "nama_kelas", class_names).select(F.col("id").alias("kelas_id"),
                                                                  F.col("nama_kelas").alias("kelas"))
    u = t.users.select(F.col("id").alias("user_id"), "name")
    return (t.siswa_details.join(k, "kelas_id").join(u, "user_id")
            .select("kelas", "name", "nisn", "jurusan"))


def student_materials(t: Tables, student_ids: DataFrame | None = None, ordered: bool = False) -> DataFrame:
    """Per student with a class: materials linked to that class, with the
    upload date as dd-MM-yyyy and the author's name (courses without an
    existing author are not shown, as in the reference's inner join)."""
    sd = (keyed(t.siswa_details, "user_id", student_ids).where(F.col("kelas_id").isNotNull())
          .select(F.col("user_id").alias("siswa_id"), "kelas_id").distinct())
    a = t.users.select(F.col("id").alias("created_by"), F.col("name").alias("guru"))
    c = (t.courses.join(a, "created_by")
         .select(F.col("id").alias("course_id"), "name", "description", "file_path", "created_at",
                 F.date_format("created_at", "dd-MM-yyyy").alias("tanggal_upload"), "guru"))
    # a class with very many students or courses is cut into parts; the courses join before the expansion
    linked = t.course_kelas.select("course_id", "kelas_id").join(c, "course_id")
    joined = expand(sd, linked, "kelas_id", t.siswa_details if student_ids is None else sd, t.course_kelas)
    out = (joined
           .select("siswa_id", F.col("course_id").alias("id"), "name", "description", "file_path",
                   "tanggal_upload", "guru", "created_at"))
    # ordered: per student, newest material first
    out = out.orderBy("siswa_id", F.col("created_at").desc(), "id") if ordered else out
    return out.drop("created_at")
