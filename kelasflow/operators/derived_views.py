"""Operators that add the browser-side derived columns to engine results."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelasflow.functions import derived as U
from kelasflow.operators import progress, roster
from kelasflow.sources.catalog import Tables


def student_cards(t: Tables) -> DataFrame:
    """Roster with initials, ``-`` for missing text and the class-or-email label."""
    r = roster.student_roster(t)
    return r.select("id", "name", U.initials("name").alias("initials"),
                    U.or_dash("nisn").alias("nisn"), U.or_dash("jurusan").alias("jurusan"),
                    U.or_dash("kelas").alias("kelas"), U.label_or_email("kelas", "email").alias("label"))


def teacher_cards(t: Tables) -> DataFrame:
    """Teacher roster with initials and the subject list split on commas."""
    r = roster.teacher_roster(t)
    return r.select("id", "name", U.initials("name").alias("initials"), U.subject_list("mapel").alias("subjects"))


def search_count(t: Tables, keyword: str) -> DataFrame:
    """Number of rows the student search returns."""
    return roster.student_search(t, keyword).agg(F.count(F.lit(1)).alias("total"))


def progress_cards(t: Tables, now: dt.datetime) -> DataFrame:
    """Assignment progress with submission rate and days left."""
    p = progress.assignment_progress(t)
    return p.select("id", "created_by", "jumlah_kumpul", "jumlah_siswa",
                    U.submission_rate("jumlah_kumpul", "jumlah_siswa").alias("persen"),
                    U.days_left("deadline", now).alias("sisa_hari"),
                    U.display_date("deadline").alias("deadline_text"),
                    U.display_date("created_at").alias("dibuat_text"))


def student_assignment_status(t: Tables, ui_rule: bool = False) -> DataFrame:
    """Student assignment rows with status label and grade text."""
    a = progress.student_assignments(t)
    return a.select("siswa_id", "id", "nilai", "file_kumpul",
                    U.grade_status("nilai", "file_kumpul", ui_rule).alias("status"),
                    U.grade_text("nilai", ui_rule).alias("nilai_text"))


def grade_bands(t: Tables) -> DataFrame:
    """Graded submissions per teacher (assignment author) and band."""
    p = t.pengumpulan_tugas.where(F.col("nilai").isNotNull()).select("tugas_id", "nilai")
    a = t.tugas.select(F.col("id").alias("tugas_id"), F.col("created_by").alias("guru_id"))
    return (p.join(a, "tugas_id").groupBy("guru_id", U.grade_band("nilai").alias("band"))
            .agg(F.count(F.lit(1)).alias("total")))


def subject_month_average(t: Tables) -> DataFrame:
    """Average grade per student, subject (the author's mapel) and month
    of submission."""
    p = t.pengumpulan_tugas.where(F.col("nilai").isNotNull()).select("tugas_id", "siswa_id", "nilai", "dikumpulkan_at")
    a = t.tugas.select(F.col("id").alias("tugas_id"), F.col("created_by").alias("user_id"))
    g = t.guru_details.select("user_id", "mapel")
    return (p.join(a, "tugas_id").join(g, "user_id")
            .groupBy("siswa_id", "mapel", F.month("dikumpulkan_at").alias("bulan"))
            .agg(F.avg("nilai").alias("rata_rata")))


def submission_links(t: Tables, base_url: str) -> DataFrame:
    """Absolute link per submission file."""
    return t.pengumpulan_tugas.select("id", U.absolute_link("file_path", base_url).alias("file_url"))
