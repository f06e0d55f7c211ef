"""Assignments: progress per assignment, submission status, per-student views.

The reference answers these for one teacher / student / assignment id per
web request; here every operator computes all keys in one job and takes an
optional key frame to narrow it.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelasflow.functions.aggregates import sorted_array, sorted_list
from kelasflow.functions.expansion import expand_without
from kelasflow.functions.predicates import keyed
from kelasflow.functions.shared import materialize
from kelasflow.sources.catalog import Tables

TUGAS_COLS = ["id", "judul", "deskripsi", "deadline", "created_at", "file_path", "created_by"]


def assigned_pairs(t: Tables) -> DataFrame:
    """Distinct (tugas_id, kelas_id) pairs whose class exists."""
    return (t.tugas_kelas.select("tugas_id", "kelas_id")
            .join(t.kelas.select(F.col("id").alias("kelas_id")), "kelas_id", "left_semi")
            .dropDuplicates(["tugas_id", "kelas_id"]))


def class_membership(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Split students by how many distinct classes their detail rows name.

    Returns ``(class_size, multi)``: ``class_size(kelas_id, n_single)`` counts
    students whose detail rows all name that one class; ``multi(user_id,
    kelas_id)`` lists every class of the (rare) students with several.  With
    these, distinct students over a set of classes = sum of ``n_single`` +
    distinct multi-class students, with no assignment x student fan-out.
    """
    per_user = (t.siswa_details.where(F.col("kelas_id").isNotNull())
                .groupBy("user_id").agg(F.collect_set("kelas_id").alias("ks")))
    class_size = (per_user.where(F.size("ks") == 1)
                  .groupBy(F.col("ks")[0].alias("kelas_id")).agg(F.count(F.lit(1)).alias("n_single")))
    multi = per_user.where(F.size("ks") > 1).select("user_id", F.explode("ks").alias("kelas_id"))
    return class_size, multi


def select_assignments(t: Tables, kind: str | None = None, as_of: dt.date | None = None,
                       days: int = 3, teacher_ids: DataFrame | None = None) -> DataFrame:
    """Assignment rows after the card filter of the teacher's list.

    ``kind``: ``deadline`` (deadline in [as_of, as_of + days], inclusive),
    ``ungraded`` (has a submission with no grade), ``completed``
    (deadline < as_of); anything else keeps all rows.
    """
    tg = keyed(t.tugas, "created_by", teacher_ids)
    if kind == "deadline":
        lo = F.lit(as_of)
        tg = tg.where(F.col("deadline").between(lo, F.date_add(lo, days)))
    elif kind == "ungraded":
        open_ = (t.pengumpulan_tugas.groupBy("tugas_id").agg(F.count_if(F.col("nilai").isNull()).alias("n_open"))
                 .where("n_open > 0").select("tugas_id"))
        tg = tg.join(open_, tg.id == open_.tugas_id, "left_semi")
    elif kind == "completed":
        tg = tg.where(F.col("deadline") < F.lit(as_of))
    return tg


def assignment_progress(t: Tables, kind: str | None = None, as_of: dt.date | None = None,
                        days: int = 3, teacher_ids: DataFrame | None = None, ordered: bool = False) -> DataFrame:
    """Per assignment with at least one class: its columns, the sorted distinct
    class list, submissions received (from anyone) and distinct students in
    the assigned classes.

    Plan: three pre-aggregates keyed by ``tugas_id`` (class list + single-class
    sizes, multi-class students, submissions) joined to the assignments, so
    the work is linear in the tables instead of assignments x students x
    submissions.
    """
    ungraded = kind == "ungraded"       # told from the same aggregate that counts the submissions
    tg = select_assignments(t, None if ungraded else kind, as_of, days, teacher_ids).select(*TUGAS_COLS)
    pairs = assigned_pairs(t)
    subs = t.pengumpulan_tugas.select("tugas_id", "id", "nilai")
    if kind in ("deadline", "completed") or teacher_ids is not None:
        ids = tg.select(F.col("id").alias("tugas_id"))
        pairs = pairs.join(ids, "tugas_id", "left_semi")
        subs = subs.join(ids, "tugas_id", "left_semi")

    class_size, multi = class_membership(t)
    per_class = (pairs.join(t.kelas.select(F.col("id").alias("kelas_id"), "nama_kelas"), "kelas_id")
                 .join(class_size, "kelas_id", "left")
                 .groupBy("tugas_id")
                 .agg(sorted_list("nama_kelas", ", ", distinct=True).alias("kelas"),
                      F.sum(F.coalesce("n_single", F.lit(0))).alias("n_single")))
    multi_n = (pairs.join(multi, "kelas_id").select("tugas_id", "user_id").distinct()
               .groupBy("tugas_id").agg(F.count(F.lit(1)).alias("n_multi")))
    # a submission id is unique: rows are counted, so the partial counts merge
    sub_n = subs.groupBy("tugas_id").agg(F.count("id").alias("jumlah_kumpul"),
                                         F.count_if(F.col("nilai").isNull()).alias("n_open"))
    if ungraded:
        sub_n = sub_n.where("n_open > 0")

    out = (tg.join(per_class, tg.id == per_class.tugas_id).drop("tugas_id")
           .join(multi_n, F.col("id") == multi_n.tugas_id, "left").drop("tugas_id")
           .join(sub_n, F.col("id") == sub_n.tugas_id, "inner" if ungraded else "left").drop("tugas_id")
           .select(*TUGAS_COLS, "kelas",
                   F.coalesce("jumlah_kumpul", F.lit(0)).alias("jumlah_kumpul"),
                   (F.col("n_single") + F.coalesce("n_multi", F.lit(0))).cast("bigint").alias("jumlah_siswa")))
    # ordered: per teacher, newest assignment first (the teacher's list view)
    return out.orderBy("created_by", F.col("created_at").desc(), "id") if ordered else out


def students_reached(t: Tables) -> DataFrame:
    """(tugas_id, n): distinct students in the classes of every assignment
    with at least one, as :func:`assignment_progress` counts them, without
    the lists and the submissions."""
    pairs = assigned_pairs(t)
    class_size, multi = class_membership(t)
    single = (pairs.join(class_size, "kelas_id", "left").groupBy("tugas_id")
              .agg(F.sum(F.coalesce("n_single", F.lit(0))).alias("n_single")))
    multi_n = (pairs.join(multi, "kelas_id").select("tugas_id", "user_id").distinct()
               .groupBy("tugas_id").agg(F.count(F.lit(1)).alias("n_multi")))
    return (t.tugas.select(F.col("id").alias("tugas_id")).join(single, "tugas_id").join(multi_n, "tugas_id", "left")
            .select("tugas_id", (F.col("n_single") + F.coalesce("n_multi", F.lit(0))).cast("bigint").alias("n")))


def assignment_classes(t: Tables, teacher_ids: DataFrame | None = None) -> DataFrame:
    """Every assignment with the sorted array of its class names (empty if none)."""
    tg = keyed(t.tugas, "created_by", teacher_ids)
    names = (t.tugas_kelas.join(t.kelas.select(F.col("id").alias("kelas_id"), "nama_kelas"), "kelas_id")
             .groupBy("tugas_id").agg(sorted_array("nama_kelas").alias("kelas")))
    return (tg.join(names, tg.id == names.tugas_id, "left")
            .select("id", "judul", "deskripsi", "deadline", "file_path", "created_by", "created_at",
                    F.coalesce("kelas", F.array().cast("array<string>")).alias("kelas")))


def submission_status(t: Tables, teacher_ids: DataFrame | None = None) -> DataFrame:
    """Per assignment: who submitted (``sudah_kumpul``) and who is missing
    (``belum_kumpul``), one long frame tagged by ``status``.

    Submitted rows need the submitter's detail row and class (inner joins, as
    the reference does, so a submitter with no class is not listed).  Missing
    = students of the assigned classes minus submitters; it follows SQL
    ``NOT IN``: an assignment with a submission whose student id is NULL has
    no missing list at all.

    The missing list is assignment x class roster.  It is expanded on the
    class, where a class that makes very many rows is cut into parts, and
    each assignment brings the list of those of the class who submitted
    (:func:`expand_without`), so its rows are not shuffled again.
    """
    tg = keyed(t.tugas, "created_by", teacher_ids).select(F.col("id").alias("tugas_id"))
    kelas = t.kelas.select(F.col("id").alias("kelas_id"), F.col("nama_kelas").alias("kelas"))
    people = t.users.select(F.col("id").alias("user_id"), "name")
    placed = (t.siswa_details.select("user_id", "kelas_id")
              .join(kelas, "kelas_id").join(people, "user_id"))          # student x class x name

    # read three times below
    subs = materialize(t.pengumpulan_tugas.join(tg, "tugas_id", "left_semi")
                       .select("tugas_id", F.col("siswa_id").alias("user_id"), "file_path", "nilai"), "submitted")
    done = (subs.join(placed, "user_id")
            .select("tugas_id", F.lit("sudah_kumpul").alias("status"), F.col("user_id").alias("id"),
                    "name", "kelas", "file_path", "nilai"))

    null_sub = subs.where(F.col("user_id").isNull()).select("tugas_id")
    pairs = (t.tugas_kelas.join(tg, "tugas_id", "left_semi").select("tugas_id", "kelas_id")
             .join(null_sub, "tugas_id", "left_anti"))
    submitted = subs.select("tugas_id", "user_id").join(placed.select("user_id", "kelas_id").distinct(), "user_id")
    missing = expand_without(pairs, placed, "kelas_id", "tugas_id", "user_id", submitted, t.tugas_kelas, t.siswa_details)
    missing = missing.select("tugas_id", F.lit("belum_kumpul").alias("status"), F.col("user_id").alias("id"),
                             "name", "kelas", F.lit(None).cast("string").alias("file_path"),
                             F.lit(None).cast("int").alias("nilai"))
    return done.unionByName(missing)


def student_assignments(t: Tables, student_ids: DataFrame | None = None, ordered: bool = False) -> DataFrame:
    """See :func:`_student_assignments`; ``ordered`` sorts per student by
    deadline, latest first (id, then grade as tie-breaks)."""
    out = _student_assignments(t, student_ids)
    return out.orderBy("siswa_id", F.col("deadline").desc(), "id", "nilai") if ordered else out


def _student_assignments(t: Tables, student_ids: DataFrame | None = None) -> DataFrame:
    """Per student with a class: every assignment of that class with its
    author, class name and the student's own grade / file (left join on
    assignment AND student, kept in the ON clause; duplicate submissions of
    one pair repeat the row, as in the reference).

    The rows with a submission are found from the submissions; the others are
    expanded on the class, where a class that makes very many rows is cut into
    parts and each assignment brings the list of those who submitted
    (:func:`expand_without`), so the expansion is not shuffled again.
    """
    sd = (keyed(t.siswa_details, "user_id", student_ids).where(F.col("kelas_id").isNotNull())
          .select(F.col("user_id").alias("siswa_id"), "kelas_id").distinct())
    kelas = t.kelas.select(F.col("id").alias("kelas_id"), "nama_kelas")
    authors = t.users.select(F.col("id").alias("created_by"), F.col("name").alias("guru"))
    tasks = (t.tugas.select(F.col("id").alias("tugas_id"), "judul", "deskripsi", "deadline", "created_at",
                            "file_path", "created_by")
             .join(authors, "created_by")
             .join(t.tugas_kelas.select("tugas_id", "kelas_id"), "tugas_id"))
    subs = t.pengumpulan_tugas.select("tugas_id", "siswa_id", "nilai", F.col("file_path").alias("file_kumpul"))
    assigned = t.tugas_kelas.select("tugas_id", "kelas_id").distinct()
    own = materialize(subs.join(sd, "siswa_id").join(assigned, ["tugas_id", "kelas_id"]), "own")    # read twice below
    with_sub = tasks.join(own, ["tugas_id", "kelas_id"]).join(kelas, "kelas_id")
    rest = expand_without(tasks, sd.join(kelas, "kelas_id"), "kelas_id", "tugas_id", "siswa_id",
                          own.select("tugas_id", "kelas_id", "siswa_id"), t.tugas_kelas,
                          t.siswa_details if student_ids is None else sd)
    without = rest.withColumns({"nilai": F.lit(None).cast("int"), "file_kumpul": F.lit(None).cast("string")})
    return with_sub.unionByName(without.select(*with_sub.columns)).select(
        "siswa_id", F.col("tugas_id").alias("id"), "judul", "deskripsi", "deadline", "created_at",
        "file_path", "guru", "nama_kelas", "nilai", "file_kumpul")


def student_assignment_stats(t: Tables, student_ids: DataFrame | None = None) -> DataFrame:
    """Per student: assignments of their class(es) (``total``), graded
    submissions (``completed``) and ``total`` minus all their submissions
    (``pending``, negative when they submitted more than was assigned)."""
    students = keyed(t.users.where(F.col("role") == "siswa"), "id", student_ids).select(F.col("id").alias("siswa_id"))
    per_class = (t.tugas_kelas.join(t.tugas.select(F.col("id").alias("tugas_id")), "tugas_id")
                 .groupBy("kelas_id").agg(F.count(F.lit(1)).alias("n")))
    total = (t.siswa_details.select(F.col("user_id").alias("siswa_id"), "kelas_id")
             .join(per_class, "kelas_id")
             .groupBy("siswa_id").agg(F.sum("n").alias("total")))
    subs = (t.pengumpulan_tugas.groupBy("siswa_id")
            .agg(F.count(F.lit(1)).alias("submitted"), F.count("nilai").alias("completed")))
    return (students.join(total, "siswa_id", "left").join(subs, "siswa_id", "left")
            .select("siswa_id",
                    F.coalesce("total", F.lit(0)).cast("bigint").alias("total"),
                    F.coalesce("completed", F.lit(0)).cast("bigint").alias("completed"),
                    (F.coalesce("total", F.lit(0)) - F.coalesce("submitted", F.lit(0))).cast("bigint").alias("pending")))
