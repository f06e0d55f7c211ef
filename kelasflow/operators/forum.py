"""Discussion threads and their messages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelasflow.functions.aggregates import sorted_list
from kelasflow.functions.expansion import expand
from kelasflow.functions.predicates import keyed
from kelasflow.sources.catalog import Tables


def _thread_classes(t: Tables, sep: str) -> DataFrame:
    """Sorted class list per thread, aggregated before any join to threads."""
    k = t.kelas.select(F.col("id").alias("kelas_id"), "nama_kelas")
    return (t.diskusi_kelas.join(k, "kelas_id").groupBy("diskusi_id")
            .agg(sorted_list("nama_kelas", sep).alias("kelas")))


def teacher_threads(t: Tables, teacher_ids: DataFrame | None = None, ordered: bool = False) -> DataFrame:
    """Threads with their author's name and ', '-joined class list; threads
    with no class (or no existing author) are not listed."""
    d = keyed(t.diskusi, "created_by", teacher_ids)
    a = t.users.select(F.col("id").alias("created_by"), F.col("name").alias("guru"))
    cls = _thread_classes(t, ", ")
    out = (d.join(a, "created_by").join(cls, d.id == cls.diskusi_id)
           .select("id", "judul", "isi", "guru", "created_by", "created_at", "kelas"))
    # ordered: per teacher, newest thread first
    return out.orderBy("created_by", F.col("created_at").desc(), "id") if ordered else out


def thread_detail(t: Tables, ids: DataFrame | None = None) -> DataFrame:
    """Title, body and ','-joined class list (no space, as in the reference)."""
    d = keyed(t.diskusi, "id", ids)
    cls = _thread_classes(t, ",")
    return d.join(cls, d.id == cls.diskusi_id).select("id", "judul", "isi", "kelas")


def thread_messages(t: Tables, thread_ids: DataFrame | None = None) -> DataFrame:
    """Messages with the sender's name and role, ordered by (thread, time, id).

    The total order is a range-partitioned sort, so even one very busy
    thread is split over many tasks.
    """
    c = keyed(t.chat_diskusi, "diskusi_id", thread_ids)
    u = t.users.select(F.col("id").alias("user_id"), "name", "role")
    return (c.join(u, "user_id")
            .select("id", "diskusi_id", "user_id", "isi", "created_at", "name", "role")
            .orderBy("diskusi_id", "created_at", "id"))


def student_threads(t: Tables, student_ids: DataFrame | None = None) -> DataFrame:
    """Per student with a class: threads posted to that class, with author
    name and class name."""
    sd = (keyed(t.siswa_details, "user_id", student_ids).where(F.col("kelas_id").isNotNull())
          .select(F.col("user_id").alias("siswa_id"), "kelas_id").distinct())
    k = t.kelas.select(F.col("id").alias("kelas_id"), "nama_kelas")
    a = t.users.select(F.col("id").alias("created_by"), F.col("name").alias("guru"))
    d = t.diskusi.join(a, "created_by")
    posted = (t.diskusi_kelas.select("diskusi_id", "kelas_id").join(k, "kelas_id")
              .join(d, F.col("diskusi_id") == d.id))
    return (expand(sd, posted, "kelas_id", t.siswa_details if student_ids is None else sd, t.diskusi_kelas)
            .select("siswa_id", "id", "judul", "isi", "created_by", "created_at", "guru", "nama_kelas"))
