"""Integrity audits: uniqueness (A01), orphaned foreign keys (A02) and
domain / not-null / range rules (A03).  Each is one DataFrame of findings;
nothing is dropped or fixed here."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelasflow.schema import ROLES, VERIFICATION_STATUSES
from kelasflow.sources.catalog import Tables

# Unique and de-facto unique keys: (name, table, key columns, compare
# lower-cased).  Text keys of the store compare case-insensitively.
UNIQUE_KEYS = [
    ("users.email", "users", ["email"], True),
    ("siswa_details.nisn", "siswa_details", ["nisn"], True),
    ("guru_details.nip", "guru_details", ["nip"], True),
    ("kelas.nama_kelas", "kelas", ["nama_kelas"], True),
    ("siswa_details.user_id", "siswa_details", ["user_id"], False),
    ("guru_details.user_id", "guru_details", ["user_id"], False),
    ("pengumpulan_tugas.tugas_id+siswa_id", "pengumpulan_tugas", ["tugas_id", "siswa_id"], False),
]

# The 20 live foreign keys of the store: (child table, column, parent table).
# The parent column is always ``id``.
FOREIGN_KEYS = [
    ("courses", "created_by", "users"),
    ("verifications", "user_id", "users"),
    ("activity_logs", "user_id", "users"),
    ("siswa_details", "user_id", "users"),
    ("siswa_details", "kelas_id", "kelas"),
    ("guru_details", "user_id", "users"),
    ("guru_kelas", "guru_id", "guru_details"),
    ("guru_kelas", "kelas_id", "kelas"),
    ("course_kelas", "course_id", "courses"),
    ("course_kelas", "kelas_id", "kelas"),
    ("tugas", "created_by", "users"),
    ("tugas_kelas", "tugas_id", "tugas"),
    ("tugas_kelas", "kelas_id", "kelas"),
    ("pengumpulan_tugas", "tugas_id", "tugas"),
    ("pengumpulan_tugas", "siswa_id", "users"),
    ("diskusi", "created_by", "users"),
    ("diskusi_kelas", "diskusi_id", "diskusi"),
    ("diskusi_kelas", "kelas_id", "kelas"),
    ("chat_diskusi", "diskusi_id", "diskusi"),
    ("chat_diskusi", "user_id", "users"),
]


def _child_key(df: DataFrame):
    if "id" in df.columns:
        return F.col("id").cast("string")
    return F.concat_ws(":", *[F.col(c).cast("string") for c in df.columns])


def uniqueness(t: Tables) -> DataFrame:
    """Key values held by more than one row (NULL keys are allowed to repeat).
    Counting is a partial aggregate, so a very hot key costs no more than others."""
    parts = []
    for name, table, keys, fold in UNIQUE_KEYS:
        df = t[table].select(*[(F.lower(F.col(k)) if fold else F.col(k)).alias(f"k{i}")
                               for i, k in enumerate(keys)])
        kcols = [f"k{i}" for i in range(len(keys))]
        df = df.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in kcols]))
        parts.append(df.groupBy(*kcols).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
                     .select(F.lit(name).alias("key_name"),
                             F.concat_ws(":", *[F.col(c).cast("string") for c in kcols]).alias("key_value"), "n"))
    return reduce(DataFrame.unionByName, parts)


def orphans(t: Tables) -> DataFrame:
    """Child rows whose non-NULL reference has no parent row.

    Each child table is read once: its references are unpivoted to (fk,
    child_key, ref) rows, and the rows of one parent meet its ids in one anti
    join.  A reference that very many children share is split by the skew
    join.
    """
    columns: dict[str, list[tuple[str, str]]] = {}
    for child, col, parent in FOREIGN_KEYS:
        columns.setdefault(child, []).append((col, parent))
    refs = []
    for child, cols in columns.items():
        df = t[child]
        entries = F.array(*[F.struct(F.lit(f"{child}.{c}").alias("fk"), F.lit(p).alias("parent"),
                                     F.col(c).cast("bigint").alias("ref")) for c, p in cols])
        refs.append(df.select(_child_key(df).alias("child_key"), F.inline(entries)).where(F.col("ref").isNotNull()))
    rows = reduce(DataFrame.unionByName, refs)
    parents = reduce(DataFrame.unionByName, [
        t[p].select(F.lit(p).alias("parent"), F.col("id").cast("bigint").alias("ref"))
        for p in sorted({p for _, _, p in FOREIGN_KEYS})])
    return rows.join(parents, ["parent", "ref"], "left_anti").select("fk", "child_key", "ref")


def _rules(t: Tables) -> dict[str, list[tuple[str, object]]]:
    s = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) == ""  # noqa: E731  (NULL or blank text)
    return {
        "users": [("users.name not null", F.col("name").isNull()),
                  ("users.email not null", F.col("email").isNull()),
                  ("users.role in domain", F.col("role").isNull() | ~F.col("role").isin(*ROLES))],
        "verifications": [("verifications.status in domain",
                           F.col("status").isNotNull() & ~F.col("status").isin(*VERIFICATION_STATUSES))],
        "courses": [("courses.name not null", F.col("name").isNull())],
        "siswa_details": [("siswa_details.user_id not null", F.col("user_id").isNull())],
        "guru_details": [("guru_details.user_id not null", F.col("user_id").isNull())],
        "kelas": [("kelas.nama_kelas not null", F.col("nama_kelas").isNull())],
        "tugas": [("tugas.judul required", s("judul")), ("tugas.deskripsi required", s("deskripsi")),
                  ("tugas.deadline required", F.col("deadline").isNull())],
        "pengumpulan_tugas": [("pengumpulan_tugas.nilai in 0..100", ~F.col("nilai").between(0, 100))],
        "diskusi": [("diskusi.judul required", s("judul")), ("diskusi.isi required", s("isi"))],
        "chat_diskusi": [("chat_diskusi.isi not blank", F.coalesce(F.col("isi"), F.lit("")) == "")],
    }


def domain_rules(t: Tables) -> DataFrame:
    """Violations per rule: one scan per table with one ``count_if`` per rule."""
    parts = []
    for table, rules in _rules(t).items():
        agg = t[table].agg(*[F.count_if(F.coalesce(cond, F.lit(False))).alias(f"r{i}")
                             for i, (_, cond) in enumerate(rules)])
        stack = ", ".join(f"'{name}', r{i}" for i, (name, _) in enumerate(rules))
        parts.append(agg.selectExpr(f"stack({len(rules)}, {stack}) AS (rule, violations)"))
    return reduce(DataFrame.unionByName, parts)
