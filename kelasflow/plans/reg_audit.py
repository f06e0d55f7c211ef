"""Registered integrity audits."""

import re

from pyspark.sql import functions as F

from kelasflow.operators import audit as AU
from kelasflow.plans import params as X
from kelasflow.plans.registry import register


@register("a01_uniqueness_audit", """
SELECT 'users.email' AS key_name, lower(email) AS key_value, count(*) AS n FROM users
  WHERE email IS NOT NULL GROUP BY lower(email) HAVING count(*) > 1
UNION ALL SELECT 'siswa_details.nisn', lower(nisn), count(*) FROM siswa_details
  WHERE nisn IS NOT NULL GROUP BY lower(nisn) HAVING count(*) > 1
UNION ALL SELECT 'guru_details.nip', lower(nip), count(*) FROM guru_details
  WHERE nip IS NOT NULL GROUP BY lower(nip) HAVING count(*) > 1
UNION ALL SELECT 'kelas.nama_kelas', lower(nama_kelas), count(*) FROM kelas
  WHERE nama_kelas IS NOT NULL GROUP BY lower(nama_kelas) HAVING count(*) > 1
UNION ALL SELECT 'siswa_details.user_id', CAST(user_id AS VARCHAR), count(*) FROM siswa_details
  WHERE user_id IS NOT NULL GROUP BY user_id HAVING count(*) > 1
UNION ALL SELECT 'guru_details.user_id', CAST(user_id AS VARCHAR), count(*) FROM guru_details
  WHERE user_id IS NOT NULL GROUP BY user_id HAVING count(*) > 1
UNION ALL SELECT 'pengumpulan_tugas.tugas_id+siswa_id', CAST(tugas_id AS VARCHAR) || ':' || CAST(siswa_id AS VARCHAR),
  count(*) FROM pengumpulan_tugas WHERE tugas_id IS NOT NULL AND siswa_id IS NOT NULL
  GROUP BY tugas_id, siswa_id HAVING count(*) > 1
""")
def a01(t):
    return AU.uniqueness(t)


def _orphan_sql():
    parts = []
    for child, col, parent in AU.FOREIGN_KEYS:
        key = ("CAST(c.id AS VARCHAR)" if child != "tugas_kelas"
               else "CAST(c.tugas_id AS VARCHAR) || ':' || CAST(c.kelas_id AS VARCHAR)")
        parts.append(f"SELECT '{child}.{col}' AS fk, {key} AS child_key, CAST(c.{col} AS BIGINT) AS ref "
                     f"FROM {child} c WHERE c.{col} IS NOT NULL "
                     f"AND NOT EXISTS (SELECT 1 FROM {parent} p WHERE p.id = c.{col})")
    return "\nUNION ALL\n".join(parts)


@register("a02_orphan_audit", _orphan_sql())
def a02(t):
    return AU.orphans(t)


_RULES_SQL = [
    ("users", "users.name not null", "name IS NULL"),
    ("users", "users.email not null", "email IS NULL"),
    ("users", "users.role in domain", "role IS NULL OR role NOT IN ('admin', 'guru', 'siswa')"),
    ("verifications", "verifications.status in domain",
     "status IS NOT NULL AND status NOT IN ('pending', 'approved', 'rejected')"),
    ("courses", "courses.name not null", "name IS NULL"),
    ("siswa_details", "siswa_details.user_id not null", "user_id IS NULL"),
    ("guru_details", "guru_details.user_id not null", "user_id IS NULL"),
    ("kelas", "kelas.nama_kelas not null", "nama_kelas IS NULL"),
    ("tugas", "tugas.judul required", "coalesce(trim(judul), '') = ''"),
    ("tugas", "tugas.deskripsi required", "coalesce(trim(deskripsi), '') = ''"),
    ("tugas", "tugas.deadline required", "deadline IS NULL"),
    ("pengumpulan_tugas", "pengumpulan_tugas.nilai in 0..100", "NOT (nilai BETWEEN 0 AND 100)"),
    ("diskusi", "diskusi.judul required", "coalesce(trim(judul), '') = ''"),
    ("diskusi", "diskusi.isi required", "coalesce(trim(isi), '') = ''"),
    ("chat_diskusi", "chat_diskusi.isi not blank", "coalesce(isi, '') = ''"),
]


# The same audit after classes and teachers went without a cascade: class 26
# and the teachers of one subject are gone, what refers to them is not.
_GONE = f"""
kelas_left AS (SELECT * FROM kelas WHERE id <> 26),
users_left AS (SELECT * FROM users WHERE id NOT IN (SELECT user_id FROM guru_details WHERE mapel = '{X.SUBJECT}'))
"""


@register("a02_orphan_audit_after_loss", re.sub(
    r"FROM (kelas|users) p", r"FROM \1_left p", re.sub(r"FROM (kelas|users) c", r"FROM \1_left c", _orphan_sql())),
    ctes=_GONE)
def a02_loss(t):
    lost = t.guru_details.where(F.col("mapel") == X.SUBJECT).select(F.col("user_id").alias("id"))
    return AU.orphans(t.replace(kelas=t.kelas.where(F.col("id") != 26), users=t.users.join(lost, "id", "left_anti")))


@register("a03_domain_audit", "\nUNION ALL\n".join(
    f"SELECT '{name}' AS rule, count(*) FILTER (WHERE {cond}) AS violations FROM {table}"
    for table, name, cond in _RULES_SQL))
def a03(t):
    return AU.domain_rules(t)
