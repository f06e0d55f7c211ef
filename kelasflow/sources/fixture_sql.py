"""SQL twin of :mod:`kelasflow.sources.fixtures` for the DuckDB oracle.

A chain of CTEs over the 14 supplied base views; each oracle query is this
prefix followed by its own CTEs and final SELECT.
"""

FIXTURE_CTES = """
nsup AS (SELECT count(*) AS n FROM supplier),
ncust AS (SELECT count(*) AS n FROM customer),
nclass AS (SELECT count(DISTINCT c_custkey // 50) AS n FROM customer),
kelas AS (SELECT CAST(n_nationkey AS INTEGER) AS id, n_name AS nama_kelas FROM nation
          UNION ALL
          SELECT id, 'KELAS_' || CAST(id AS VARCHAR)
          FROM (SELECT DISTINCT CAST(25 + c_custkey // 50 AS INTEGER) AS id FROM customer)),
users AS (
  SELECT c.c_custkey AS id, c.c_name AS name, lower(c.c_name) || '@siswa.example.org' AS email,
         'siswa' AS role, CAST(NULL AS VARCHAR) AS foto, o.created_at
  FROM customer c LEFT JOIN (SELECT o_custkey, min(o_orderdate) AS created_at FROM orders GROUP BY o_custkey) o
    ON o.o_custkey = c.c_custkey
  UNION ALL
  SELECT 10000000 + s.s_suppkey, s.s_name, lower(s.s_name) || '@guru.example.org', 'guru', CAST(NULL AS VARCHAR),
         l.created_at
  FROM supplier s LEFT JOIN (SELECT l_suppkey, min(l_shipdate) AS created_at FROM lineitem GROUP BY l_suppkey) l
    ON l.l_suppkey = s.s_suppkey
  UNION ALL
  SELECT 20000000, 'Admin', 'admin@example.org', 'admin', CAST(NULL AS VARCHAR), TIMESTAMP '1995-01-01 00:00:00'
),
siswa_details AS (
  SELECT c_custkey AS id, c_custkey AS user_id, c_mktsegment AS jurusan,
         lpad(CAST(c_custkey AS VARCHAR), 10, '0') AS nisn,
         CASE WHEN c_custkey % 20 = 0 THEN NULL WHEN c_custkey % (SELECT n FROM nclass) = 1 THEN 0
              ELSE CAST(25 + c_custkey // 50 AS INTEGER) END AS kelas_id
  FROM customer WHERE c_custkey % 10 <> 9
),
guru_details AS (
  SELECT s.s_suppkey AS id, 10000000 + s.s_suppkey AS user_id, r.r_name AS mapel,
         lpad(CAST(s.s_suppkey AS VARCHAR), 18, '0') AS nip
  FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey
  WHERE s.s_suppkey % 10 <> 9
),
guru_kelas AS (
  SELECT s.s_suppkey * 100 + n.n_nationkey AS id, s.s_suppkey AS guru_id,
         CASE WHEN s.s_suppkey % 3 = 0 AND n.n_nationkey < 8 THEN 0
              ELSE CAST(25 + (s.s_suppkey + n.n_nationkey) % (SELECT n FROM nclass) AS INTEGER) END AS kelas_id
  FROM supplier s, nation n
  WHERE (s.s_suppkey + n.n_nationkey) % 8 = 0 AND s.s_suppkey % 10 NOT IN (8, 9)
),
courses AS (
  SELECT p.p_partkey AS id, p.p_name AS name, p.p_type AS description,
         CASE WHEN p.p_partkey % 15 = 0 THEN 20000000 WHEN p.p_partkey % 31 = 0 THEN NULL
              ELSE 10000000 + p.p_partkey % (SELECT n FROM nsup) END AS created_by,
         l.created_at, 'materi/' || CAST(p.p_partkey AS VARCHAR) AS file_path
  FROM part p LEFT JOIN (SELECT l_partkey, min(l_shipdate) AS created_at FROM lineitem GROUP BY l_partkey) l
    ON l.l_partkey = p.p_partkey
),
course_kelas AS (
  SELECT p.p_partkey * 100 + n.n_nationkey AS id, p.p_partkey AS course_id,
         CASE WHEN p.p_partkey % 3 = 0 AND n.n_nationkey < 12 THEN 0
              ELSE CAST(25 + (p.p_partkey + n.n_nationkey) % (SELECT n FROM nclass) AS INTEGER) END AS kelas_id
  FROM part p, nation n WHERE (p.p_partkey + n.n_nationkey) % 12 = 0
),
course_enrollments AS (
  SELECT DISTINCT l.l_partkey AS course_id, o.o_custkey AS student_id
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey WHERE l.l_partkey % 50 <> 0
),
tugas AS (
  SELECT o_orderkey AS id, 'Tugas ' || CAST(o_orderkey AS VARCHAR) AS judul, o_orderpriority AS deskripsi,
         CAST(o_orderdate AS DATE) AS deadline, 'tugas/' || CAST(o_orderkey AS VARCHAR) AS file_path,
         10000000 + o_custkey % (SELECT n FROM nsup) AS created_by,
         o_orderdate - INTERVAL 14 DAY AS created_at
  FROM orders
),
tugas_kelas AS (
  SELECT o.o_orderkey AS tugas_id, CAST(25 + c.c_custkey // 50 AS INTEGER) AS kelas_id
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
  UNION
  SELECT o_orderkey, CAST(25 + o_orderkey % (SELECT n FROM nclass) AS INTEGER) FROM orders
  UNION
  SELECT o_orderkey, 0 FROM orders WHERE o_orderkey % 3 = 0
),
pengumpulan_tugas AS (
  SELECT ((l.l_orderkey * 8 + l.l_linenumber) * 100000 + l.l_partkey) * 10000 + l.l_suppkey AS id,
         l.l_orderkey AS tugas_id,
         CASE WHEN l.l_linenumber = 1 THEN o.o_custkey ELSE l.l_partkey % (SELECT n FROM ncust) END AS siswa_id,
         'kumpul/' || CAST(l.l_orderkey AS VARCHAR) AS file_path,
         CASE WHEN l.l_returnflag = 'N' THEN NULL ELSE CAST(l.l_quantity * 2 AS INTEGER) END AS nilai,
         l.l_shipdate AS dikumpulkan_at
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
),
verifications AS (
  SELECT o_orderkey AS id, o_custkey AS user_id,
         CASE o_orderstatus WHEN 'F' THEN 'approved' WHEN 'O' THEN 'rejected' WHEN 'P' THEN 'pending' END AS status,
         o_orderdate AS requested_at
  FROM orders
),
activity_logs AS (SELECT event_id AS id, user_id, event_type AS action, ts AS created_at FROM events),
diskusi AS (
  SELECT conv_id AS id, substring(text, 1, 40) AS judul, text AS isi,
         10000000 + conv_id % (SELECT n FROM nsup) AS created_by,
         TIMESTAMP '2024-01-01 00:00:00' + (conv_id * 60) * INTERVAL '1' MINUTE AS created_at
  FROM conversations WHERE turn = 0
),
diskusi_kelas AS (
  SELECT c.conv_id * 100 + n.n_nationkey AS id, c.conv_id AS diskusi_id,
         CASE WHEN c.conv_id % 3 = 0 AND n.n_nationkey < 10 THEN 0
              ELSE CAST(25 + (c.conv_id + n.n_nationkey) % (SELECT n FROM nclass) AS INTEGER) END AS kelas_id
  FROM conversations c, nation n
  WHERE c.turn = 0 AND c.conv_id % 20 <> 19 AND (c.conv_id + n.n_nationkey) % 10 = 0
),
chat_diskusi AS (
  SELECT conv_id * 100 + turn AS id, conv_id AS diskusi_id,
         CASE WHEN role = 'assistant' THEN 10000000 + conv_id % (SELECT n FROM nsup)
              ELSE (conv_id * 7 + turn) % (SELECT n FROM ncust) END AS user_id,
         text AS isi,
         TIMESTAMP '2024-01-01 00:00:00' + (conv_id * 60 + turn) * INTERVAL '1' MINUTE AS created_at
  FROM conversations WHERE turn >= 1
)"""


def with_fixtures(body: str, ctes: str = "") -> str:
    """Oracle text: fixture CTEs, optional extra CTEs, then ``body``."""
    body = body.strip()
    if body.startswith("WITH"):         # a body with CTEs of its own
        body = f"SELECT * FROM ({body})"
    extra = f",\n{ctes.strip().rstrip(',')}" if ctes.strip() else ""
    recursive = " RECURSIVE" if "USING KEY" in extra else ""
    return f"WITH{recursive} {FIXTURE_CTES.strip()}{extra}\n{body}"
