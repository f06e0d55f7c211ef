"""Registered admin-dashboard queries."""

from kelasflow.operators import activity as A
from kelasflow.plans import params as X
from kelasflow.plans.registry import register


@register("q01_admin_counts", f"""
SELECT (SELECT count(*) FROM users WHERE role = 'siswa') AS total_siswa,
       (SELECT count(*) FROM users WHERE role = 'guru') AS total_guru,
       (SELECT count(*) FROM courses) AS total_mapel,
       (SELECT count(*) FROM activity_logs WHERE CAST(created_at AS DATE) = DATE '{X.AS_OF_ACTIVITY}') AS aktivitas_hari_ini
""")
def q01(t):
    return A.admin_counts(t, X.AS_OF_ACTIVITY)


@register("q02_pending_verifications", """
SELECT id, name, role, requested_at FROM (SELECT id AS user_id, name, role FROM users)
INNER JOIN (SELECT id, user_id, requested_at FROM verifications WHERE status = 'pending') USING (user_id)
""")
def q02(t):
    return A.pending_verifications(t)


@register("q03_recent_activity", f"""
SELECT action, name, created_at
FROM (SELECT action, name, created_at, row_number() OVER (ORDER BY created_at DESC, id DESC) AS place
      FROM activity_logs INNER JOIN (SELECT id AS user_id, name FROM users) USING (user_id))
WHERE place <= {X.TOP_LOGS}
""")
def q03(t):
    return A.recent_activity(t, X.TOP_LOGS)


@register("q04_monthly_signups", """
SELECT role, CAST(month(created_at) AS INTEGER) AS bulan, count(*) AS total
FROM users WHERE role IN ('siswa', 'guru') GROUP BY role, bulan
""")
def q04(t):
    return A.monthly_signups(t)


@register("q04_monthly_signups_by_year", """
SELECT role, CAST(year(created_at) AS INTEGER) AS tahun, CAST(month(created_at) AS INTEGER) AS bulan,
       count(*) AS total
FROM users WHERE role IN ('siswa', 'guru') GROUP BY role, tahun, bulan
""")
def q04y(t):
    return A.monthly_signups(t, by_year=True)


@register("u08_monthly_signups_dense", """
SELECT r.role, m.bulan, coalesce(c.total, 0) AS total
FROM (SELECT CAST(range AS INTEGER) AS bulan FROM range(1, 13)) m
CROSS JOIN (VALUES ('siswa'), ('guru')) r(role)
LEFT JOIN (SELECT role, CAST(month(created_at) AS INTEGER) AS bulan, count(*) AS total
           FROM users WHERE role IN ('siswa', 'guru') GROUP BY role, bulan) c
  ON c.role = r.role AND c.bulan = m.bulan
""")
def u08(t):
    return A.monthly_signups_dense(t)


@register("q05_program_distribution", """
SELECT role, count(*) AS total FROM users WHERE role = 'siswa' GROUP BY role
""")
def q05(t):
    return A.program_distribution(t)


@register("q05_program_distribution_by_jurusan", """
SELECT jurusan, count(*) AS total FROM siswa_details GROUP BY jurusan
""")
def q05j(t):
    return A.program_distribution(t, "jurusan")


@register("u11_program_share", """
SELECT jurusan, count(*) AS total,
       CAST(round(count(*) / (SELECT count(*) FROM siswa_details) * 100) AS INTEGER) AS persen
FROM siswa_details GROUP BY jurusan
""")
def u11(t):
    return A.program_share(t)


@register("q06_daily_usage", f"""
WITH days AS (SELECT date_trunc('day', created_at) AS day, count(*) AS total FROM activity_logs GROUP BY 1)
SELECT CAST(day AS DATE) AS tanggal, total FROM days
WHERE (SELECT count(*) FROM days later WHERE later.day > days.day) < {X.TOP_DAYS}
""")
def q06(t):
    return A.daily_usage(t, X.TOP_DAYS)


@register("q41_latest_verification", """
SELECT u.id AS user_id, u.role,
       CASE WHEN u.role <> 'admin' THEN lv.status END AS latest_status,
       (u.role = 'admin' OR coalesce(lv.status = 'approved', FALSE)) AS login_eligible
FROM users u
LEFT JOIN (SELECT user_id, status,
                  row_number() OVER (PARTITION BY user_id ORDER BY requested_at DESC, id DESC) AS rn
           FROM verifications) lv ON lv.user_id = u.id AND lv.rn = 1
""")
def q41(t):
    return A.latest_verification(t)
