"""Registered streaming jobs (S01-S05).  Each lands its fixture-derived
input rows in a parquet folder, drains it with ``availableNow`` and returns
what the sink holds; the oracle is the batch twin's SQL."""

from pyspark.sql import functions as F

from kelasflow.functions.shared import materialize
from kelasflow.plans import reg_changes as RC
from kelasflow.plans.reg_progress import _PROGRESS_SQL
from kelasflow.plans.registry import register, register_twin
from kelasflow.streaming import first_wins, grades, live_progress
from kelasflow.streaming import streams as S


# Every stream reads its input in several micro-batches.
FILES, FILES_PER_BATCH = 6, 2


def _dirs(t, name):
    base = S.scratch(t.spark, name)
    return {k: f"{base}/{k}" for k in ("in", "out", "ckpt", "snap")}


# The files arrive in no order of time: most rows are late and correct closed days.
@register("s01_daily_activity_stream", """
SELECT CAST(created_at AS DATE) AS tanggal, count(*) AS total FROM activity_logs GROUP BY 1
""")
def s01(t):
    d = _dirs(t, "s01")
    S.stage(t.activity_logs, d["in"], FILES)
    return S.run_daily_counts(t.spark, d["in"], d["out"], d["ckpt"], t.activity_logs.schema,
                              FILES_PER_BATCH).select("tanggal", "total")


@register("s02_message_feed_stream", """
SELECT c.id, c.diskusi_id, c.user_id, c.isi, c.created_at, u.name, u.role
FROM chat_diskusi c JOIN users u ON u.id = c.user_id WHERE coalesce(c.isi, '') <> ''
""")
def s02(t):
    d = _dirs(t, "s02")
    S.stage(t.chat_diskusi, d["in"], FILES)
    return S.run_message_feed(t.spark, t, d["in"], d["out"], d["ckpt"], t.chat_diskusi.schema, FILES_PER_BATCH)


def _first_wins(t, *keys):
    d = _dirs(t, "s03")
    snap, reqs = RC._submit_split(t)
    S.stage(reqs, d["in"], FILES, *keys)
    out = first_wins.run_first_wins(t.spark, snap, d["in"], d["snap"], d["out"], d["ckpt"], reqs.schema, FILES_PER_BATCH)
    return out, first_wins.stored_submissions(t.spark, d["snap"], t.pengumpulan_tugas.schema)


# The requests of an assignment arrive together: outcomes are those of the batch job.
@register_twin("s03_submit_first_wins_stream", "w10_submit_first_wins")
def s03(t):
    return _first_wins(t, "tugas_id")[0]


# The requests of a pair arrive in different micro-batches: one of them is stored.
@register("s03_stored_submissions", f"""
SELECT tugas_id, siswa_id, count(*) AS n_rows, count(*) AS n_ids FROM existing GROUP BY ALL
UNION ALL SELECT tugas_id, siswa_id, 1, 1 FROM req ANTI JOIN existing USING (tugas_id, siswa_id) GROUP BY ALL
""", ctes=f"""
existing AS (SELECT * FROM pengumpulan_tugas WHERE dikumpulkan_at < TIMESTAMP '{RC.SUBMIT_CUTOFF}'),
req AS (SELECT tugas_id, siswa_id FROM pengumpulan_tugas WHERE dikumpulkan_at >= TIMESTAMP '{RC.SUBMIT_CUTOFF}')
""")
def s03_stored(t):
    stored = _first_wins(t)[1]
    ids = stored.where("id IS NOT NULL").groupBy("id").agg(F.count(F.lit(1)).alias("_n"))
    again = materialize(ids.where("_n > 1"), "ids-given-twice")         # they do not count
    mine = F.when(F.col("id").isNotNull() & F.col("_n").isNull(), 1)
    return (stored.join(again, "id", "left").groupBy("tugas_id", "siswa_id")
            .agg(F.count(F.lit(1)).alias("n_rows"), F.count(mine).alias("n_ids")))


@register("s04_live_assignment_progress", """
SELECT id, jumlah_kumpul, jumlah_siswa FROM p
""", ctes=f"p AS ({_PROGRESS_SQL.format(cond='')})")
def s04(t):
    d = _dirs(t, "s04")
    subs = t.pengumpulan_tugas.select("id", "tugas_id")
    S.stage(subs, d["in"], FILES)
    return S.run_live_progress(t.spark, t, d["in"], d["out"], d["ckpt"], subs.schema, FILES_PER_BATCH)


# A fifth of the students leave their class for the next one, a seventh join a
# further class, while the submissions come in.
_MOVES = """
moved AS (
  SELECT user_id, kelas_id FROM siswa_details WHERE kelas_id IS NOT NULL AND user_id % 5 <> 2
  UNION SELECT user_id, kelas_id + 1 FROM siswa_details WHERE kelas_id IS NOT NULL AND (user_id % 5 = 2 OR user_id % 7 = 3))
"""


@register("s04_live_progress_with_moves", """
SELECT id, jumlah_kumpul, jumlah_siswa FROM p
""", ctes=_MOVES + f", p AS ({_PROGRESS_SQL.format(cond='').replace('siswa_details', 'moved')})")
def s04_moves(t):
    d = _dirs(t, "s04m")
    subs = t.pengumpulan_tugas.select("id", "tugas_id")
    S.stage(subs, d["in"], FILES)
    own = t.siswa_details.where("kelas_id IS NOT NULL").select("user_id", "kelas_id")
    joins = own.where("user_id % 5 = 2 OR user_id % 7 = 3").withColumn("kelas_id", F.col("kelas_id") + 1)
    moves = (joins.withColumn("delta", F.lit(1)).unionByName(own.where("user_id % 5 = 2").withColumn("delta", F.lit(-1))))
    S.stage(moves, d["snap"], FILES)
    return live_progress.run_progress(t.spark, t, d["in"], d["snap"], d["out"], d["ckpt"], subs.schema, FILES_PER_BATCH)


@register_twin("s05_grade_requests_stream", "w11_post_grades")
def s05(t):
    d = _dirs(t, "s05")
    reqs = RC._grade_requests(t)
    S.stage(reqs, d["in"], FILES, "tugas_id")      # a pair's requests arrive together
    snap = grades.run_grade_requests(t.spark, t, d["in"], d["snap"], d["ckpt"], reqs.schema, FILES_PER_BATCH,
                                     compact_every=2)
    return snap.select("id", "tugas_id", "siswa_id", "nilai")
