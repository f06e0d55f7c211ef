"""Streams over several micro-batches equal their batch twins (or follow
arrival order where that is the rule)."""

import datetime as dt
import random
import time

import pytest
from pyspark.sql import functions as F

from kelasflow.operators import activity
from kelasflow.operators import changes as W
from kelasflow.sources.catalog import from_rows
from kelasflow.streaming import first_wins, grades, live_progress
from kelasflow.streaming import streams as S
from tests.conftest import rows, ts
from tests.test_edge_cases import school


def land(spark, frames, path):
    """Land each frame as its own file, oldest first (one micro-batch each)."""
    for i, df in enumerate(frames):
        df.coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1)          # distinct modification times keep arrival order


def test_daily_activity_multi_batch_equals_batch(spark):
    logs = [(i, 1, "x", ts(2024, 1, 1 + i // 5, i % 24)) for i in range(30)]
    t = from_rows(spark, activity_logs=logs)
    base = S.scratch(spark, "t-s01")
    chunks = [t.activity_logs.where((F.col("id") >= a) & (F.col("id") < a + 10)) for a in (0, 10, 20)]
    land(spark, chunks, f"{base}/in")
    got = S.run_daily_activity(spark, f"{base}/in", f"{base}/out", f"{base}/ck", t.activity_logs.schema, max_files=1)
    want = activity.daily_usage(t, 100)
    assert rows(got) == rows(want)
    assert spark.read.parquet(f"{base}/out").select("_batch").distinct().count() == 3


def test_first_wins_across_batches_follows_arrival(spark):
    t = school(spark)
    schema = "request_id long, tugas_id long, siswa_id long, file_path string, submitted_at timestamp_ntz"
    b1 = spark.createDataFrame([(10, 503, 1, "a", ts(2024, 3, 5))], schema)
    b2 = spark.createDataFrame([(11, 503, 1, "b", ts(2024, 3, 4)), (12, 504, 2, "c", ts(2024, 3, 4)),
                                (13, 504, 2, "d", ts(2024, 3, 5))], schema)
    base = S.scratch(spark, "t-s03")
    land(spark, [b1, b2], f"{base}/in")
    out = first_wins.run_first_wins(spark, t, f"{base}/in", f"{base}/snap", f"{base}/out", f"{base}/ck", b1.schema,
                           max_files=1)
    assert dict(rows(out)) == {10: "accepted", 11: "already_submitted", 12: "accepted", 13: "duplicate_in_batch"}


def test_grade_stream_later_batch_wins(spark):
    t = school(spark)
    schema = "request_id long, tugas_id long, siswa_id long, nilai int"
    b1 = spark.createDataFrame([(1, 500, 2, 60)], schema)
    b2 = spark.createDataFrame([(2, 500, 2, 75), (3, 502, 1, 88)], schema)
    base = S.scratch(spark, "t-s05")
    land(spark, [b1, b2], f"{base}/in")
    snap = grades.run_grade_requests(spark, t, f"{base}/in", f"{base}/snap", f"{base}/ck", b1.schema, max_files=1)
    g = {r.id: r.nilai for r in snap.collect()}
    assert g[2] == 75 and g[4] == 88 and g[1] == 0


def test_message_feed_drops_blank_and_joins_sender(spark):
    t = school(spark)
    schema = t.chat_diskusi.schema
    b1 = spark.createDataFrame([(5, 700, 2, "", ts(2024, 1, 3)), (6, 700, 10, "jawab", ts(2024, 1, 3))], schema)
    base = S.scratch(spark, "t-s02")
    land(spark, [b1], f"{base}/in")
    out = S.run_message_feed(spark, t, f"{base}/in", f"{base}/out", f"{base}/ck", schema)
    assert rows(out.select("id", "name", "role")) == [(6, "Guru Satu", "guru")]


def test_first_wins_within_bound_drops_repeats(spark):
    schema = "request_id long, tugas_id long, siswa_id long, file_path string, submitted_at timestamp_ntz"
    b1 = spark.createDataFrame([(1, 500, 1, "a", ts(2024, 3, 1)), (2, 500, 2, "b", ts(2024, 3, 1))], schema)
    b2 = spark.createDataFrame([(3, 500, 1, "c", ts(2024, 3, 2)), (4, 501, 1, "d", ts(2024, 3, 2))], schema)
    base = S.scratch(spark, "t-s03b")
    land(spark, [b1, b2], f"{base}/in")
    out = S.run_first_wins_within(spark, f"{base}/in", f"{base}/out", f"{base}/ck", b1.schema, max_files=1)
    assert sorted(r.request_id for r in out.collect()) == [1, 2, 4]


def test_daily_activity_drops_rows_behind_the_watermark(spark):
    schema = from_rows(spark).activity_logs.schema
    b1 = spark.createDataFrame([(1, 1, "x", ts(2024, 1, 1, 9)), (2, 1, "x", ts(2024, 1, 5, 9))], schema)
    b2 = spark.createDataFrame([(3, 1, "x", ts(2024, 1, 5, 10))], schema)     # moves nothing
    b3 = spark.createDataFrame([(4, 1, "x", ts(2024, 1, 1, 10)),              # > 1 day late: dropped
                                (5, 1, "x", ts(2024, 1, 4, 23))], schema)     # within lateness: kept
    base = S.scratch(spark, "t-s01-late")
    land(spark, [b1, b2, b3], f"{base}/in")
    got = dict(rows(S.run_daily_activity(spark, f"{base}/in", f"{base}/out", f"{base}/ck", schema, max_files=1)))
    assert got == {dt.date(2024, 1, 1): 1, dt.date(2024, 1, 4): 1, dt.date(2024, 1, 5): 2}


def files(spark, path, rows, schema, n):
    """``rows`` as ``n`` files, in this order."""
    for i in range(n):
        spark.createDataFrame(rows[i::n], schema).coalesce(1).write.mode("append").parquet(path)


def test_files_in_no_order_over_120_days_lose_no_row(spark):
    rnd = random.Random(4)
    logs = [(i, 1, "x", ts(2024, 1, 1) + dt.timedelta(days=rnd.randrange(120), hours=rnd.randrange(24))) for i in range(300)]
    t = from_rows(spark, activity_logs=logs)
    base = S.scratch(spark, "t-s01-any")
    files(spark, f"{base}/in", logs, t.activity_logs.schema, 5)
    got = S.run_daily_counts(spark, f"{base}/in", f"{base}/out", f"{base}/ck", t.activity_logs.schema, 1, "2 days")
    assert rows(got.select("tanggal", "total")) == rows(activity.daily_usage(t, 1000))
    late = spark.read.parquet(f"{base}/out/late")
    assert got.agg(F.sum("late")).first()[0] == late.count() > 0
    newest = {}                         # a late row lies behind the newest of the batches before its own
    for b, at in spark.read.parquet(f"{base}/out/days").select("_batch", "newest").collect():
        newest[b] = max(at, newest.get(b, at))
    for r in late.collect():
        assert r.created_at < max(v for b, v in newest.items() if b < r._batch) - dt.timedelta(days=2)


def submissions(rnd, n, first=0):
    return [(first + i, rnd.choice([500, 501, 502, 503, 999]), rnd.choice([1, 2, 3, 4, 77]), f"f{i}",
             ts(2024, 3, 1) + dt.timedelta(minutes=rnd.randrange(9))) for i in range(n)]


def test_first_wins_over_many_batches_and_a_restart_equals_w10(spark):
    t = school(spark)
    schema = "request_id long, tugas_id long, siswa_id long, file_path string, submitted_at timestamp_ntz"
    rnd = random.Random(6)
    base = S.scratch(spark, "t-s03-many")
    batches = [submissions(rnd, 2, 100 + 10 * i) for i in range(6)]
    args = (f"{base}/in", f"{base}/snap", f"{base}/out", f"{base}/ck")
    want, now = {}, t
    for i, batch in enumerate(batches):
        req = spark.createDataFrame(batch, schema)
        ch = W.submit_first_wins(now, req)
        want |= {r.request_id: r.reason for r in ch.rejects.collect()}
        want |= {r.request_id: "accepted" for r in ch.emitted["accepted"].collect()}
        now = t.replace(pengumpulan_tugas=spark.createDataFrame(
            ch.tables.pengumpulan_tugas.collect(), t.pengumpulan_tugas.schema))
        req.coalesce(1).write.mode("append").parquet(f"{base}/in")
        if i in (2, 5):                 # the stream stops and starts again in between
            got = first_wins.run_first_wins(spark, t, *args, req.schema, max_files=1)
    assert {r.request_id: r.outcome for r in got.collect()} == want
    stored = first_wins.stored_submissions(spark, args[1], t.pengumpulan_tugas.schema)
    assert rows(stored.select("id", "tugas_id", "siswa_id")) == rows(now.pengumpulan_tugas.select("id", "tugas_id", "siswa_id"))


REQUESTS = "request_id long, tugas_id long, siswa_id long, file_path string, submitted_at timestamp_ntz"


def test_first_wins_sends_only_pairs_through_the_state(spark):
    """Of a micro-batch the stream writes its new pairs and the names of its
    files: no request goes through a join before the state or is written twice."""
    t = school(spark)
    base = S.scratch(spark, "t-s03-narrow")
    reqs = [(i, 500 + i % 5, 1 + i % 3, f"f{i}", ts(2024, 3, 5, i % 24)) for i in range(40)]
    files(spark, f"{base}/in", reqs, REQUESTS, 4)
    first_wins.run_first_wins(spark, t, f"{base}/in", f"{base}/snap", f"{base}/out", f"{base}/ck",
                              spark.createDataFrame([], REQUESTS).schema, max_files=2)
    written = spark.read.parquet(f"{base}/out-rows")
    assert not {"request_id", "file_path", "submitted_at"} & set(written.columns)
    named = [r.file for r in written.where("kind = 'file'").collect()]
    assert len(named) == len(set(named)) == 4
    assert written.where("kind = 'new'").count() <= t.pengumpulan_tugas.count() + 15


def test_a_refused_pair_is_free_when_its_assignment_comes(spark):
    t = school(spark)
    stored = t.pengumpulan_tugas.collect() + [(90, 999, 2, "x", None, ts(2024, 3, 1))]      # of an assignment not there
    t = t.replace(pengumpulan_tugas=spark.createDataFrame(stored, t.pengumpulan_tugas.schema))
    late = t.tugas.limit(1).withColumn("id", F.lit(999).cast("bigint"))
    base = S.scratch(spark, "t-s03-refused")
    args = (f"{base}/in", f"{base}/snap", f"{base}/out", f"{base}/ck", spark.createDataFrame([], REQUESTS).schema)
    runs = [(t, [[(100, 999, 1, "a", ts(2024, 3, 5)), (101, 999, 2, "b", ts(2024, 3, 5)), (102, None, 1, "c", ts(2024, 3, 5))]]),
            (t.replace(tugas=t.tugas.unionByName(late)),
             [[(103, 999, 1, "d", ts(2024, 3, 7)), (104, 999, 1, "e", ts(2024, 3, 6)), (105, 999, 2, "f", ts(2024, 3, 6))],
              [(106, 999, 1, "g", ts(2024, 3, 1))]])]
    for tables, batches in runs:
        land(spark, [spark.createDataFrame(b, REQUESTS) for b in batches], args[0])
        got = first_wins.run_first_wins(spark, tables, *args, max_files=1)
    assert dict(rows(got)) == {100: "unknown_assignment", 101: "unknown_assignment", 102: "unknown_assignment",
                               103: "duplicate_in_batch", 104: "accepted", 105: "already_submitted",
                               106: "already_submitted"}


@pytest.mark.parametrize("dies_in", ["publish", "write"])
def test_grades_survive_a_run_that_dies_while_it_compacts(spark, monkeypatch, dies_in):
    t = school(spark)
    schema = "request_id long, tugas_id long, siswa_id long, nilai int"
    base = S.scratch(spark, "t-s05-dies")
    reqs = [(1, 500, 2, 60), (2, 502, 1, 70), (3, 500, 2, None), (4, 999, 1, 5), (5, 502, 1, 88), (6, 500, 1, 11)]
    for r in reqs:
        spark.createDataFrame([r], schema).coalesce(1).write.mode("append").parquet(f"{base}/in")
        time.sleep(1.1)
    args = (f"{base}/in", f"{base}/store", f"{base}/ck", spark.createDataFrame([], schema).schema)

    def dies(*_):
        raise OSError("lost")
    real = grades.publish
    grades.start_store(t, args[1])
    monkeypatch.setattr(grades, "publish" if dies_in == "publish" else "compact", dies)
    with pytest.raises(Exception, match="lost"):
        grades.run_grade_requests(spark, t, *args, max_files=1, compact_every=2)
    got = {r.id: r.nilai for r in grades.stored_grades(spark, args[1], t.pengumpulan_tugas.schema).collect()}
    assert got[2] == 60 and len(got) == t.pengumpulan_tugas.count()         # what came before is there
    monkeypatch.undo()
    assert grades.publish is real
    got = grades.run_grade_requests(spark, t, *args, max_files=1, compact_every=2)
    want = W.post_grades(t, spark.createDataFrame(reqs, schema)).tables.pengumpulan_tugas
    assert rows(got.select("id", "nilai")) == rows(want.select("id", "nilai"))
    assert grades.published(spark, args[1])[0] >= 1


def test_progress_follows_students_who_change_class(spark):
    """After each micro-batch the counts are those of the batch query."""
    from kelasflow.operators import progress
    t = school(spark)
    base = S.scratch(spark, "t-s04-moves")
    subs = t.pengumpulan_tugas.select("id", "tugas_id")
    # 3 joins XII A; 1 moves to XII B; 2, in both, leaves XII A; 1 leaves XII B and 3 joins it, too
    batches = [[(3, 1, 1)], [(1, 1, -1), (1, 2, 1)], [(2, 1, -1)], [(1, 2, -1), (3, 2, 1), (3, 9, 1)]]
    member, seen = {(1, 1), (2, 1), (2, 2)}, []
    for i, moves in enumerate(batches):
        spark.createDataFrame(moves, live_progress.MOVES).coalesce(1).write.mode("append").parquet(f"{base}/moves")
        some = subs.where(F.col("id") % 4 == i)
        some.coalesce(1).write.mode("append").parquet(f"{base}/in")
        got = live_progress.run_progress(spark, t, f"{base}/in", f"{base}/moves", f"{base}/out", f"{base}/ck", subs.schema)
        for user, kelas, delta in moves:
            (member.add if delta > 0 else member.remove)((user, kelas))
        seen += [r.id for r in some.collect()]
        now = t.replace(pengumpulan_tugas=t.pengumpulan_tugas.where(F.col("id").isin(seen)),
                        siswa_details=spark.createDataFrame([(k, u, "J", None, c) for k, (u, c) in enumerate(sorted(member))],
                                                            t.siswa_details.schema))
        assert rows(got) == rows(progress.assignment_progress(now).select("id", "jumlah_kumpul", "jumlah_siswa"))
