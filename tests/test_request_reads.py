"""How often the change jobs and the live counts go over their requests."""

from kelasflow.operators import changes
from kelasflow.sources.catalog import from_rows
from kelasflow.streaming import live_progress
from tests.conftest import ts


def counted(spark, rows, schema):
    """A frame whose rows are counted whenever they are made."""
    read = spark.sparkContext.accumulator(0)

    def seen(row):
        read.add(1)
        return row
    return spark.createDataFrame(spark.sparkContext.parallelize(rows, 2).map(seen), schema), read


def school(spark):
    return from_rows(
        spark, users=[(i, f"U{i}", f"u{i}@x", "siswa", None, ts(2024, 1, 1)) for i in range(1, 60)],
        kelas=[(1, "K1"), (2, "K2")], siswa_details=[(i, i, "J", f"n{i}", 1) for i in range(1, 41)],
        tugas=[(i, f"T{i}", "d", None, "f", 1, ts(2024, 1, 1)) for i in (100, 101, 102)],
        tugas_kelas=[(100, 1), (101, 2), (102, 1), (102, 2)])


def test_submissions_are_read_once(spark):
    req, read = counted(spark, [(i, 100 + i % 4, i % 7, "f", ts(2024, 2, 1)) for i in range(20)],
                        "request_id long, tugas_id long, siswa_id long, file_path string, submitted_at timestamp_ntz")
    ch = changes.submit_first_wins(school(spark), req)
    assert ch.emitted["accepted"].count() + ch.rejects.count() == 20
    assert read.value == 20


def test_edits_are_read_for_their_owners_and_for_the_last_ones(spark):
    req, read = counted(spark, [(i, 100 + i % 3, i % 2, f"J{i}", "K2") for i in range(20)],
                        "request_id long, id long, owner_id long, judul string, kelas string")
    ch = changes.update_owned(school(spark), "tugas", req)
    assert {r.id: r.judul for r in ch.tables.tugas.collect()} == {100: "J15", 101: "J19", 102: "J17"}
    assert sorted(tuple(r) for r in ch.tables.tugas_kelas.collect()) == [(100, 2), (101, 2), (102, 2)]
    assert read.value <= 40


def test_students_of_the_same_classes_are_expanded_once(spark, monkeypatch, tmp_path):
    sets = []
    real = live_progress.materialize
    monkeypatch.setattr(live_progress, "materialize", lambda df, name: sets.append(df.count()) or real(df, name))
    t = school(spark)
    live_progress.start_progress(t, str(tmp_path))
    moves = [("move", None, i, k, d) for i in range(1, 41) for k, d in ((1, -1), (2, 1)) if d > 0 or i > 10]
    live_progress.add_batch(t, str(tmp_path), spark.createDataFrame(
        moves, "kind string, tugas_id long, user_id long, kelas_id int, delta int"), 0)
    assert sets == [4]          # {1} left, {2} new, {1, 2} new with two classes
    got = {r.id: r.jumlah_siswa for r in live_progress.progress_now(spark, str(tmp_path)).collect()}
    assert got == {100: 10, 101: 40, 102: 40}
