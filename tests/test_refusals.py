"""Refusals, ids and partial results: the faults that small tables cannot show."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from kelasflow import session
from kelasflow.functions.ids import assign_ids
from kelasflow.operators import audit, changes
from kelasflow.streaming import first_wins, streams
from tests.conftest import rows, ts
from tests.test_edge_cases import school

SAVE = "request_id long, user_id long, name string, email string, nisn string, jurusan string, kelas string"
TEACH = "request_id long, user_id long, name string, email string, nip string, mapel string, kelas string"


def outcomes(ch):
    ok = {r.request_id: "accepted" for r in ch.emitted["accepted"].collect()}
    return {**ok, **dict(rows(ch.rejects))}


@pytest.mark.parametrize("n,coalesce", [(300_000, "true"), (300_000, "false"), (3_000_000, "true")])
def test_assign_ids_over_many_partitions(spark, n, coalesce):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesce)
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "1m")
    try:
        df = spark.range(n).select((F.col("id") * 7919 % n).alias("k"),
                                   F.expr("repeat('x', cast(pmod(id * 31, 60) as int))").alias("payload"))
        out = assign_ids(df.repartition(9), ["k"], F.lit(100))
        off = (F.col("id") != F.col("k") + 101).cast("int")
        assert out.agg(F.count("*"), F.count_distinct("id"), F.sum(off), F.sum(F.length("payload"))).first()[:3] == (n, n, 0)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")


def test_streams_wait_and_raise(spark, tmp_path):
    src = streams.stage(spark.range(10).withColumnRenamed("id", "n"), str(tmp_path / "in"))

    def fails(batch, batch_id):
        raise ValueError("sink is gone")
    q = (streams.source(spark, src, "n long").writeStream.option("checkpointLocation", str(tmp_path / "c"))
         .foreachBatch(fails))
    with pytest.raises(Exception, match="sink is gone"):
        streams.run(q)


def test_checkpoint_folder_must_be_named_on_a_cluster(monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Conf:
        def get(self, key, default=None):
            return default

    class Session:
        sparkContext, conf = Context(), Conf()
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.checkpoint_root(Session())


def test_a_refused_save_does_not_hide_the_valid_one(spark):
    req = [(1, 1, "Budi B", None, "S9", "RPL", "XII B"), (2, 1, "Budi C", None, "002", "RPL", None),
           (3, 98, "Tidak", None, "S1", "RPL", None), (4, 2, "Ani", "budi@X.org", "S3", "RPL", None),
           (5, 3, "Cici", "new@x.org", "s9", "RPL", None), (6, 3, "Cici", "new@x.org", "S8", "TKJ", " XII c"),
           (7, 2, "Ani", "NEW@x.org", "S7", "TKJ", None)]
    t = school(spark, siswa_details=[(1, 1, "RPL", "001", 1), (2, 2, "TKJ", "002", 2)])
    ch = changes.student_upsert(t, spark.createDataFrame(req, SAVE))
    assert outcomes(ch) == {1: "accepted", 2: "nisn_taken", 3: "unknown_user", 4: "email_taken",
                            5: "nisn_taken_in_batch", 6: "accepted", 7: "email_taken_in_batch"}
    n = ch.tables
    assert rows(n.siswa_details.select("user_id", "nisn", "kelas_id")) == [(1, "S9", 2), (2, "002", 2), (3, "S8", 4)]
    assert {r.id: (r.name, r.email) for r in n.users.where("id < 10").collect()} == {
        1: ("Budi B", "budi@x.org"), 2: ("Ani", "ANI@x.org"), 3: ("Cici", "new@x.org")}
    assert audit.uniqueness(n.replace(verifications=t.verifications)).where("key_name LIKE 'siswa%'").count() == 0


def test_teachers_do_not_share_mail_or_number(spark):
    req = [(1, 10, "Satu", "new@x", "N9", "A", None), (2, 11, "Dua", "NEW@x", "N8", "B", "XII A"),
           (3, 11, "Dua", "d@x", "n9", "B", None), (4, 11, "Dua", "d@x", "N7", "B", "XII A, Kosong, ?"),
           (5, 77, "Tiada", "t@x", "N6", "B", None), (6, 10, None, None, "N2", "C", None)]
    ch = changes.teacher_upsert(school(spark), spark.createDataFrame(req, TEACH))
    # request 4 gives up N2, so request 6 may have it; it leaves the e-mail of request 1 as it is
    assert outcomes(ch) == {1: "superseded", 2: "email_taken_in_batch", 3: "nip_taken_in_batch", 4: "accepted",
                            5: "unknown_user", 6: "accepted"}
    assert rows(ch.tables.guru_details.select("user_id", "mapel", "nip")) == [(10, "C", "N2"), (11, "B", "N7")]
    assert {r.id: r.email for r in ch.tables.users.collect()}[10] == "new@x"
    assert rows(ch.tables.guru_kelas.select("guru_id", "kelas_id")) == [(1, 1), (1, 2), (2, 1), (2, 3)]
    assert audit.uniqueness(ch.tables).where("key_name IN ('users.email', 'guru_details.nip')").count() == 0


def test_parents_must_exist(spark):
    t = school(spark)
    ch = changes.replace_bridge(t, "diskusi_kelas", spark.createDataFrame(
        [(1, 777, "XII A"), (2, 700, "XII B")], "request_id long, diskusi_id long, kelas string"))
    assert dict(rows(ch.rejects)) == {1: "unknown_parent"}
    assert rows(ch.tables.diskusi_kelas.select("diskusi_id", "kelas_id")) == [(700, 2)]
    sub = "request_id long, tugas_id long, siswa_id long, file_path string, submitted_at timestamp_ntz"
    ch = changes.submit_first_wins(t, spark.createDataFrame(
        [(1, 503, 1, "a", ts(2024, 3, 5)), (2, 999, 1, "b", ts(2024, 3, 5)), (3, 503, 99_999, "c", ts(2024, 3, 5))], sub))
    assert outcomes(ch) == {1: "accepted", 2: "unknown_assignment", 3: "unknown_student"}
    ids = [r.id for r in ch.tables.pengumpulan_tugas.collect()]
    assert sorted(ids) == [1, 2, 3, 4, 5, 6]        # request 1 does not take id 1
    logs = changes.log_sign_ins(t, spark.createDataFrame([(1, 1, ts(2024, 3, 1)), (2, 555, ts(2024, 3, 1))],
                                                        "request_id long, user_id long, created_at timestamp_ntz"))
    assert dict(rows(logs.rejects)) == {2: "unknown_user"} and logs.emitted["activity_logs"].count() == 1


def test_roles_and_course_classes(spark):
    t = school(spark)
    ch = changes.register_users(t, spark.createDataFrame(
        [(1, "A", "a@y", None), (2, "B", "b@y", "kepala"), (3, "C", "c@y", "siswa")],
        "request_id long, name string, email string, role string"), dt.datetime(2024, 3, 10))
    assert outcomes(ch) == {1: "unknown_role", 2: "unknown_role", 3: "accepted"}
    req = spark.createDataFrame([(1, "Baru", 10, ["tidak ada"]), (2, "Kosong", 10, [" "]), (3, "X", 4242, ["XII A"]),
                                 (4, "Y", None, ["xii a", "XII A "])],
                                "request_id long, name string, created_by long, kelas array<string>")
    ch = changes.create_with_classes(t, "courses", req, dt.datetime(2024, 3, 10))
    assert outcomes(ch) == {1: "accepted", 2: "no_class", 3: "unknown_author", 4: "accepted"}
    assert rows(ch.emitted["links"].select("course_id", "kelas_id")) == [(103, 1)]


def test_edit_and_delete_belong_to_the_owner(spark):
    t = school(spark)
    req = spark.createDataFrame([(1, 500, 10, "Baru", "XII B"), (2, 500, 11, "Curi", "Kosong"), (3, 503, 11, None, None)],
                                "request_id long, id long, owner_id long, judul string, kelas string")
    ch = changes.update_owned(t, "tugas", req)
    assert outcomes(ch) == {1: "accepted", 2: "not_owner_or_missing", 3: "accepted"}
    assert {r.id: r.judul for r in ch.tables.tugas.collect()}[500] == "Baru"
    assert rows(ch.tables.tugas_kelas.where("tugas_id IN (500, 503)")) == [(500, 2), (503, 2)]
    gone = changes.delete_owned(t, "tugas", spark.createDataFrame([(1, 500, 10), (2, 501, 11), (3, 9, 10)],
                                                                  "request_id long, id long, owner_id long"))
    assert outcomes(gone) == {1: "accepted", 2: "not_owner_or_missing", 3: "not_owner_or_missing"}
    n = gone.tables
    assert {r.id for r in n.tugas.collect()} == {501, 502, 503, 504}
    assert n.pengumpulan_tugas.where("tugas_id = 500").count() == 0 and n.pengumpulan_tugas.count() == 3


def test_first_wins_stream_stores_what_it_accepts(spark, tmp_path):
    t = school(spark)
    sub = "request_id long, tugas_id long, siswa_id long, file_path string, submitted_at timestamp_ntz"
    req = [(i, 503 + i % 2, 1 + i % 3, f"f{i}", ts(2024, 3, 5)) for i in range(1, 30)] + [(1000, 500, 1, "z", ts(2024, 3, 5))]
    src = streams.stage(spark.createDataFrame(req, sub), str(tmp_path / "in"), 5)
    out = first_wins.run_first_wins(spark, t, src, str(tmp_path / "snap"), str(tmp_path / "out"), str(tmp_path / "c"),
                                    spark.createDataFrame([], sub).schema, 1)
    got = dict(rows(out))
    assert len(got) == 30 and sum(v == "accepted" for v in got.values()) == 6
    assert got[1000] == "already_submitted"
    stored = first_wins.stored_submissions(spark, str(tmp_path / "snap"), t.pengumpulan_tugas.schema)
    assert stored.count() == 5 + 6 and stored.select("id").distinct().count() == 11
    assert stored.where("tugas_id >= 503").select("tugas_id", "siswa_id").distinct().count() == 6
