"""Hand-made frames for what the generated tables cannot show (FIXTURES.md 2)."""

import datetime as dt

from pyspark.sql import functions as F

from kelasflow.functions import derived as U
from kelasflow.operators import activity, changes, courses, progress, roster
from kelasflow.sources.catalog import from_rows
from tests.conftest import rows, ts

D = dt.date
AS_OF = D(2024, 3, 10)


def school(spark, **extra):
    base = dict(
        users=[(1, "Budi  Santoso", "budi@x.org", "siswa", None, ts(2024, 1, 5)),
               (2, "Ani", "ANI@x.org", "siswa", None, ts(2024, 2, 5)),
               (3, "Cici", "cici@x.org", "siswa", None, ts(2023, 2, 5)),
               (10, "Guru Satu", "g1@x.org", "guru", None, ts(2024, 1, 1)),
               (11, "Guru Dua", "g2@x.org", "guru", None, ts(2024, 1, 1)),
               (99, "Admin", "admin@x.org", "admin", None, ts(2020, 1, 1))],
        kelas=[(1, "XII A"), (2, "XII B"), (3, "Kosong")],
        siswa_details=[(1, 1, "RPL", "001", 1), (2, 2, "TKJ", "002", 2),
                       (3, 2, "TKJ", "002b", 1)],           # user 2 holds two detail rows
        guru_details=[(1, 10, "Matematika,Fisika", "N1"), (2, 11, None, "N2")],
        guru_kelas=[(1, 1, 1), (2, 1, 2)],
        courses=[(100, "Aljabar", "d", 10, ts(2024, 1, 2), "f"), (101, "Puisi", "d", None, ts(2024, 1, 3), "f")],
        course_kelas=[(1, 100, 1), (2, 100, 2), (3, 100, 1)],
        tugas=[(500, "T1", "d", D(2024, 3, 9), "t", 10, ts(2024, 3, 1)),
               (501, "T2", "d", AS_OF, "t", 10, ts(2024, 3, 1)),
               (502, "T3", "d", D(2024, 3, 13), "t", 10, ts(2024, 3, 1)),
               (503, "T4", "d", D(2024, 3, 14), "t", 11, ts(2024, 3, 1)),
               (504, "T5", "d", D(2024, 3, 14), "t", 11, ts(2024, 3, 1))],
        tugas_kelas=[(500, 1), (500, 2), (501, 1), (502, 3), (503, 2)],
        pengumpulan_tugas=[(1, 500, 1, "http://cdn/x", 0, ts(2024, 3, 2)),      # grade 0
                           (2, 500, 2, "/k/2", None, ts(2024, 3, 3)),
                           (3, 501, None, "/k/3", None, ts(2024, 3, 3)),          # NULL student
                           (4, 502, 1, "/k/4", 80, ts(2024, 3, 3)),
                           (5, 502, 2, "/k/5", 95, ts(2024, 3, 4))],
        verifications=[(1, 1, "rejected", ts(2024, 1, 1)), (2, 1, "approved", ts(2024, 1, 1)),
                       (3, 2, "approved", ts(2024, 1, 1)), (4, 2, "pending", ts(2024, 1, 2))],
        activity_logs=[(1, 1, "login", ts(2024, 3, 10, 8)), (2, 2, "login", ts(2024, 3, 10, 9)),
                       (3, 77, "ghost", ts(2024, 3, 10, 10)), (4, 1, "view", ts(2024, 3, 9, 9))],
        diskusi=[(700, "Halo", "isi", 10, ts(2024, 1, 1))],
        diskusi_kelas=[(1, 700, 1)],
        chat_diskusi=[(1, 700, 1, "hai", ts(2024, 1, 1, 1)), (2, 700, 10, "ya", ts(2024, 1, 1, 2))],
    )
    base.update(extra)
    return from_rows(spark, **base)


def test_progress_counts_multi_class_user_once(spark):
    t = school(spark)
    p = {r.id: r for r in progress.assignment_progress(t).collect()}
    # T1 -> classes 1 and 2; students: user 1 (class 1), user 2 (classes 1 and 2): 2 distinct
    assert p[500].jumlah_siswa == 2 and p[500].jumlah_kumpul == 2 and p[500].kelas == "XII A, XII B"
    assert p[502].jumlah_siswa == 0 and p[502].jumlah_kumpul == 2      # empty class, submissions from anyone
    assert 504 not in p                                                 # no class -> not listed


def test_card_filter_window_ends(spark):
    t = school(spark)
    due = {r.id for r in progress.assignment_progress(t, "deadline", AS_OF, 3).collect()}
    assert due == {501, 502}                       # as_of and as_of+3 in, as_of-1 and as_of+4 out
    done = {r.id for r in progress.assignment_progress(t, "completed", AS_OF).collect()}
    assert done == {500}
    ungraded = {r.id for r in progress.assignment_progress(t, "ungraded", AS_OF).collect()}
    assert ungraded == {500, 501}


def test_not_in_with_null_student_empties_missing_list(spark):
    t = school(spark)
    st = progress.submission_status(t)
    missing = {(r.tugas_id, r.id) for r in st.where("status = 'belum_kumpul'").collect()}
    assert not any(tid == 501 for tid, _ in missing)   # 501 has a NULL-student submission
    assert (503, 2) in missing and (500, 1) not in missing
    done = {(r.tugas_id, r.id) for r in st.where("status = 'sudah_kumpul'").collect()}
    assert (500, 1) in done and (500, 2) in done


def test_stats_count_detail_rows_and_can_go_negative(spark):
    t = school(spark, tugas_kelas=[(500, 1)],
               pengumpulan_tugas=[(1, 500, 3, "a", 70, ts(2024, 3, 1)), (2, 502, 3, "b", None, ts(2024, 3, 1))])
    s = {r.siswa_id: r for r in progress.student_assignment_stats(t).collect()}
    assert s[2].total == 1                      # user 2 has a detail row in class 1
    assert s[3].total == 0 and s[3].completed == 1 and s[3].pending == -2


def test_grade_zero_is_graded_on_server_not_in_ui(spark):
    df = spark.createDataFrame([(0, "f"), (None, "f"), (None, None), (90, "f")], "nilai int, file_kumpul string")
    got = [tuple(r) for r in df.select(U.grade_status("nilai", "file_kumpul"),
                                       U.grade_status("nilai", "file_kumpul", ui_rule=True),
                                       U.grade_text("nilai")).collect()]
    assert got == [("Graded", "Submitted", "0/100"), ("Submitted", "Submitted", "-"),
                   ("Pending", "Pending", "-"), ("Graded", "Graded", "90/100")]


def test_initials_rates_days_links(spark):
    df = spark.createDataFrame([("Budi  Santoso", 0, 0, "http://a", D(2024, 3, 12)),
                                ("ani", 3, 2, "/f", D(2024, 3, 9))],
                               "name string, k int, n int, path string, deadline date")
    got = [tuple(r) for r in df.select(U.initials("name"), U.submission_rate("k", "n"),
                                       U.days_left("deadline", dt.datetime(2024, 3, 10, 12)),
                                       U.absolute_link("path", "https://h"), U.display_date("deadline")).collect()]
    assert got == [("BS", 0, 2, "http://a", "12/3/2024"), ("A", 150, -1, "https://h/f", "9/3/2024")]


def test_search_case_and_wildcards(spark):
    t = school(spark)
    ids = lambda kw: {r.id for r in roster.student_search(t, kw).collect()}
    assert ids("bUdI") == {1}
    assert ids("") == {1, 2, 3}
    assert ids("_") == {1, 2, 3}                # '_' matches any one character
    assert ids("x_org") == {1, 2, 3}            # wildcard inside the keyword
    assert ids("100%") == set()
    assert {r.id for r in roster.student_filter(t, kelas="xii b").collect()} == {2}


def test_teacher_search_narrows_class_list(spark):
    t = school(spark)
    r = {x.id: x.kelas for x in roster.teacher_search(t, "xii b").collect()}
    assert r == {10: "XII B"}
    full = {x.id: x.kelas for x in roster.teacher_roster(t).collect()}
    assert full == {10: "XII A, XII B", 11: None}


def test_latest_verification_tie_break_and_eligibility(spark):
    t = school(spark)
    v = {r.user_id: (r.latest_status, r.login_eligible) for r in activity.latest_verification(t).collect()}
    assert v[1] == ("approved", True)           # equal times: higher id wins
    assert v[2] == ("pending", False)
    assert v[3] == (None, False) and v[99] == (None, True)


def test_recent_activity_drops_unknown_users_and_orders(spark):
    t = school(spark)
    got = [r.action for r in activity.recent_activity(t, 2).collect()]
    assert got == ["login", "login"]
    c = activity.admin_counts(t, AS_OF).first()
    assert (c.total_siswa, c.total_guru, c.total_mapel, c.aktivitas_hari_ini) == (3, 2, 2, 3)


def test_class_sizes_and_teacher_dashboard(spark):
    t = school(spark)
    d = {r.guru_id: (r.total_mapel, r.total_siswa) for r in courses.teacher_dashboard(t).collect()}
    assert d[10] == (1, 3)        # classes 1 (2 detail rows) and 2 (1), each once
    assert d[11] == (0, 0)
    cc = rows(courses.teacher_course_classes(t).select("jurusan", "jumlah_siswa"))
    assert cc == [("XII A", 2), ("XII A", 2), ("XII B", 1)]


def test_find_or_create_classes(spark):
    t = school(spark)
    req = spark.createDataFrame([("  XII C ",), ("",), (None,), ("xii a",), ("XII C",)], "kelas string")
    kelas, resolved = changes.find_or_create_classes(t, req)
    assert rows(kelas.where("id > 3")) == [(4, "XII C")]
    got = sorted(((r.kelas, r.kelas_id) for r in resolved.collect()), key=repr)
    assert got == sorted([("  XII C ", 4), ("", None), (None, None), ("xii a", 1), ("XII C", 4)], key=repr)


def test_bridge_replacement_ignores_unknown_names(spark):
    t = school(spark)
    req = spark.createDataFrame([(1, 100, " XII B , Nope,,XII b")], "request_id long, course_id long, kelas string")
    ch = changes.replace_bridge(t, "course_kelas", req)
    assert rows(ch.tables.course_kelas.select("course_id", "kelas_id")) == [(100, 2)]


def test_first_write_wins_and_replay(spark):
    t = school(spark)
    req = spark.createDataFrame(
        [(10, 503, 1, "a", ts(2024, 3, 5)), (11, 503, 1, "b", ts(2024, 3, 4)), (12, 500, 1, "c", ts(2024, 3, 5))],
        "request_id long, tugas_id long, siswa_id long, file_path string, submitted_at timestamp_ntz")
    ch = changes.submit_first_wins(t, req)
    assert rows(ch.emitted["accepted"].select("request_id")) == [(11,)]
    assert dict(rows(ch.rejects)) == {10: "duplicate_in_batch", 12: "already_submitted"}
    again = changes.submit_first_wins(ch.tables, req)
    assert again.emitted["accepted"].count() == 0 and again.rejects.count() == 3
    assert ch.tables.pengumpulan_tugas.count() == 6


def test_grade_posting_updates_every_row_of_pair(spark):
    t = school(spark, pengumpulan_tugas=[(1, 500, 1, "a", None, ts(2024, 3, 1)),
                                         (2, 500, 1, "b", None, ts(2024, 3, 2))])
    req = spark.createDataFrame([(1, 500, 1, 70), (2, 500, 1, 85), (3, 501, 1, 50)],
                                "request_id long, tugas_id long, siswa_id long, nilai int")
    ch = changes.post_grades(t, req)
    assert {r.nilai for r in ch.tables.pengumpulan_tugas.collect()} == {85}
    assert dict(rows(ch.rejects)) == {1: "superseded", 3: "no_submission"}


def test_delete_teacher_cascades(spark):
    t = school(spark)
    ch = changes.delete_cascade(t, {"users": spark.createDataFrame([(10,)], "id long")})
    n = ch.tables
    assert rows(n.courses.select("id", "created_by")) == [(100, None), (101, None)]
    assert {r.id for r in n.tugas.collect()} == {503, 504}
    assert {r.tugas_id for r in n.tugas_kelas.collect()} == {503}
    assert n.pengumpulan_tugas.count() == 0
    assert n.diskusi.count() == 0 and n.diskusi_kelas.count() == 0 and n.chat_diskusi.count() == 0
    assert n.guru_details.count() == 1 and n.guru_kelas.count() == 0
    assert n.course_kelas.count() == 3           # courses stay (SET NULL), so do their classes


def test_student_create_rejects_known_keys(spark):
    t = school(spark)
    req = spark.createDataFrame(
        [(1, "Dodi", "BUDI@x.org", "009", "RPL", "XII A"), (2, "Eka", "eka@x.org", "001", "RPL", None),
         (3, "Fani", "fani@x.org", "010", "TKJ", " XII Z "), (4, "Fani 2", "FANI@x.org", "011", "TKJ", None)],
        "request_id long, name string, email string, nisn string, jurusan string, kelas string")
    ch = changes.student_create(t, req, dt.datetime(2024, 3, 10))
    assert dict(rows(ch.rejects)) == {1: "email_taken", 2: "nisn_taken", 4: "email_taken_in_batch"}
    new = ch.emitted["users"].first()
    assert (new.id, new.role) == (100, "siswa")
    assert rows(ch.emitted["siswa_details"].select("user_id", "kelas_id")) == [(100, 4)]
    assert ch.emitted["verifications"].first().status == "approved"


def test_register_refuses_admin_and_logs(spark):
    t = school(spark)
    req = spark.createDataFrame([(1, "X", "x@y", "admin"), (2, "Y", "y@y", "guru")],
                                "request_id long, name string, email string, role string")
    ch = changes.register_users(t, req, dt.datetime(2024, 3, 10))
    assert dict(rows(ch.rejects)) == {1: "admin_not_allowed"}
    assert ch.emitted["activity_logs"].first().action == "User registered as guru"
    assert ch.emitted["verifications"].first().status == "pending"


def test_owner_checked_update_keeps_unset_file(spark):
    t = school(spark)
    req = spark.createDataFrame([(1, 500, 10, "Baru", None), (2, 503, 10, "Bukan", None)],
                                "request_id long, id long, owner_id long, judul string, file_path string")
    ch = changes.update_owned(t, "tugas", req)
    r = {x.id: (x.judul, x.file_path) for x in ch.tables.tugas.collect()}
    assert r[500] == ("Baru", "t") and r[503] == ("T4", "t")
    assert dict(rows(ch.rejects)) == {2: "not_owner_or_missing"}


def test_verification_transition_and_message_append(spark):
    t = school(spark)
    req = spark.createDataFrame([(1, 4, "approved"), (2, 4, "pending"), (3, 42, "rejected")],
                                "request_id long, verification_id long, status string")
    ch = changes.verification_transition(t, req, dt.datetime(2024, 3, 10))
    assert dict(rows(ch.rejects)) == {2: "invalid_status", 3: "unknown_verification"}
    assert rows(ch.emitted["activity_logs"].select("id", "user_id", "action")) == [(5, 2, "Verification approved")]
    msg = spark.createDataFrame([(1, 700, 2, "", ts(2024, 1, 2)), (2, 700, 2, "ok", ts(2024, 1, 2)),
                                 (3, 9, 2, "x", ts(2024, 1, 2))],
                                "request_id long, diskusi_id long, user_id long, isi string, created_at timestamp_ntz")
    m = changes.append_messages(t, msg)
    assert dict(rows(m.rejects)) == {1: "blank_message", 3: "unknown_thread"}
    assert rows(m.emitted["chat_diskusi"].select("id", "isi")) == [(3, "ok")]


def test_assign_ids_is_consecutive_and_order_based(spark):
    from kelasflow.functions.ids import assign_ids
    df = spark.range(0, 5000).select((F.col("id") * 7 % 5000).alias("k")).repartition(13)
    out = assign_ids(df, ["k"], F.lit(100)).select("k", "id").collect()
    assert sorted(r.id for r in out) == list(range(101, 5101))
    assert all(r.id == 101 + r.k for r in out)


def test_unique_and_orphan_audits(spark):
    from kelasflow.operators import audit
    t = school(spark, pengumpulan_tugas=[(1, 500, 1, "a", 120, ts(2024, 3, 1)), (2, 500, 1, "b", None, ts(2024, 3, 1)),
                                         (3, 999, 1, "c", None, ts(2024, 3, 1))])
    u = rows(audit.uniqueness(t))
    assert ("pengumpulan_tugas.tugas_id+siswa_id", "500:1", 2) in u and ("siswa_details.user_id", "2", 2) in u
    o = rows(audit.orphans(t))
    assert ("pengumpulan_tugas.tugas_id", "3", 999) in o and ("activity_logs.user_id", "3", 77) in o
    d = dict(rows(audit.domain_rules(t)))
    assert d["pengumpulan_tugas.nilai in 0..100"] == 1 and d["users.role in domain"] == 0


def test_reference_orderings(spark):
    t = school(spark)
    p = [(r.created_by, r.id) for r in progress.assignment_progress(t, ordered=True).collect()]
    assert p == [(10, 500), (10, 501), (10, 502), (11, 503)]   # equal created_at -> id
    sa = [(r.siswa_id, r.deadline) for r in progress.student_assignments(t, ordered=True).collect()]
    assert sa == sorted(sa, key=lambda x: (x[0], -x[1].toordinal()))
    cc = [(r.guru_id, r.jurusan) for r in courses.teacher_course_classes(t, ordered=True).collect()]
    assert cc == [(10, "XII A"), (10, "XII A"), (10, "XII B")]
    pv = [r.id for r in activity.pending_verifications(t, ordered=True).collect()]
    assert pv == [4]
    m = [(r.siswa_id, r.id) for r in courses.student_materials(t, ordered=True).collect()]
    assert m == sorted(m) and "created_at" not in courses.student_materials(t).columns
    from kelasflow.operators import forum
    assert [r.id for r in forum.thread_messages(t).collect()] == [1, 2]
    assert [r.id for r in forum.teacher_threads(t, ordered=True).collect()] == [700]


def test_keyed_variants_narrow_to_the_given_keys(spark):
    from kelasflow.operators import forum
    t = school(spark)
    k10 = spark.createDataFrame([(10,)], "id long")
    k2 = spark.createDataFrame([(2,)], "id long")
    assert {r.created_by for r in progress.assignment_progress(t, teacher_ids=k10).collect()} == {10}
    assert {r.tugas_id for r in progress.submission_status(t, teacher_ids=k10).collect()} <= {500, 501, 502}
    assert {r.siswa_id for r in progress.student_assignments(t, student_ids=k2).collect()} == {2}
    assert {r.siswa_id for r in progress.student_assignment_stats(t, student_ids=k2).collect()} == {2}
    assert {r.siswa_id for r in courses.student_materials(t, student_ids=k2).collect()} == {2}
    assert {r.siswa_id for r in forum.student_threads(t, student_ids=k2).collect()} == {2}
    assert {r.id for r in roster.student_roster(t, k2).collect()} == {2}
    assert {r.id for r in roster.teacher_roster(t, k10).collect()} == {10}
    assert {r.guru_id for r in courses.teacher_dashboard(t, k10).collect()} == {10}
    assert {r.id for r in forum.thread_detail(t, spark.createDataFrame([(700,)], "id long")).collect()} == {700}
