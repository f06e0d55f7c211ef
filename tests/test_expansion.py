"""Joins on a key that both sides repeat, with a key that makes much of the output."""

from pyspark.sql import functions as F

from kelasflow.functions import expansion
from kelasflow.operators import courses, forum, progress
from kelasflow.sources.fixtures import fixture_tables
from tests.conftest import SF001


def school(spark):
    """30,000 tasks, a third of them in class 0, and 20 students in each of 300 classes."""
    tasks = spark.range(30_000).select(F.col("id").alias("task"), F.when(F.col("id") % 3 == 0, 0).otherwise(
        F.col("id") % 299 + 1).alias("k"))
    people = spark.range(6_000).select(F.col("id").alias("person"), (F.col("id") % 300).alias("k"))
    return tasks, people


def test_the_same_rows_as_a_plain_join(spark, monkeypatch):
    tasks, people = school(spark)
    odd = spark.createDataFrame([(1, None), (2, 7), (2, 7), (3, 999)], "task long, k long")
    want = None
    for cell in (1 << 20, 5_000, 40, 1):
        monkeypatch.setattr(expansion, "CELL_ROWS", cell)
        for a, b in ((tasks.limit(900).unionByName(odd), people), (people, tasks.limit(900).unionByName(odd))):
            got = sorted(tuple(r) for r in expansion.expand(a, b, "k").select("k", "task", "person").collect())
            want = want or sorted(tuple(r) for r in a.join(b, "k").select("k", "task", "person").collect())
            assert got == want
    assert expansion.expand(tasks.where("false"), people, "k").count() == 0


def test_no_task_makes_the_hot_class_alone(spark, monkeypatch):
    monkeypatch.setattr(expansion, "CELL_ROWS", 2_000)
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    old = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        tasks, people = school(spark)

        def largest(df):
            m = sorted(r["count"] for r in df.groupBy(F.spark_partition_id().alias("p")).count().collect())
            return m[-1] / m[len(m) // 2]
        assert largest(tasks.join(people, "k")) > 4         # eight partitions, a third of the rows in one class
        assert largest(expansion.expand(tasks, people, "k")) < 2
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_the_hot_class_of_the_test_tables_grows(spark):
    t = fixture_tables(spark, SF001)
    for links in (t.tugas_kelas, t.course_kelas, t.diskusi_kelas):
        key = links.columns[0] if links.columns[0] != "id" else links.columns[1]
        hot = links.where("kelas_id = 0").select(key).distinct().count() / links.select(key).distinct().count()
        assert 0.3 < hot < 0.37
    assert 0 < t.siswa_details.where("kelas_id = 0").count() <= 50


def test_cut_classes_do_not_change_the_queries(spark, monkeypatch):
    t = fixture_tables(spark, SF001)
    jobs = (progress.submission_status, progress.student_assignments, courses.student_materials, forum.student_threads)

    def totals():
        return [j(t).agg(F.count(F.lit(1)), F.sum(F.xxhash64(*j(t).columns).cast("decimal(38,0)"))).first() for j in jobs]
    plain = totals()
    monkeypatch.setattr(expansion, "CELL_ROWS", 50)
    assert totals() == plain


def test_left_out_pairs_equal_an_anti_join(spark, monkeypatch):
    tasks, people = school(spark)
    odd = spark.createDataFrame([(1, None), (2, 7), (2, 7), (3, 999)], "task long, k long")
    a = tasks.limit(900).unionByName(odd)
    pairs = a.join(people, "k").where("(task + person) % 3 = 0").select("task", "k", "person")
    want = sorted(tuple(r) for r in a.join(people, "k").join(pairs.distinct(), ["task", "k", "person"], "left_anti")
                  .select("k", "task", "person").collect())
    for cell, slice_ in ((1 << 20, 1 << 9), (40, 7), (1, 1)):
        monkeypatch.setattr(expansion, "CELL_ROWS", cell)
        monkeypatch.setattr(expansion, "LIST_ROWS", slice_)
        got = expansion.expand_without(a, people, "k", "task", "person", pairs.unionByName(pairs))
        assert sorted(tuple(r) for r in got.select("k", "task", "person").collect()) == want


def _shuffle_keys(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if "hashpartitioning" in line]


def test_listed_classes_are_not_shuffled_by_assignment_and_student(spark):
    """The rows of the expansion outgrow the tables: no exchange is keyed by (assignment, student)."""
    t = fixture_tables(spark, SF001)
    for df, pair in ((progress.submission_status(t), ("tugas_id", "user_id")),
                     (progress.student_assignments(t), ("tugas_id", "siswa_id"))):
        keys = _shuffle_keys(df)
        assert keys and not [k for k in keys if all(f"{c}#" in k.split("hashpartitioning(")[1].split(")")[0] for c in pair)]
