"""Test mapping: derive the learning schema from the supplied TPC-H-ish tables.

This only re-shapes rows into the schema the operators expect (see
FIXTURES.md); it does none of an operator's work.  Scalar counts (suppliers,
customers, classes) are scalar subqueries, and every "pair with a class"
rule ``(key + n) % m = 0`` is written as an equi-join on ``n % m`` against
the 25-row nation table, so no cross join appears anywhere.  Classes grow
with the customers, about 50 students each; class 0 is a hot one at every
scale: as many students, but a third of all assignments, courses, threads
and teachers.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelasflow.sources.catalog import Tables, conform

TEACHER_ID_OFFSET = 10_000_000
ADMIN_ID = 20_000_000
CLASS_SIZE = 50
FIRST_CLASS = 25            # ids below it are the nations' classes
HOT_SHARE = 3               # one in so many assignments, courses, threads goes to class 0
ROWS_PER_TASK = 500_000     # of a join of line items with their orders
EPOCH_2024 = "TIMESTAMP_NTZ'2024-01-01 00:00:00'"


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pair_with_nation(left: DataFrame, key: str, modulus: int, nation: DataFrame) -> DataFrame:
    """Rows of ``left`` paired with every nation n where (key + n) % modulus == 0."""
    want = ((F.lit(modulus) - F.col(key) % modulus) % modulus).alias("_m")
    nat = nation.select("n_nationkey", (F.col("n_nationkey") % modulus).alias("_m"))
    return left.withColumn("_m", want).join(F.broadcast(nat), "_m").drop("_m")


def _dealt_by_order(lineitem: DataFrame, orders: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Line items and orders in so many partitions that no task of their join
    gets many more than ``ROWS_PER_TASK`` line items, however few partitions
    the session asks for or merges.  A table that is small for the session
    is left as it is.  (The count reads the Parquet footers only.)"""
    spark = lineitem.sparkSession
    n = math.ceil(lineitem.count() / ROWS_PER_TASK)
    if n <= min(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism):
        return lineitem, orders
    return lineitem.repartition(n, "l_orderkey"), orders.repartition(n, "o_orderkey")


def fixture_tables(spark: SparkSession, sf_dir: str) -> Tables:
    r = lambda n: _read(spark, sf_dir, n)
    nation, region = r("nation"), r("region")
    customer, supplier, part = r("customer"), r("supplier"), r("part")
    orders, lineitem = r("orders"), r("lineitem")
    events, conversations = r("events"), r("conversations")

    nsup = supplier.agg(F.count(F.lit(1))).scalar()
    ncust = customer.agg(F.count(F.lit(1))).scalar()

    own_class = F.expr(f"CAST({FIRST_CLASS} + c_custkey div {CLASS_SIZE} AS INT)")
    grown = customer.select(own_class.alias("id")).distinct()
    nclass = customer.agg(F.count_distinct(F.expr(f"c_custkey div {CLASS_SIZE}"))).scalar()
    kelas = nation.select(F.col("n_nationkey").cast("int").alias("id"), F.col("n_name").alias("nama_kelas")).unionByName(
        grown.select("id", F.concat(F.lit("KELAS_"), F.col("id").cast("string")).alias("nama_kelas")))

    def dealt(key, modulus):
        """Class of a (key, nation) pair; one pair of every third key goes to the hot class."""
        hot = (F.col(key) % HOT_SHARE == 0) & (F.col("n_nationkey") < modulus)
        return F.when(hot, F.lit(0)).otherwise(
            ((F.col(key) + F.col("n_nationkey")) % nclass + FIRST_CLASS).cast("int"))

    first_order = orders.groupBy("o_custkey").agg(F.min("o_orderdate").alias("created_at"))
    students = (customer.join(first_order, customer.c_custkey == first_order.o_custkey, "left")
                .select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"),
                        F.concat(F.lower("c_name"), F.lit("@siswa.example.org")).alias("email"),
                        F.lit("siswa").alias("role"), F.lit(None).cast("string").alias("foto"),
                        "created_at"))
    first_ship = lineitem.groupBy("l_suppkey").agg(F.min("l_shipdate").alias("created_at"))
    teachers = (supplier.join(first_ship, supplier.s_suppkey == first_ship.l_suppkey, "left")
                .select((F.col("s_suppkey") + TEACHER_ID_OFFSET).alias("id"), F.col("s_name").alias("name"),
                        F.concat(F.lower("s_name"), F.lit("@guru.example.org")).alias("email"),
                        F.lit("guru").alias("role"), F.lit(None).cast("string").alias("foto"),
                        "created_at"))
    admin = region.limit(1).select(F.lit(ADMIN_ID).cast("bigint").alias("id"), F.lit("Admin").alias("name"),
                                   F.lit("admin@example.org").alias("email"), F.lit("admin").alias("role"),
                                   F.lit(None).cast("string").alias("foto"),
                                   F.expr("TIMESTAMP_NTZ'1995-01-01 00:00:00'").alias("created_at"))
    users = students.unionByName(teachers).unionByName(admin)

    siswa_details = (customer.where(F.col("c_custkey") % 10 != 9)
                     .select(F.col("c_custkey").alias("id"), F.col("c_custkey").alias("user_id"),
                             F.col("c_mktsegment").alias("jurusan"),
                             F.lpad(F.col("c_custkey").cast("string"), 10, "0").alias("nisn"),
                             F.when(F.col("c_custkey") % 20 == 0, F.lit(None))
                              .when(F.col("c_custkey") % nclass == 1, F.lit(0))
                              .otherwise(own_class).alias("kelas_id")))

    guru_details = (supplier.where(F.col("s_suppkey") % 10 != 9)
                    .join(nation, supplier.s_nationkey == nation.n_nationkey)
                    .join(region, nation.n_regionkey == region.r_regionkey)
                    .select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") + TEACHER_ID_OFFSET).alias("user_id"),
                            F.col("r_name").alias("mapel"),
                            F.lpad(F.col("s_suppkey").cast("string"), 18, "0").alias("nip")))

    guru_kelas = (_pair_with_nation(supplier.where(~(F.col("s_suppkey") % 10).isin(8, 9)).select("s_suppkey"),
                                    "s_suppkey", 8, nation)
                  .select((F.col("s_suppkey") * 100 + F.col("n_nationkey")).alias("id"),
                          F.col("s_suppkey").alias("guru_id"), dealt("s_suppkey", 8).alias("kelas_id")))

    part_first_ship = lineitem.groupBy("l_partkey").agg(F.min("l_shipdate").alias("created_at"))
    courses = (part.join(part_first_ship, part.p_partkey == part_first_ship.l_partkey, "left")
               .select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"),
                       F.col("p_type").alias("description"),
                       F.when(F.col("p_partkey") % 15 == 0, F.lit(ADMIN_ID).cast("bigint"))
                        .when(F.col("p_partkey") % 31 == 0, F.lit(None).cast("bigint"))
                        .otherwise(F.col("p_partkey") % nsup + TEACHER_ID_OFFSET).alias("created_by"),
                       "created_at",
                       F.concat(F.lit("materi/"), F.col("p_partkey").cast("string")).alias("file_path")))

    course_kelas = (_pair_with_nation(part.select("p_partkey"), "p_partkey", 12, nation)
                    .select((F.col("p_partkey") * 100 + F.col("n_nationkey")).alias("id"),
                            F.col("p_partkey").alias("course_id"), dealt("p_partkey", 12).alias("kelas_id")))

    course_enrollments = (lineitem.where(F.col("l_partkey") % 50 != 0)
                          .join(orders, lineitem.l_orderkey == orders.o_orderkey)
                          .select(F.col("l_partkey").alias("course_id"), F.col("o_custkey").alias("student_id"))
                          .distinct())

    tugas = orders.select(F.col("o_orderkey").alias("id"),
                          F.concat(F.lit("Tugas "), F.col("o_orderkey").cast("string")).alias("judul"),
                          F.col("o_orderpriority").alias("deskripsi"),
                          F.to_date("o_orderdate").alias("deadline"),
                          F.concat(F.lit("tugas/"), F.col("o_orderkey").cast("string")).alias("file_path"),
                          (F.col("o_custkey") % nsup + TEACHER_ID_OFFSET).alias("created_by"),
                          (F.col("o_orderdate") - F.expr("INTERVAL 14 DAYS")).alias("created_at"))

    by_customer = (orders.join(customer, orders.o_custkey == customer.c_custkey)
                   .select(F.col("o_orderkey").alias("tugas_id"), own_class.alias("kelas_id")))
    by_key = orders.select(F.col("o_orderkey").alias("tugas_id"),
                           (F.col("o_orderkey") % nclass + FIRST_CLASS).cast("int").alias("kelas_id"))
    hot = orders.where(F.col("o_orderkey") % HOT_SHARE == 0).select(F.col("o_orderkey").alias("tugas_id"),
                                                                    F.lit(0).alias("kelas_id"))
    tugas_kelas = by_customer.union(by_key).union(hot).distinct()

    items, their_orders = _dealt_by_order(lineitem, orders)
    pengumpulan_tugas = (items.join(their_orders, F.col("l_orderkey") == F.col("o_orderkey"))
                         .select((((F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 100000 + F.col("l_partkey"))
                                  * 10000 + F.col("l_suppkey")).alias("id"),
                                 F.col("l_orderkey").alias("tugas_id"),
                                 F.when(F.col("l_linenumber") == 1, F.col("o_custkey"))
                                  .otherwise(F.col("l_partkey") % ncust).alias("siswa_id"),
                                 F.concat(F.lit("kumpul/"), F.col("l_orderkey").cast("string")).alias("file_path"),
                                 F.when(F.col("l_returnflag") == "N", F.lit(None))
                                  .otherwise((F.col("l_quantity") * 2).cast("int")).alias("nilai"),
                                 F.col("l_shipdate").alias("dikumpulkan_at")))

    verifications = orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user_id"),
                                  F.when(F.col("o_orderstatus") == "F", "approved")
                                   .when(F.col("o_orderstatus") == "O", "rejected")
                                   .when(F.col("o_orderstatus") == "P", "pending").alias("status"),
                                  F.col("o_orderdate").alias("requested_at"))

    activity_logs = events.select(F.col("event_id").alias("id"), "user_id",
                                  F.col("event_type").alias("action"), F.col("ts").alias("created_at"))

    openers = conversations.where(F.col("turn") == 0)
    diskusi = openers.select(F.col("conv_id").alias("id"), F.substring("text", 1, 40).alias("judul"),
                             F.col("text").alias("isi"),
                             (F.col("conv_id") % nsup + TEACHER_ID_OFFSET).alias("created_by"),
                             F.expr(f"timestampadd(MINUTE, conv_id * 60, {EPOCH_2024})").alias("created_at"))
    diskusi_kelas = (_pair_with_nation(openers.where(F.col("conv_id") % 20 != 19).select("conv_id"),
                                       "conv_id", 10, nation)
                     .select((F.col("conv_id") * 100 + F.col("n_nationkey")).alias("id"),
                             F.col("conv_id").alias("diskusi_id"), dealt("conv_id", 10).alias("kelas_id")))
    chat_diskusi = (conversations.where(F.col("turn") >= 1)
                    .select((F.col("conv_id") * 100 + F.col("turn")).alias("id"),
                            F.col("conv_id").alias("diskusi_id"),
                            F.when(F.col("role") == "assistant", F.col("conv_id") % nsup + TEACHER_ID_OFFSET)
                             .otherwise((F.col("conv_id") * 7 + F.col("turn")) % ncust).alias("user_id"),
                            F.col("text").alias("isi"),
                            F.expr(f"timestampadd(MINUTE, conv_id * 60 + turn, {EPOCH_2024})").alias("created_at")))

    frames = dict(users=users, kelas=kelas, siswa_details=siswa_details, guru_details=guru_details,
                  guru_kelas=guru_kelas, courses=courses, course_kelas=course_kelas,
                  course_enrollments=course_enrollments, tugas=tugas, tugas_kelas=tugas_kelas,
                  pengumpulan_tugas=pengumpulan_tugas, verifications=verifications,
                  activity_logs=activity_logs, diskusi=diskusi, diskusi_kelas=diskusi_kelas,
                  chat_diskusi=chat_diskusi)
    return Tables(spark, {n: conform(df, n) for n, df in frames.items()})
