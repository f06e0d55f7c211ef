"""S04 kept up on both inputs: submissions, and students who change class.

Counts per assignment are maintained by signed deltas.  A micro-batch of
submissions adds to the assignments that it names.  A micro-batch of moves
(user, class, +1 or -1) is joined with the memberships of the users that it
names: the set of classes that a user had before counts -1, the one they have
after it +1.  Equal sets are added up first, so the classes are expanded to
their assignments once per set, not per student; an assignment counts once for
a set, and a move inside an assignment changes nothing.  Every batch writes its own
folders with overwrite and reads those of earlier batches only, so a retried
batch replaces its deltas.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelasflow.functions.shared import materialize
from kelasflow.operators import progress as P
from kelasflow.sources.catalog import Tables
from kelasflow.streaming.streams import run, source

MEMBER = "user_id bigint, kelas_id int, delta bigint"
COUNT = "tugas_id bigint, n bigint"
MOVES = "user_id bigint, kelas_id int, delta int"


def start_progress(t: Tables, root: str) -> None:
    """Write where the counts start: the memberships and the students per
    assignment of ``t``, no submissions.  Done once per ``root``."""
    spark = t.spark
    try:
        spark.read.parquet(f"{root}/students/_batch=-1")
    except AnalysisException:
        (t.siswa_details.where("kelas_id IS NOT NULL").select("user_id", "kelas_id").distinct()
         .withColumn("delta", F.lit(1).cast("bigint")).write.mode("overwrite").parquet(f"{root}/members/_batch=-1"))
        spark.createDataFrame([], COUNT).write.mode("overwrite").parquet(f"{root}/received/_batch=-1")
        (P.students_reached(t)
         .write.mode("overwrite").parquet(f"{root}/students/_batch=-1"))


def _classes(t: Tables) -> DataFrame:
    """(tugas_id, kelas_id) pairs of classes that exist."""
    return (t.tugas_kelas.select("tugas_id", "kelas_id").distinct()
            .join(t.kelas.select(F.col("id").alias("kelas_id")), "kelas_id", "left_semi"))


def add_batch(t: Tables, root: str, batch: DataFrame, batch_id: int) -> None:
    """The deltas of one micro-batch (rows of kind ``submission`` and ``move``)."""
    spark = t.spark
    (batch.where("kind = 'submission'").groupBy("tugas_id").agg(F.count(F.lit(1)).alias("n"))
     .write.mode("overwrite").parquet(f"{root}/received/_batch={batch_id}"))
    (batch.where("kind = 'move'").groupBy("user_id", "kelas_id").agg(F.sum("delta").cast("bigint").alias("delta"))
     .where("delta <> 0").write.mode("overwrite").parquet(f"{root}/members/_batch={batch_id}"))
    members = spark.read.schema(f"{MEMBER}, _batch bigint").parquet(f"{root}/members").where(F.col("_batch") <= batch_id)
    moved = members.where(F.col("_batch") == batch_id).select("user_id").distinct()
    theirs = members.join(moved, "user_id", "left_semi").groupBy("user_id", "kelas_id").agg(
        F.sum(F.when(F.col("_batch") < batch_id, F.col("delta")).otherwise(0)).alias("before"), F.sum("delta").alias("after"))
    # students of the same classes count alike: a set of classes stands for all of them
    sets = theirs.groupBy("user_id").agg(F.array_sort(F.collect_list(F.when(F.col("before") > 0, F.col("kelas_id")))).alias("before"),
                                         F.array_sort(F.collect_list(F.when(F.col("after") > 0, F.col("kelas_id")))).alias("after"))
    weights = (sets.select(F.inline(F.array(F.struct(F.col("before").alias("classes"), F.lit(-1).alias("w")),
                                            F.struct(F.col("after").alias("classes"), F.lit(1).alias("w")))))
               .where("size(classes) > 0").groupBy("classes").agg(F.sum("w").alias("w")).where("w <> 0"))
    weights = materialize(weights.withColumn("kelas_id", F.explode("classes")), "weights")
    links = weights.join(_classes(t), "kelas_id")
    # an assignment counts once for a set, however many of its classes it is given to
    once = links.where("size(classes) > 1").groupBy("tugas_id", "classes").agg(F.max("w").alias("w")).select("tugas_id", "w")
    (links.where("size(classes) = 1").select("tugas_id", "w").unionByName(once)
     .groupBy("tugas_id").agg(F.sum("w").alias("n")).where("n <> 0")
     .write.mode("overwrite").parquet(f"{root}/students/_batch={batch_id}"))


def progress_now(spark: SparkSession, root: str) -> DataFrame:
    """(id, jumlah_kumpul, jumlah_siswa) of every assignment with a class."""
    def total(name: str) -> DataFrame:
        return (spark.read.schema(f"{COUNT}, _batch bigint").parquet(f"{root}/{name}").groupBy("tugas_id")
                .agg(F.sum("n").alias(name)))
    return total("students").join(total("received"), "tugas_id", "left").select(
        F.col("tugas_id").alias("id"), F.coalesce("received", F.lit(0)).alias("jumlah_kumpul"),
        F.col("students").alias("jumlah_siswa"))


def run_progress(spark: SparkSession, t: Tables, sub_path: str, move_path: str, root: str, ckpt: str, schema,
                 max_files: int | None = None) -> DataFrame:
    """Drain the submissions (``schema``, with tugas_id) and the moves (MOVES:
    +1 joins a class, -1 leaves it) that have arrived, and give the counts.
    Assignments and their classes are those of ``t``; a class left more often
    than joined counts as left."""
    start_progress(t, root)
    none = F.lit(None)
    subs = source(spark, sub_path, schema, max_files).select(
        F.lit("submission").alias("kind"), "tugas_id", none.cast("bigint").alias("user_id"),
        none.cast("int").alias("kelas_id"), none.cast("int").alias("delta"))
    moves = source(spark, move_path, MOVES, max_files).select(
        F.lit("move").alias("kind"), none.cast("bigint").alias("tugas_id"), "user_id", "kelas_id", "delta")
    run(subs.unionByName(moves).writeStream.option("checkpointLocation", ckpt)
        .foreachBatch(lambda batch, batch_id: add_batch(t, root, batch, batch_id)))
    return progress_now(spark, root)
