"""First-write-wins submissions with the pairs in a state store.

The rule has no time bound, so every (assignment, student) pair that has a
submission is a key of the stream's state (RocksDB, under the checkpoint).
The stored table seeds it once: its pairs are a second source of the stream,
read in the first micro-batch.  Later batches touch the pairs that they name
and nothing else; the stored table is not read again.

Only pairs go through the state: all that are asked for, so that no join
comes before it.  The stream names the files of a micro-batch beside its new
pairs, and the requests are read from these files and judged there, in one
pass.  Pairs refused because their assignment or student is unknown are kept
aside; they count as new again in a run whose tables have both.
"""

from __future__ import annotations

from contextlib import contextmanager
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kelasflow.functions.ids import ordered_ids, place_rows
from kelasflow.functions.shared import materialize
from kelasflow.sources.catalog import Tables
from kelasflow.streaming.streams import run, source

# No running total of the keys: it would cost one more lookup per key.
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",
}
PAIR = ["tugas_id", "siswa_id"]


@contextmanager
def _rocksdb(spark: SparkSession):
    """The state store of queries started inside; a session's own choices are put back."""
    old = {k: spark.conf.get(k, None) for k in STATE_STORE}
    for k, v in STATE_STORE.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.set(k, v) if v else spark.conf.unset(k)


def _counted(parent: DataFrame, col: str) -> DataFrame:
    """The ids of a parent table with their number of rows, written once per run."""
    ids = parent.select(F.col("id").alias(col)).where(F.col(col).isNotNull())
    return materialize(ids.groupBy(col).agg(F.count(F.lit(1)).alias("_n")), f"s03-{col}")


def _with_parents(requests: DataFrame, col: str, parent: DataFrame, name: str) -> DataFrame:
    """``requests`` with the number of their parent's rows.  Only the ids that
    have not just one are joined; they are written first, so the requests
    are shuffled only if these are too many to be sent to all tasks."""
    asked = requests.select(col).where(F.col(col).isNotNull()).distinct()
    odd = (asked.join(parent, col, "left").withColumn(name, F.coalesce("_n", F.lit(0))).where(F.col(name) != 1)
           .select(col, name))
    return (requests.join(materialize(odd, "s03-odd"), col, "left")
            .withColumn(name, F.when(F.col(col).isNull(), 0).otherwise(F.coalesce(name, F.lit(1)))))


def _judged(requests: DataFrame, free: DataFrame, tasks: DataFrame, people: DataFrame) -> DataFrame:
    """The requests of a micro-batch with their outcome.  ``free`` has the
    pairs without a submission among those asked for.  A request has one
    outcome per row of its assignment and of its student."""
    fresh = free.withColumn("_fresh", F.lit(True))
    asked = _with_parents(_with_parents(requests, "tugas_id", tasks, "_tasks"), "siswa_id", people, "_people")
    copies = F.greatest("_tasks", F.lit(1)) * F.greatest("_people", F.lit(1))
    asked = asked.withColumn("_copy", F.explode(F.array_repeat(F.lit(1), copies.cast("int")))).drop("_copy")
    known = (F.col("_tasks") > 0) & (F.col("_people") > 0)
    reason = F.when(F.col("_tasks") == 0, "unknown_assignment").otherwise("unknown_student")
    first = F.min(F.struct("submitted_at", "request_id")).over(Window.partitionBy(*PAIR))["request_id"]
    outcome = (F.when(F.col("_fresh").isNull() | F.col("_first").isNull(), "already_submitted")
               .when(F.col("request_id") == F.col("_first"), "accepted").otherwise("duplicate_in_batch"))
    columns = [*PAIR, "request_id", "file_path", "submitted_at", "outcome"]
    decided = asked.where(known).join(fresh, PAIR, "left").withColumn("_first", first).withColumn("outcome", outcome)
    return decided.select(*columns).unionByName(asked.where(~known).withColumn("outcome", reason).select(*columns))


def _written(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.parquet(path)
        return True
    except AnalysisException:
        return False


def _put(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)


def run_first_wins(spark: SparkSession, t: Tables, req_path: str, snap_path: str, out: str, ckpt: str,
                   schema, max_files: int | None = None) -> DataFrame:
    """(request_id, outcome) of every request read so far, as the batch job W10
    gives them; the accepted rows join the stored table at ``snap_path``.

    The first call stores ``t.pengumpulan_tugas`` there; a later one with the
    same folders goes on where the last one stopped.  Of a pair's requests
    in one micro-batch the earliest wins (time, then id); a pair of an
    earlier batch or of the stored table refuses all.  Ids follow a mark that
    is written beside each batch, so no id column is scanned; the outcomes are
    written in the order of the ids, which are counted from there.  Every batch
    writes its own folders with overwrite: a retried one replaces its output.
    """
    seed, marks, refused = f"{snap_path}/_batch=-1", f"{snap_path}-marks", f"{snap_path}-refused"
    if not _written(spark, f"{marks}/_batch=-1"):
        _put(t.pengumpulan_tugas, seed)
        _put(spark.read.parquet(seed).agg(F.coalesce(F.max("id"), F.lit(0)).cast("bigint").alias("top")),
             f"{marks}/_batch=-1")
    tasks, people = _counted(t.tugas, "tugas_id"), _counted(t.users, "siswa_id")
    stored = spark.readStream.schema(t.pengumpulan_tugas.schema).parquet(seed).select(*PAIR)
    landed = source(spark, req_path, schema, max_files)
    new = stored.unionByName(landed.select(*PAIR)).dropDuplicates(PAIR)             # the state
    no_file, no_id = F.lit(None).cast("string").alias("file"), F.lit(None).cast("bigint")
    rows = (landed.where("_metadata.row_index = 0")                     # one row per file
            .select(F.col("_metadata.file_path").alias("file"), *[no_id.alias(c) for c in PAIR],
                          F.lit("file").alias("kind"))
            .unionByName(new.select(no_file, *PAIR, F.lit("new").alias("kind")))
            .unionByName(stored.select(no_file, *PAIR, F.lit("seed").alias("kind"))))

    def landed_in(rows: DataFrame) -> DataFrame:
        files = [unquote(r.file) for r in rows.where("kind = 'file'").select("file").distinct().collect()]
        requests = spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)
        return requests.select(*PAIR, "request_id", "file_path", F.col("submitted_at").cast("timestamp_ntz"))

    waiting = None
    if _written(spark, refused):
        waiting = materialize(spark.read.parquet(refused).join(tasks.select("tugas_id"), "tugas_id", "left_semi")
                              .join(people.select("siswa_id"), "siswa_id", "left_semi"), "s03-waiting")

    def free_pairs(rows: DataFrame, batch_id: int) -> DataFrame:
        free = (rows.where("kind = 'new'").select(*PAIR)
                .join(rows.where("kind = 'seed'").select(*PAIR), PAIR, "left_anti"))
        if waiting is None:
            return free
        again = waiting.where(F.col("_batch") < batch_id).select(*PAIR).distinct()
        taken = spark.read.parquet(f"{refused}-taken").where(F.col("_batch") < batch_id).select(*PAIR)
        return free.unionByName(again.join(taken, PAIR, "left_anti"))

    def apply(batch: DataFrame, batch_id: int) -> None:
        at = f"_batch={batch_id}"
        _put(batch, f"{out}-rows/{at}")
        rows = spark.read.parquet(f"{out}-rows/{at}")
        judged = _judged(landed_in(rows), free_pairs(rows, batch_id), tasks, people)
        _put(place_rows(judged, ["request_id"], F.col("outcome") == "accepted"), f"{out}/{at}")
        done = spark.read.parquet(f"{out}/{at}")
        won = done.where("outcome = 'accepted'")
        taken = won.select(*PAIR)
        _put(taken.limit(0) if waiting is None else taken.join(waiting, PAIR, "left_semi"), f"{refused}-taken/{at}")
        stray = materialize(done.where(F.col("outcome").startswith("unknown")).select(*PAIR).distinct(), "s03-stray")
        _put(rows.where("kind = 'new'").select(*PAIR).join(stray, PAIR, "left_semi")         # those never stored
             .join(rows.where("kind = 'seed'").select(*PAIR), PAIR, "left_anti"), f"{refused}/{at}")
        top = spark.read.parquet(marks).where(F.col("_batch") < batch_id).agg(F.max("top")).first()[0]
        accepted = ordered_ids(won, F.lit(top)).select(
            "id", "tugas_id", "siswa_id", "file_path", F.lit(None).cast("int").alias("nilai"),
            F.col("submitted_at").alias("dikumpulkan_at"))
        _put(accepted, f"{snap_path}/{at}")
        _put(won.agg((F.count(F.lit(1)) + top).cast("bigint").alias("top")), f"{marks}/{at}")

    with _rocksdb(spark):
        run(rows.writeStream.outputMode("append").option("checkpointLocation", ckpt).foreachBatch(apply))
    return spark.read.parquet(out).select("request_id", "outcome")


def stored_submissions(spark: SparkSession, snap_path: str, schema) -> DataFrame:
    """The submission table that S03 has built so far."""
    return spark.read.parquet(snap_path).select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])
