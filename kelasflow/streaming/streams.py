"""Live feeds as Structured Streaming jobs.

Sources are parquet folders read with ``readStream`` (on a cluster: the
landing folder of the log / message / submission feeds).  Sinks are parquet
folders or ``foreachBatch`` writers on shared storage under
``spark.checkpoint.dir`` -- never the driver-side memory sink -- so output
size is not bounded by the driver.  ``trigger(availableNow=True)`` drains
what is there and stops, which gives every stream a batch twin to compare
with; the same code runs with a processing-time trigger in production.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelasflow.operators import progress as P
from kelasflow.session import checkpoint_root
from kelasflow.sources.catalog import Tables

def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder under the cluster's checkpoint dir (a local temp dir is
    installed only when the session names none, i.e. in local tests)."""
    base = checkpoint_root(spark)
    return f"{base.rstrip('/')}/kelasflow/{name}/{uuid.uuid4().hex}"


def stage(df: DataFrame, path: str, n_files: int | None = None, *keys: str) -> str:
    """Land rows as parquet files a stream can pick up (test stand-in for
    the upstream feed); rows of equal ``keys`` land in one file."""
    (df.repartition(n_files, *keys) if n_files else df).write.option("compression", "zstd").parquet(path)
    return path


def source(spark: SparkSession, path: str, schema, max_files: int | None = None) -> DataFrame:
    r = spark.readStream.schema(schema)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.parquet(path)


def run(query_builder) -> None:
    """Start a stream writer, drain the available input and wait until all of
    it is processed, however long that takes; a failed query raises."""
    q = query_builder.trigger(availableNow=True).start()
    try:
        q.awaitTermination()        # raises the query's exception
    finally:
        if q.isActive:              # only when the wait itself was interrupted
            q.stop()


def latest_per_key(df: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """Rows of the highest ``_batch`` per key (collapses update-mode output
    appended batch by batch); ``max_by`` merges partially, no sort per key."""
    return (df.groupBy(*keys).agg(*[F.max_by(c, F.col("_batch")).alias(c) for c in cols]))


def _write_batch(path: str) -> Callable[[DataFrame, int], None]:
    """foreachBatch writer: each micro-batch lands in its own ``_batch=<id>``
    folder with overwrite, so a retried batch replaces its own output
    (idempotent) and reading ``path`` yields ``_batch`` as a column."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/_batch={batch_id}")
    return write


# ------------------------------------------------------------- S01 daily count
def daily_activity(logs: DataFrame, lateness: str = "1 day") -> DataFrame:
    """Streaming count of log rows per calendar day.  Rows later than the
    watermark (max event time - ``lateness``) are dropped: our choice, the
    reference has no late-data rule.

    Watermarks need a zoned TIMESTAMP, so the wall-clock value is mapped to
    the instant it names in UTC and days are keyed on the UTC epoch day;
    the result does not depend on the session time zone.
    """
    wall_utc = F.from_utc_timestamp(F.col("created_at").cast("timestamp"), F.current_timezone())
    return (logs.withColumn("_t", wall_utc)
            .withWatermark("_t", lateness)
            .groupBy(F.window("_t", "1 day").alias("w"))
            .agg(F.count(F.lit(1)).alias("total"))
            .select(F.date_from_unix_date(F.floor(F.unix_seconds(F.col("w.start")) / 86400).cast("int"))
                    .alias("tanggal"), "total"))


def run_daily_activity(spark: SparkSession, logs_path: str, out: str, ckpt: str,
                       schema, max_files: int | None = None, lateness: str = "1 day") -> DataFrame:
    """Run S01 in update mode; every micro-batch's changed days are appended
    with the batch id and the latest value per day is the answer."""
    stream = daily_activity(source(spark, logs_path, schema, max_files).select("created_at"), lateness)
    run(stream.writeStream.outputMode("update").option("checkpointLocation", ckpt)
        .foreachBatch(_write_batch(out)))
    return latest_per_key(spark.read.parquet(out), ["tanggal"], ["total"])


def run_daily_counts(spark: SparkSession, logs_path: str, out: str, ckpt: str, schema,
                     max_files: int | None = None, lateness: str = "1 day") -> DataFrame:
    """S01 without loss: (tanggal, total, late) per calendar day.

    Every micro-batch adds the counts of its days under ``<out>/days``.  A row
    more than ``lateness`` behind the newest row of earlier batches is late:
    its day was closed.  Late rows are kept under ``<out>/late``, and their
    counts correct the closed days; nothing is dropped.  Each batch writes
    its own folders with overwrite and reads those of earlier batches only,
    so a retried batch replaces its output.
    """
    days, late = f"{out}/days", f"{out}/late"

    def apply(batch: DataFrame, batch_id: int) -> None:
        newest = None
        if batch_id:
            newest = spark.read.parquet(days).where(F.col("_batch") < batch_id).agg(F.max("newest")).first()[0]
        closed = F.lit(newest) - F.expr(f"INTERVAL {lateness}") if newest is not None else F.lit(None)
        rows = batch.withColumn("_late", F.coalesce(F.col("created_at") < closed, F.lit(False)))
        rows.where("_late").drop("_late").write.mode("overwrite").parquet(f"{late}/_batch={batch_id}")
        (rows.groupBy(F.to_date("created_at").alias("tanggal"))
         .agg(F.count(F.lit(1)).alias("total"), F.count(F.when(F.col("_late"), 1)).alias("late"),
              F.max("created_at").alias("newest"))
         .write.mode("overwrite").parquet(f"{days}/_batch={batch_id}"))

    run(source(spark, logs_path, schema, max_files).writeStream
        .option("checkpointLocation", ckpt).foreachBatch(apply))
    return (spark.read.parquet(days).groupBy("tanggal")
            .agg(F.sum("total").alias("total"), F.sum("late").alias("late")))


# --------------------------------------------------------- S02 message feed
def message_feed(messages: DataFrame, users: DataFrame) -> DataFrame:
    """Stream-static join: each new non-blank message with the sender's name
    and role (append mode; the static side is re-read per micro-batch)."""
    u = users.select(F.col("id").alias("user_id"), "name", "role")
    return (messages.where(F.coalesce(F.col("isi"), F.lit("")) != "")
            .join(u, "user_id").select("id", "diskusi_id", "user_id", "isi", "created_at", "name", "role"))


def run_message_feed(spark: SparkSession, t: Tables, msg_path: str, out: str, ckpt: str, schema,
                     max_files: int | None = None) -> DataFrame:
    feed = message_feed(source(spark, msg_path, schema, max_files), t.users)
    run(feed.writeStream.format("parquet").option("path", out).option("checkpointLocation", ckpt)
        .outputMode("append"))
    return spark.read.parquet(out)


# --------------------------------------------- S04 live assignment progress
def run_live_progress(spark: SparkSession, t: Tables, sub_path: str, out: str, ckpt: str, schema,
                      max_files: int | None = None) -> DataFrame:
    """Streaming submissions per assignment (update mode; counting rows, as
    submission ids are unique -- distinct aggregates are not allowed on
    streams), joined after the stream to students per assignment."""
    counts = (source(spark, sub_path, schema, max_files)
              .groupBy("tugas_id").agg(F.count(F.lit(1)).alias("jumlah_kumpul")))
    run(counts.writeStream.outputMode("update").option("checkpointLocation", ckpt)
        .foreachBatch(_write_batch(out)))
    live = latest_per_key(spark.read.parquet(out), ["tugas_id"], ["jumlah_kumpul"])
    base = P.assignment_progress(t).select("id", "jumlah_siswa")
    return (base.join(live, base.id == live.tugas_id, "left")
            .select("id", F.coalesce("jumlah_kumpul", F.lit(0)).alias("jumlah_kumpul"), "jumlah_siswa"))


# ----------------------------------------------------- S03, bounded variant
def first_wins_within(requests: DataFrame, bound: str = "7 days") -> DataFrame:
    """S03, bounded variant: keep the first arrival of each (assignment,
    student) pair among requests no further apart than ``bound`` in event
    time, with state evicted by the watermark.  Cheaper than
    :func:`run_first_wins` (no snapshot read per batch) but only exact when
    duplicates arrive within the bound and the pair is not already stored;
    use it when that is acceptable."""
    ev = F.from_utc_timestamp(F.col("submitted_at").cast("timestamp"), F.current_timezone())
    return (requests.withColumn("_t", ev).withWatermark("_t", bound)
            .dropDuplicatesWithinWatermark(["tugas_id", "siswa_id"]).drop("_t"))


def run_first_wins_within(spark: SparkSession, req_path: str, out: str, ckpt: str, schema,
                          bound: str = "7 days", max_files: int | None = None) -> DataFrame:
    kept = first_wins_within(source(spark, req_path, schema, max_files), bound)
    run(kept.writeStream.format("parquet").option("path", out).option("checkpointLocation", ckpt)
        .outputMode("append"))
    return spark.read.parquet(out)
