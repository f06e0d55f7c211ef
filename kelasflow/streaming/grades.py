"""Grades over an append-only store.

``<root>/gen-<n>`` holds the submission table as of some batch, ``<root>/
changes/_batch=<id>`` the grades that each later batch sets, ``<root>/
published`` which generation counts and up to which batch it goes.  A batch
only adds its own change file; readers merge the changes after the published
batch, the last per pair.  Compaction writes a new generation from that view
and publishes it by one small file; nothing that a reader may use is replaced
or deleted, so a run that dies at any point loses nothing.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelasflow.sources.catalog import Tables
from kelasflow.streaming.streams import run, source

PAIR = ["tugas_id", "siswa_id"]
CHANGES = "tugas_id bigint, siswa_id bigint, nilai int, request_id bigint"


def publish(spark: SparkSession, root: str, generation: int, upto: int) -> None:
    """Make a generation, complete up to batch ``upto``, the one that counts."""
    row = spark.range(1).select(F.lit(generation).alias("generation"), F.lit(upto).cast("bigint").alias("upto"))
    row.coalesce(1).write.mode("overwrite").parquet(f"{root}/published/_gen={generation}")


def published(spark: SparkSession, root: str) -> tuple[int, int] | None:
    """(generation, last batch in it), or None before the first one."""
    try:
        pointers = spark.read.schema("generation int, upto bigint").parquet(f"{root}/published")
    except AnalysisException:
        return None
    last = pointers.agg(F.max(F.struct("generation", "upto")).alias("p")).first()["p"]
    return (last["generation"], last["upto"]) if last else None


def start_store(t: Tables, root: str) -> None:
    """Generation 0 from the submission table, if nothing is published yet."""
    if published(t.spark, root) is None:
        t.pengumpulan_tugas.write.mode("overwrite").parquet(f"{root}/gen-0")
        t.spark.createDataFrame([], CHANGES).write.mode("overwrite").parquet(f"{root}/changes/_batch=-1")
        publish(t.spark, root, 0, -1)


def add_grades(requests: DataFrame, root: str, batch_id: int) -> None:
    """The change file of a batch: of a pair's requests the last one.  A
    retried batch writes the same file again."""
    last = requests.groupBy(*PAIR).agg(F.max(F.struct("request_id", "nilai")).alias("r"))
    (last.select(*PAIR, F.col("r.nilai").cast("int").alias("nilai"), F.col("r.request_id").cast("bigint").alias("request_id"))
     .write.mode("overwrite").parquet(f"{root}/changes/_batch={batch_id}"))


def _merged(spark: SparkSession, root: str, schema) -> tuple[DataFrame, int]:
    generation, upto = published(spark, root)
    base = spark.read.schema(schema).parquet(f"{root}/gen-{generation}")
    changes = spark.read.schema(f"{CHANGES}, _batch bigint").parquet(f"{root}/changes").where(F.col("_batch") > upto)
    last = changes.groupBy(*PAIR).agg(F.max(F.struct("_batch", "request_id", "nilai")).alias("_c"))
    grade = F.when(F.col("_c").isNotNull(), F.col("_c.nilai")).otherwise(F.col("nilai"))
    return base.join(last, PAIR, "left").select(
        *[grade.alias(c) if c == "nilai" else F.col(c) for c in schema.names]), generation


def stored_grades(spark: SparkSession, root: str, schema) -> DataFrame:
    """The submission table with every grade posted so far."""
    return _merged(spark, root, schema)[0]


def compact(spark: SparkSession, root: str, schema, upto: int) -> None:
    """Write the view up to batch ``upto`` as the next generation and publish it.
    An unpublished generation left by a run that died is written anew."""
    table, generation = _merged(spark, root, schema)
    (table.repartitionByRange("tugas_id").sortWithinPartitions(*PAIR)
     .write.mode("overwrite").parquet(f"{root}/gen-{generation + 1}"))
    publish(spark, root, generation + 1, upto)


def run_grade_requests(spark: SparkSession, t: Tables, req_path: str, snap_root: str, ckpt: str, schema,
                       max_files: int | None = None, compact_every: int = 16) -> DataFrame:
    """Grade requests as they come, with the outcome of the batch job W11: the
    last request of a pair sets all its rows.  Returns the table as of the
    last batch; a batch costs what it names, and every ``compact_every``-th
    one writes a generation."""
    start_store(t, snap_root)
    stored = t.pengumpulan_tugas.schema

    def apply(batch: DataFrame, batch_id: int) -> None:
        add_grades(batch, snap_root, batch_id)
        if (batch_id + 1) % compact_every == 0:
            compact(spark, snap_root, stored, batch_id)

    run(source(spark, req_path, schema, max_files).writeStream
        .option("checkpointLocation", ckpt).foreachBatch(apply))
    return stored_grades(spark, snap_root, stored)
