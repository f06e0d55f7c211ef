"""A bundle of learning-schema DataFrames plus parquet/JDBC IO for it."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelasflow.schema import SCHEMAS


@dataclass
class Tables:
    """Named DataFrames of the learning schema.  Attribute access by name."""

    spark: SparkSession
    frames: dict[str, DataFrame] = field(default_factory=dict)

    def __getattr__(self, name: str) -> DataFrame:
        frames = self.__dict__.get("frames", {})
        if name in frames:
            return frames[name]
        raise AttributeError(name)

    def __getitem__(self, name: str) -> DataFrame:
        return self.frames[name]

    def replace(self, **frames: DataFrame) -> "Tables":
        """A new bundle with some tables swapped (used by change jobs); it
        remembers which tables differ from the bundle it came from."""
        out = Tables(self.spark, {**self.frames, **frames})
        out.__dict__["changed"] = set(self.__dict__.get("changed", set())) | set(frames)
        return out


def conform(df: DataFrame, name: str) -> DataFrame:
    """Project/cast ``df`` to the declared schema of table ``name``."""
    return df.select([F.col(f.name).cast(f.dataType).alias(f.name) for f in SCHEMAS[name].fields])


def read_tables(spark: SparkSession, root: str, names=None) -> Tables:
    """Read a learning-schema directory ``root/<table>`` written by :func:`write_tables`."""
    names = names or list(SCHEMAS)
    return Tables(spark, {n: spark.read.schema(SCHEMAS[n]).parquet(f"{root}/{n}") for n in names})


# Physical layout at rest: big child tables clustered on the key their joins
# and aggregates use, so scans of one assignment / day prune row groups.
SORT_KEYS = {
    "pengumpulan_tugas": ["tugas_id", "siswa_id"],
    "tugas_kelas": ["tugas_id"],
    "activity_logs": ["created_at"],
    "chat_diskusi": ["diskusi_id", "created_at"],
    "course_enrollments": ["course_id"],
}


def write_tables(tables: Tables, root: str, mode: str = "overwrite") -> None:
    """Write every table as parquet under ``root`` (one folder per table)."""
    for n, df in tables.frames.items():
        out = conform(df, n) if n in SCHEMAS else df
        keys = SORT_KEYS.get(n)
        if keys:
            out = out.repartitionByRange(*keys).sortWithinPartitions(*keys)
        out.write.mode(mode).parquet(f"{root}/{n}")


def read_jdbc(spark: SparkSession, url: str, names=None, properties: dict | None = None,
              partition_column: str = "id", num_partitions: int = 64) -> Tables:
    """Read the learning schema straight from the transactional store over JDBC.

    Each table is split into ``num_partitions`` range reads on its id so the
    load is spread over executors.  Needs a JDBC driver on the classpath (none
    ships with this repository).
    """
    names = names or list(SCHEMAS)
    props = dict(properties or {})
    frames = {}
    for n in names:
        cols = [f.name for f in SCHEMAS[n].fields]
        if partition_column in cols:
            bounds = (spark.read.jdbc(url, f"(SELECT min({partition_column}) lo, max({partition_column}) hi FROM {n}) b",
                                      properties=props).first())
            frames[n] = spark.read.jdbc(url, n, column=partition_column, lowerBound=bounds[0] or 0,
                                        upperBound=(bounds[1] or 0) + 1, numPartitions=num_partitions,
                                        properties=props)
        else:
            frames[n] = spark.read.jdbc(url, n, properties=props)
        frames[n] = conform(frames[n], n)
    return Tables(spark, frames)


def from_rows(spark: SparkSession, **rows) -> Tables:
    """Small bundle from Python tuples (tests, examples); tables not given
    are empty with their declared schema."""
    return Tables(spark, {n: spark.createDataFrame(rows.get(n, []), SCHEMAS[n]) for n in SCHEMAS})
