"""Session construction and cluster-safe checkpoint handling."""

from __future__ import annotations

import os
import re

from pyspark.sql import SparkSession

# Settings every job in this package assumes.  UTC keeps date arithmetic
# repeatable; AQE re-plans joins and partition counts from real shuffle sizes
# (the "checked size" for automatic broadcasts) and splits skewed partitions.
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
    "spark.sql.adaptive.localShuffleReader.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def build_session(master: str | None = None, app: str = "kelasflow",
                  shuffle_partitions: int | None = None,
                  extra: dict | None = None) -> SparkSession:
    """Create (or reuse) a session with the package defaults.

    On a cluster pass ``master=None`` and let spark-submit decide; tests pass
    ``local[N]``.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The cluster's checkpoint folder.  A local-mode session that names none
    gets a fresh temporary folder; any other master must name one, because its
    executors could not read a folder of the driver's machine."""
    import tempfile
    sc = spark.sparkContext
    named = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if named or not re.match(r"local(\[|$)", sc.master):
        return ensure_checkpoint_dir(spark)
    return ensure_checkpoint_dir(spark, fallback=tempfile.mkdtemp(prefix="kelasflow-ckpt-"))


def ensure_checkpoint_dir(spark: SparkSession, fallback: str | None = None) -> str:
    """Return the shared checkpoint folder named by the cluster.

    The cluster's ``spark.checkpoint.dir`` is always used when set.  Only when
    it is unset (local tests) is ``fallback`` installed; there is no silent
    machine-local default, because executors on other hosts could not read it.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if current:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(current)
        return sc.getCheckpointDir() or current
    if fallback is None:
        raise RuntimeError(
            "spark.checkpoint.dir is not set; set it to a shared folder "
            "(or pass fallback= in tests)")
    if "://" not in fallback:
        os.makedirs(fallback, exist_ok=True)
    sc.setCheckpointDir(fallback)
    return sc.getCheckpointDir() or fallback
