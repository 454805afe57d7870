"""Session construction and lineage helpers.

On a cluster the session is created by the platform; ``get_session`` only fills
in settings that are still unset, so cluster-wide values (shuffle partitions,
checkpoint directory, AQE knobs) always win.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

# Settings applied only when the running session has no value for them.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}
# What one task holds, for sessions that don't say: scans are cut into splits and
# joins and aggregates into partitions of this size, and a partition that a hot
# key makes larger is split, so that sorts fit in memory whatever the input's size.
SIZED = {
    "spark.sql.files.maxPartitionBytes": "16m",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8m",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "32m",
}
SOURCE_BYTES = 4_000_000  # of the source files per shuffle partition
# Broadcasts are left to Spark's measured-size rule
# (spark.sql.autoBroadcastJoinThreshold, 10 MB unless the cluster sets it):
# no operator hints a broadcast of a data-dependent side.


def get_session(master: str | None = None, app_name: str = "quadflow",
                shuffle_partitions: int | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    builder = (builder.config("spark.ui.enabled", "false")
               .config("spark.ui.showConsoleProgress", "false"))
    if shuffle_partitions is not None:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    for key, value in DEFAULTS.items():
        if spark.conf.get(key, None) in (None, ""):
            spark.conf.set(key, value)
    ensure_checkpoint_dir(spark)
    return spark


def fit_partitions(spark: SparkSession, source_bytes: int) -> None:
    """Sizes the session's tasks for a source of that many bytes: the sizes of
    ``SIZED`` where the session has none, and shuffle partitions in proportion
    to the source. Their number is only ever raised: a fixed one lets what a
    task sorts and spills grow with the tables."""
    for key, value in SIZED.items():
        if spark.conf.get(key, None) in (None, ""):
            spark.conf.set(key, value)
    key, wanted = "spark.sql.shuffle.partitions", -(-source_bytes // SOURCE_BYTES)
    if wanted > int(spark.conf.get(key)):
        spark.conf.set(key, str(wanted))


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint directory, honouring ``spark.checkpoint.dir``.

    The cluster names a shared folder in ``spark.checkpoint.dir``; it is used
    as is. Only when nothing is configured (local tests) a scratch folder is
    created, so a cluster never falls back to a machine-local path.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get(
        "spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        configured = tempfile.mkdtemp(prefix="quadflow-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the reliable checkpoint directory.

    Used between long chains of state transitions so that a lost executor
    recomputes from the checkpoint instead of the whole lineage.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
