"""Session helpers: a local session for tests/bench and a shared scratch root.

On a cluster the session already exists; library code only *reads*
``spark.checkpoint.dir`` and never invents a machine-local folder.  Tests
and the bench (local mode) set it when it is unset.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "loanscope", event_log_dir: str | None = None) -> SparkSession:
    """Local-mode session used by tests and bench.py (UI off, AQE on; optional
    event log for stage/task timings, read back with tools/stage_times.py)."""
    builder = SparkSession.builder
    if event_log_dir:
        builder = builder.config("spark.eventLog.enabled", "true").config("spark.eventLog.dir", event_log_dir)
    spark = (
        builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint root; create a private one only when unset.

    A cluster names a shared folder in ``spark.checkpoint.dir``; that value
    always wins.  Only local runs (tests, bench) reach the fallback; on any
    other master an unset folder is an error, since each executor would write
    to its own disk.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir() or sc.getConf().get(CHECKPOINT_CONF, None)
    if not current and not sc.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_CONF} to a folder that all executors share")
    if not current:
        current = tempfile.mkdtemp(prefix="loanscope-ckpt-")  # local runs only: nothing named one
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(current)
    return sc.getCheckpointDir() or current


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh directory path under the shared checkpoint root."""
    root = ensure_checkpoint_dir(spark)
    return os.path.join(root, "loanscope", f"{name}-{uuid.uuid4().hex[:12]}")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet under the shared checkpoint root and read back: cuts lineage like
    a reliable checkpoint, but packed, and a reader takes only the columns that it needs."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cluster_conf(input_bytes: int, executors: int, cores_per_executor: int = 4,
                 target_partition_bytes: int = 256 << 20) -> dict[str, str]:
    """Settings for a large cluster, sized from the input volume.

    * scan splits of ~256 MB (one task per split, enough tasks per core);
    * shuffle partitions so each holds ~256 MB before AQE coalescing, never
      fewer than 2 waves of the cluster's cores;
    * AQE on: coalescing to the advisory size, skew-join splitting at 4x the
      median (and > 512 MB), runtime broadcast only under 64 MB measured;
    * reliable checkpoints go to ``spark.checkpoint.dir`` (set by the cluster).
    """
    cores = max(1, executors * cores_per_executor)
    parts = max(2 * cores, int(input_bytes // target_partition_bytes) + 1)
    return {
        "spark.sql.files.maxPartitionBytes": str(target_partition_bytes),
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(512 << 20),
        "spark.sql.adaptive.autoBroadcastJoinThreshold": str(64 << 20),
        "spark.sql.autoBroadcastJoinThreshold": str(64 << 20),
        "spark.sql.execution.arrow.maxRecordsPerBatch": "10000",
    }
