"""Session helpers: one place for the settings every job relies on."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings that matter for correctness or scale on any cluster.  Shuffle
# partition counts are left to the cluster except in local runs.
_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str | None = None, app: str = "blockflow",
              shuffle_partitions: int | None = None,
              extra: dict[str, str] | None = None) -> SparkSession:
    """Return the active session, or build one (local runs and tests)."""
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in _DEFAULTS.items():
        b = b.config(k, v)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    On a cluster this must already be set to shared storage (an error is
    raised otherwise); only in local mode, when it is unset (tests), a fresh
    local folder is created and registered.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # no SparkContext handle (Connect): the configured folder only
        d = spark.conf.get("spark.checkpoint.dir", None)
        if not d:
            raise RuntimeError("spark.checkpoint.dir is not set: point it at shared storage")
        return d
    d = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir", None)
    if not d:
        d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: point it at shared storage "
                               "(a folder every executor can read and write)")
        d = tempfile.mkdtemp(prefix="blockflow-ckpt-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(d)
    return d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, never reused path under the shared checkpoint folder."""
    base = checkpoint_dir(spark)
    return os.path.join(base, "blockflow-scratch", f"{name}-{uuid.uuid4().hex}")


def cluster_settings(input_bytes: int, total_cores: int) -> dict[str, str]:
    """Starting values for a job reading ``input_bytes`` on ``total_cores``.

    About 200 MB of shuffle input per initial shuffle partition (AQE then
    coalesces towards the advisory size and splits skewed partitions), at
    least two waves of tasks, larger scan splits for very large inputs, and a
    broadcast threshold that keeps broadcast tables well inside executor
    memory.
    """
    parts = max(2 * total_cores, -(-input_bytes // (200 << 20)))
    split = (512 << 20) if input_bytes > (10 << 40) else (256 << 20) if input_bytes > (1 << 40) else (128 << 20)
    return {
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.files.maxPartitionBytes": str(split),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(256 << 20),
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(512 << 20),
        "spark.sql.autoBroadcastJoinThreshold": str(64 << 20),
    }
