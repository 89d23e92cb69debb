"""Session helpers: a local session for tests/bench, and a shared scratch folder.

Scratch data (stream checkpoints, upsert generations, lineage cuts) go under the
folder the cluster names in ``spark.checkpoint.dir``. Only when that setting is
absent (local tests) do we create one under the system temp folder and set it.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

_CKPT_KEY = "spark.checkpoint.dir"


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, app: str = "stagewatch") -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cpus}]")
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


def checkpoint_root(spark: SparkSession) -> str:
    """The shared checkpoint folder. A local one is set only in local mode, when none is configured;
    on a cluster a missing one is an error."""
    root = spark.conf.get(_CKPT_KEY, None)
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError(f"{_CKPT_KEY} names no folder; on a cluster it must be one that all executors share")
        root = tempfile.mkdtemp(prefix="stagewatch-ckpt-")
        spark.conf.set(_CKPT_KEY, root)
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh, never reused path under the shared checkpoint folder (not created:
    the writer that uses it creates it)."""
    root = checkpoint_root(spark)
    return f"{root}/stagewatch/{label}-{uuid.uuid4().hex}"
