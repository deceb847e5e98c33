"""The shared folder of intermediate data."""

from __future__ import annotations

import tempfile


def checkpoint_dir(spark) -> str | None:
    """The cluster's shared checkpoint folder (``spark.checkpoint.dir``), if any."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        d = spark.sparkContext.getCheckpointDir()
    return d


def ensure_checkpoint_dir(spark, fallback: str) -> str:
    """Use the configured checkpoint folder; set ``fallback`` only when none is set
    (local runs and tests)."""
    d = checkpoint_dir(spark)
    if not d:
        spark.sparkContext.setCheckpointDir(fallback)
        d = spark.sparkContext.getCheckpointDir()
    return d


def shared_folder(spark) -> str:
    """The folder of intermediate data: the configured one; where none is set, a new one under /tmp
    for a local session, whose driver and executors are one process, and an error on a cluster."""
    folder = checkpoint_dir(spark)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = ensure_checkpoint_dir(spark, tempfile.mkdtemp(prefix="run-", dir="/tmp"))
    return folder.rstrip("/")
