"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from functools import cache

from pyspark.sql import SparkSession


def build_session(app: str = "reviewatlas", cores: str | None = None) -> SparkSession:
    """A session for local runs. On a cluster the submitted configuration is used as it is."""
    builder = SparkSession.builder.appName(app)
    if cores is not None:
        builder = (
            builder.master(f"local[{cores}]")
            .config("spark.driver.memory", "12g")
            .config("spark.sql.shuffle.partitions", cores if cores.isdigit() else "8")
            .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "128k")
            .config("spark.ui.enabled", "false")
            .config("spark.ui.showConsoleProgress", "false")
        )
    spark = (
        builder.config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


@cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="reviewatlas-")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder named by ``spark.checkpoint.dir``.

    Only a local session without that setting falls back to a folder of its own, one per process: executors
    on other machines could not read it. The session's own settings are left alone.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
        base = _own_folder()
    return os.path.join(base, "reviewatlas", f"{name}-{uuid.uuid4().hex}")
