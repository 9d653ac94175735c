"""Session settings and the shared work folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def get_session(app: str = "filecensus", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators rely on.

    AQE picks the number of reduce tasks and splits skewed join partitions at run time, so
    ``spark.sql.shuffle.partitions`` is only an upper bound and should be set generously
    on a cluster.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def work_dir(spark: SparkSession, label: str) -> str:
    """A new folder below ``spark.checkpoint.dir`` for written intermediate tables.

    Executors on other machines must see the folder, so a machine-local default is made up
    only for a local master; on a cluster the setting has to be there.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        base = os.path.join(tempfile.gettempdir(), "filecensus-work")
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"
