"""Session defaults and the shared folder for anything a job has to write."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(master: str | None = None, app: str = "larder", **conf) -> SparkSession:
    """A session with the settings the planners like; a cluster's own settings win."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # one Arrow row is a whole series in the folds, so keep the batches small
        "spark.sql.execution.arrow.maxRecordsPerBatch": "2048",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder below `spark.checkpoint.dir`.

    Where the setting is absent (tests on one machine) a temporary folder stands in and
    is recorded in the session, so that later calls agree on it.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
        root = tempfile.mkdtemp(prefix="larder-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def settle(table: DataFrame, purpose: str) -> DataFrame:
    """Write a table to the shared folder and read it back.

    For results that several later steps read: they are worked out once, and a lost
    executor costs the tasks it ran rather than the whole lineage. What was exchanged for
    it is removed at once, not when the driver next collects its garbage.
    """
    spark = table.sparkSession
    folder, before = shared_folder(spark, purpose), spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        table.write.parquet(folder)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.parquet(folder)
