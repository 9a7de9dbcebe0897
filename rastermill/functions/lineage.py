"""Cutting lineage and scratch tables, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

_own_dirs: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """The folder that the session names for checkpoints; a folder of its own only where it names none (tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        app = spark.sparkContext.applicationId
        path = _own_dirs.get(app) or _own_dirs.setdefault(app, tempfile.mkdtemp(prefix="rastermill-"))
    return path.rstrip("/")


def cut_lineage(df: DataFrame) -> DataFrame:
    """A checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(scratch_dir(df.sparkSession))
    return df.checkpoint()
