"""Session defaults and lineage cuts."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def build_session(name: str = "weftline", **options: str) -> SparkSession:
    """A session with adaptive execution, UTC and Arrow on; ``options`` override."""
    conf = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    } | options
    return SparkSession.builder.appName(name).config(map=conf).getOrCreate()


def cut_lineage(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in spark.checkpoint.dir; a local folder is set only for a local master."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and context.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = folder or f"file://{tempfile.gettempdir()}/weftline-checkpoints"
        context.setCheckpointDir(folder)
    return df.checkpoint()
