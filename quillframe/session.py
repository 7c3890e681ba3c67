"""SparkSession builder with the settings the plans are written for."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "quillframe", cores: int | None = None, **extra: str) -> SparkSession:
    """A local session for tests and benches. On a cluster the caller brings its own session."""
    n = cores or os.cpu_count() or 4
    conf = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": str(n),
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | extra
    return SparkSession.builder.master(f"local[{n}]").appName(app).config(map=conf).getOrCreate()


def scratch(spark: SparkSession) -> str:
    """A folder that all executors share: spark.checkpoint.dir. Only a session on one machine may lack it, and gets a local one."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if shared:
        return shared
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return tempfile.mkdtemp(prefix="quillframe-")


def checkpointed(df: DataFrame) -> DataFrame:
    """df, computed once and read again from files that all executors share; Spark deletes them when no plan needs them."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(scratch(df.sparkSession))
    return df.checkpoint(eager=True)
