"""What the training-data operators share: reading, cutting lineage, two-level running sums."""

from __future__ import annotations

import gc
import re
import tempfile
import time
import uuid

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: One run of the white space that the operators' contracts name: space, tab to carriage return.
SPACES = r"[\x20\x09-\x0D]+"
#: Most rows and bytes of an Arrow batch.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_or_empty() -> Column:
    return F.coalesce(F.col("text"), F.lit(""))


def _folder(sc: SparkContext) -> str:
    if sc.getCheckpointDir() is None:
        shared = sc.getConf().get("spark.checkpoint.dir")
        if not shared and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="quillframe-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and read again from the checkpoint folder that all executors share.

    The folder is the session's spark.checkpoint.dir. Where that is unset, a session on one machine, as
    in tests, gets a local one, and any other an error. Spark removes the files when no plan refers to
    them any more.
    """
    _folder(df.sparkSession.sparkContext)
    return df.checkpoint(eager=True)


def refuse(df: DataFrame, *names: str) -> None:
    """An error if df has a column of one of these names, which the caller is about to add."""
    if clash := {n.lower() for n in names} & {c.lower() for c in df.columns}:
        raise ValueError(f"the input has columns {sorted(clash)}")


def scratch_path(spark: SparkSession) -> str:
    """A new name for a table in the folder that all executors share."""
    return f"{_folder(spark.sparkContext)}/quillframe-{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """df, written once as a compressed table beside the checkpoints, for results too large for cut().

    The folder is the shared one; the files stay until it is emptied.
    """
    spark, path = df.sparkSession, scratch_path(df.sparkSession)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.quillframe_path = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes a table that materialise() wrote and no plan reads any more; other tables stay."""
    if path := getattr(df, "quillframe_path", None):
        jvm, sc = df.sparkSession._jvm, df.sparkSession.sparkContext
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)


def arrow_bounds(df: DataFrame) -> DataFrame:
    """df, after bounding the Arrow batches of its session, as batches of long texts need memory in proportion."""
    conf = df.sparkSession.conf
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        held = re.fullmatch(r"(\d+)b?", conf.get(key))
        if not held or not 0 < int(held[1]) <= most:
            conf.set(key, str(most))
    return df


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of plans that nothing refers to any more.

    The first round frees the driver's plans, the second what they held; Spark deletes meanwhile.
    """
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


def fan_out(df: DataFrame) -> int:
    """Partitions for keyed Python stages: the session's shuffle partitions, which the cluster sets."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def two_level_sum(df: DataFrame, group: list[str], bucket: str, order: list[str], value: Column, out: str) -> DataFrame:
    """Exclusive running sum of value within each group, without one task holding a whole group.

    Rows are summed within (group, bucket); the bucket totals, as few as there are buckets, are
    summed in bucket order and joined back. With about sqrt(rows) buckets both levels grow with
    the square root of the largest group. Null group keys count as a key.
    """
    inner = Window.partitionBy(*group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    base = df.groupBy(*group, bucket).agg(F.sum(value).alias("__in_bucket"))
    base = base.select(
        *[F.col(g).alias(f"__g{i}") for i, g in enumerate(group)],
        F.col(bucket).alias("__bucket"),
        F.coalesce(F.sum("__in_bucket").over(outer), F.lit(0)).alias("__base"),
    )
    rows = df.withColumn("__within", F.coalesce(F.sum(value).over(inner), F.lit(0)))
    on = (F.col(bucket) == F.col("__bucket"))
    for i, g in enumerate(group):
        on = on & F.col(g).eqNullSafe(F.col(f"__g{i}"))
    return rows.join(base, on).withColumn(out, F.col("__base") + F.col("__within")).drop(
        "__base", "__within", "__bucket", *[f"__g{i}" for i in range(len(group))]
    )
