"""An append-only log of JSON lines as a stream, and the latest state of each key.

The latest row of each key is a streaming aggregate, so it lives in Spark's state store: a row a key,
whatever the length of the log. A micro-batch writes the keys it touches, is run again from the same
version of the state after a failure, and the store drops versions that are no longer needed. current()
reads the store itself, so there is no second copy of the state to keep in step with the checkpoint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillframe.functions.parse import json_value
from quillframe.sources.files import is_object


def events(spark: SparkSession, path: str, schema: str, files_per_batch: int = 1000) -> DataFrame:
    """The log's rows as a stream; lines that are no JSON object are passed over."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(path)
    return lines.where(is_object(json_value(F.col("value")))).select(F.from_json("value", schema).alias("e")).select("e.*")


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """key, and row: of each key the row that is greatest by order, then by all columns; no task holds a key's rows."""
    rest = [c for c in df.columns if c not in order]
    key = F.struct(*[F.col(k).alias(f"key{i}") for i, k in enumerate(keys)])
    return df.groupBy(key.alias("key")).agg(F.max(F.struct(*order, *rest)).alias("row"))


def keep_latest(stream: DataFrame, checkpoint: str, keys: list[str], order: list[str]) -> StreamingQuery:
    """Starts the query that takes what the log has now into the state under checkpoint, and ends.

    The number of state partitions is fixed by the first run of a checkpoint: the session's shuffle
    partitions of that time.
    """
    out = latest(stream, keys, order).writeStream.outputMode("update").format("noop")
    return out.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, checkpoint: str, columns: list[str], batch: int | None = None) -> DataFrame:
    """columns of the latest row of each key, after the last batch that was committed or after the named one."""
    store = spark.read.format("statestore")
    store = store if batch is None else store.option("batchId", batch)
    return store.load(checkpoint).select("value.max.*").select(*columns)
