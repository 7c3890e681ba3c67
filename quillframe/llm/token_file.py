"""Token ids of documents as compressed files, and back.

write() sorts whole texts by doc_id into ranges, one a task, so that texts cross the network once and ids
never do. A task encodes its texts (bpe), appends the end id to each and packs whole documents into segments
of about SEGMENT ids, coded by range_coder in blocks that each have a reset model and a checksum. A row of
the written table is a segment; its file is Parquet, so Spark commits it whole, splits and retries it, and
sums of columns do not read the ids. Places in the files are counted from the file's first id; read() adds
what the files before hold, one number a file.

Defined cases: null and empty texts have the end id alone; null doc_ids come first; rows with equal doc_ids
are in the order of their texts' hashes, equal rows in that of their rows; a document longer than SEGMENT is
one segment, with many blocks; a block or directory that does not match its checksum is an error that names
it; an empty table gives files without segments; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillframe.llm import bpe, lanes
from quillframe.llm.common import arrow_bounds, documents, fan_out, scratch_path
from quillframe.llm.range_coder import Segment, pack

END_ID = 2
#: Ids of a segment, which is coded in one go, all its blocks in lockstep.
SEGMENT = 8 << 20
#: Bytes of texts that are encoded together.
TEXTS = 4 << 20
#: Ids that read() hands on at a time.
HANDED = 1 << 20
STORED = "file int, segment int, start long, n_ids long, n_docs long, body binary"


def _sorted(docs: DataFrame) -> DataFrame:
    order = ["doc_id", "__hash", "__row"]
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("__hash"), F.monotonically_increasing_id().alias("__row"))
    return rows.repartitionByRange(fan_out(docs), *order).sortWithinPartitions(*order).select("doc_id", "text")


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int | None], list[bytes]]]:
    """doc_ids and texts of about TEXTS bytes."""
    doc_ids, texts, held = [], [], 0
    for batch in batches:
        data, offsets = lanes.buffers(batch.column(1))
        for i, doc_id in enumerate(batch.column(0).to_pylist()):
            doc_ids.append(doc_id)
            texts.append(data[offsets[i] : offsets[i + 1]].tobytes())
            held += len(texts[-1])
            if held >= TEXTS:
                yield doc_ids, texts
                doc_ids, texts, held = [], [], 0
    if doc_ids:
        yield doc_ids, texts


def write(docs: DataFrame, folder: str, vocabulary: str, end_id: int = END_ID) -> None:
    """Encodes every text and writes the ids to folder, documents in rising order of doc_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, file = bpe.codec(vocabulary), TaskContext.get().partitionId()
        ids, doc_ids, lengths = [], [], []
        held = start = number = 0

        def segment() -> pa.RecordBatch:
            row = [[file], [number], [start], [held], [len(doc_ids)], [pack(doc_ids, lengths, np.concatenate(ids))]]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))], ["file", "segment", "start", "n_ids", "n_docs", "body"])

        for some, texts in _together(batches):
            part, sizes = own.many(texts)
            part, ends = np.insert(part, np.cumsum(sizes), end_id), np.cumsum(sizes + 1)
            at = 0
            while at < len(some):  # up to the document that fills the segment
                before = int(ends[at - 1]) if at else 0
                to = min(len(some), int(np.searchsorted(ends, before + SEGMENT - held)) + 1)
                ids.append(part[before : ends[to - 1]])
                doc_ids += some[at:to]
                lengths += (sizes[at:to] + 1).tolist()
                held, at = held + int(ends[to - 1]) - before, to
                if held >= SEGMENT:
                    yield segment()
                    start, number, held = start + held, number + 1, 0
                    ids, doc_ids, lengths = [], [], []
        if doc_ids:
            yield segment()

    _sorted(arrow_bounds(docs)).mapInArrow(run, STORED).write.parquet(folder)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before it) and ids, little-endian unsigned 32-bit integers in one binary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, body in zip(batch.column(0).to_pylist(), batch.column(1)):
                held = Segment(body.as_py())
                raw, ends = held.read().astype("<u4").tobytes(), np.cumsum(held.lengths)
                first, at = ends - held.lengths, 0
                while at < len(ends):
                    to = max(at + 1, int(np.searchsorted(ends, first[at] + HANDED, side="right")))
                    texts = [raw[4 * a : 4 * b] for a, b in zip(first[at:to].tolist(), ends[at:to].tolist())]
                    doc_ids = pa.array(held.doc_ids[at:to], pa.int64(), mask=~held.has_id[at:to])
                    yield pa.RecordBatch.from_arrays([doc_ids, pa.array(first[at:to] + start), pa.array(texts, pa.binary())], ["doc_id", "start", "ids"])
                    at = to

    rows = arrow_bounds(spark.read.schema(STORED).parquet(folder))
    files = rows.groupBy("file").agg(F.sum("n_ids").alias("n")).select(
        "file", F.coalesce(F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
    )  # a row for each task of write(), so of bounded size
    placed = rows.join(F.broadcast(files), "file").select((F.col("start") + F.col("before")).alias("start"), "body")
    return placed.mapInArrow(run, "doc_id long, start long, ids binary")


def op12_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark)
    write(documents(spark, sf_dir), folder, bpe.default_path())
    return read(spark, folder).select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
