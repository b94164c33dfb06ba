"""Operator 10: token ids as Simple-8b files, in ascending doc_id order, and back.

Null or empty text: the end id alone. Documents of equal (or null, which come
first) doc_id stand in the order of a hash of their text; equal rows are kept,
one after the other. An empty table gives an empty file set. Columns other
than id and text are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftwalk.llm import simple8b
from driftwalk.llm.common import runs, shuffle_partitions, two_columns

FRAME_SCHEMA = "shard int, frame_start long, n_ids long, doc_ids array<long>, lengths array<int>, payload binary"
DOC_SCHEMA = "shard int, doc_id long, shard_start long, n_tokens long, ids_crc32 long"
#: Bytes of text whose ids make a frame: what a worker holds at once, but for a longer text.
FRAME_BYTES = 2_000_000


def write_ids(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 0, partitions: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Files of frames below path. Each shard is a range of doc_ids; a frame holds whole documents."""
    n = partitions or shuffle_partitions(docs.sparkSession)
    tie = F.xxhash64("text")
    ordered = two_columns(docs, id_col, text_col).repartitionByRange(n, "doc_id", tie).sortWithinPartitions("doc_id", tie)
    sharded = ordered.select(F.spark_partition_id().alias("shard"), "doc_id", "text")

    def encode(batches):
        from driftwalk.llm.pieces import coder

        tool, start = coder(tokenizer_path), 0
        for batch in batches:
            for run in runs(batch, "text", FRAME_BYTES):
                flat, lengths = tool.encode(run.column("text").to_pylist())
                flat = np.insert(flat, np.cumsum(lengths), end_id)
                frame = {"shard": [run.column("shard")[0].as_py()], "frame_start": [start], "n_ids": [len(flat)], "doc_ids": [run.column("doc_id").to_pylist()], "lengths": [(lengths + 1).tolist()], "payload": [simple8b.encode(flat)]}
                start += len(flat)
                yield pa.RecordBatch.from_pydict(frame, FRAME_ARROW)

    sharded.mapInArrow(encode, FRAME_SCHEMA).write.parquet(path)


FRAME_ARROW = pa.schema([("shard", pa.int32()), ("frame_start", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int32())), ("payload", pa.binary())])
DOC_ARROW = pa.schema([("shard", pa.int32()), ("doc_id", pa.int64()), ("shard_start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FRAME_SCHEMA).parquet(path)


def _frames(batches):
    """Frames one by one, whatever their number in an Arrow batch."""
    for batch in batches:
        for at in range(batch.num_rows):
            yield batch.slice(at, 1).to_pylist()[0]


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the files: start counts the ids of all documents before.

    Only sums of shards meet in one task: as many rows as the writer had partitions.
    """
    def decode(batches):
        for row in _frames(batches):
            ids = simple8b.decode(row["payload"]).astype("<u4")
            lengths = np.array(row["lengths"], np.int64)
            ends = np.cumsum(lengths)
            raw, starts = memoryview(ids).cast("B"), ends - lengths
            sums = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_pydict({"shard": [row["shard"]] * len(sums), "doc_id": row["doc_ids"], "shard_start": (starts + row["frame_start"]).tolist(), "n_tokens": lengths.tolist(), "ids_crc32": sums}, DOC_ARROW)

    frames = read_frames(spark, path)
    totals = frames.groupBy("shard").agg(F.sum("n_ids").alias("ids"))
    before = F.coalesce(F.sum("ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = totals.select("shard", before.alias("before"))
    found = frames.select("shard", "frame_start", "doc_ids", "lengths", "payload").mapInArrow(decode, DOC_SCHEMA)
    return found.join(F.broadcast(offsets), "shard").select("doc_id", (F.col("before") + F.col("shard_start")).alias("start"), "n_tokens", "ids_crc32")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, ids) of each document, the end id included."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int64()))])

    def decode(batches):
        for row in _frames(batches):
            ids = simple8b.decode(row["payload"]).astype(np.int64)
            parts = np.split(ids, np.cumsum(row["lengths"])[:-1])
            yield pa.RecordBatch.from_pydict({"doc_id": row["doc_ids"], "ids": parts}, schema)

    return read_frames(spark, path).select("doc_ids", "lengths", "payload").mapInArrow(decode, "doc_id long, ids array<long>")
