"""Token files: ids of all documents in ascending doc_id order, range-coded in independent, checksummed blocks.

A file holds segments, one for each row: the documents of a stretch of doc_ids with their numbers of ids, and their
ids as blocks of ``range_coder``. Segments end with a document and hold about ``SEGMENT`` ids; a torn or altered block
is found by its checksum and costs no other block. The order of segments is (shard, segment): documents are
range-partitioned by doc_id, and each shard is one task's stretch.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanmill.llm.range_coder import BLOCK, BrokenBlock, decode_blocks, encode_blocks
from spanmill.llm.tasks import Batches, find_library, in_arrow
from spanmill.llm.tokenizing import encoder, groups
from spanmill.session import broadcast_if_small

SEGMENT = 4 << 20
MAGIC = b"TIDS1\x00\x00\x00"
_SCHEMA = pa.schema([("shard", pa.int64()), ("segment", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("content", pa.binary())])
_COLUMNS = "shard bigint, segment bigint, n_docs bigint, n_tokens bigint, content binary"


def pack_segment(doc_ids: np.ndarray, missing: np.ndarray, counts: np.ndarray, ids: np.ndarray, limit: int) -> bytes:
    """One segment: magic, limit, numbers of documents and blocks, index with checksum, block sizes, blocks."""
    blocks = encode_blocks([ids[i : i + BLOCK] for i in range(0, len(ids), BLOCK)], limit)
    index = doc_ids.astype("<i8").tobytes() + missing.astype("u1").tobytes() + counts.astype("<i8").tobytes()
    sizes = np.array([len(b) for b in blocks], "<u4").tobytes()
    head = np.array([limit, len(doc_ids), len(blocks), zlib.crc32(index + sizes)], "<u4").tobytes()
    return b"".join([MAGIC, head, index, sizes, *blocks])


def open_segment(content: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes], int]:
    """doc_ids, which of them are missing, counts, coded blocks and the limit of ids of a segment."""
    if content[:8] != MAGIC:
        raise BrokenBlock("not a token segment")
    limit, n_docs, n_blocks, check = np.frombuffer(content, "<u4", 4, 8).tolist()
    end = 24 + 17 * n_docs + 4 * n_blocks
    if zlib.crc32(content[24:end]) != check:
        raise BrokenBlock("the index does not have its checksum")
    doc_ids = np.frombuffer(content, "<i8", n_docs, 24)
    missing = np.frombuffer(content, "u1", n_docs, 24 + 8 * n_docs).astype(bool)
    counts = np.frombuffer(content[24 + 9 * n_docs : 24 + 17 * n_docs], "<i8")
    ends = end + np.cumsum(np.frombuffer(content[24 + 17 * n_docs : end], "<u4").astype(np.int64))
    starts = np.concatenate([[end], ends])[:-1]
    return doc_ids, missing, counts, [content[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], limit


def write_token_files(docs: DataFrame, path: str, vocabulary: str, end_id: int, keeps_space: bool = False) -> None:
    """Encode every text of ``docs`` (doc_id, text), with ``end_id`` after it, and write the files under ``path``.

    Null texts are empty; rows without doc_id come first, rows that share one in the order of their text's hash.
    """
    spark = docs.sparkSession
    find_library(spark)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Batches) -> Batches:
        own = encoder(vocabulary, keeps_space)
        limit = max(own.tokenizer.get_vocab_size(), end_id + 1)
        end = np.uint32(end_id)
        ids_held, counts_held, docs_held, missing_held, held, segment, shard = [], [], [], [], 0, 0, 0

        def close() -> pa.RecordBatch:
            doc_ids, missing, counts, ids = (np.concatenate(x) for x in (docs_held, missing_held, counts_held, ids_held))
            content = pack_segment(doc_ids, missing, counts, ids, limit)
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((shard, segment, len(doc_ids), len(ids), content), _SCHEMA.types, strict=True)], schema=_SCHEMA)

        for batch in batches:
            shard = batch.column("shard")[0].as_py() if len(batch) else shard
            numbers, texts = batch.column("doc_id"), batch.column("text")
            for begin, stop in groups(texts):
                ids, counts = own.encode_column(texts.slice(begin, stop - begin))
                numbers_here = numbers.slice(begin, stop - begin)
                ids_held.append(np.insert(ids, np.cumsum(counts), end))
                counts_held.append(counts + 1)
                docs_held.append(numbers_here.fill_null(0).to_numpy())
                missing_held.append(numbers_here.is_null().to_numpy(zero_copy_only=False))
                held += len(ids) + len(counts)
                if held >= SEGMENT:
                    yield close()
                    ids_held, counts_held, docs_held, missing_held, held, segment = [], [], [], [], 0, segment + 1
        if held:
            yield close()

    rows = docs.select("doc_id", "text").repartitionByRange(tasks, "doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    in_arrow(rows.withColumn("shard", F.spark_partition_id().cast("long")), run, _COLUMNS).write.parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids (binary, 32 bits each), decoded from the files.

    A block whose ids do not have its checksum ends the job. No files' worth of ids is shuffled: every task decodes the
    segments that it reads, and only the counts meet the numbers of ids before them.
    """
    files = spark.read.schema(_COLUMNS).parquet(path)
    schema = pa.schema([("shard", pa.int64()), ("segment", pa.int64()), ("within", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def run(batches: Batches) -> Batches:
        for batch in batches:
            for shard, segment, content in zip(batch.column("shard").to_pylist(), batch.column("segment").to_pylist(), batch.column("content"), strict=True):
                doc_ids, missing, counts, blocks, limit = open_segment(content.as_buffer().to_pybytes())
                ids = np.concatenate(decode_blocks(blocks, limit)).astype("<u4")
                ends = np.cumsum(counts)
                n = len(doc_ids)
                offsets = pa.array(np.concatenate([[0], 4 * ends]), pa.int64())
                data = pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, offsets.buffers()[1], pa.py_buffer(ids.tobytes())]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, shard)), pa.array(np.full(n, segment)), pa.array(ends - counts), pa.array(doc_ids, mask=missing), pa.array(counts), data], schema=schema
                )

    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("shard").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    shards = files.groupBy("shard").agg(F.sum("n_tokens").alias("n")).select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shard_start"))
    segments = files.select("shard", "segment", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)).alias("segment_start"))
    # One row for each segment of millions of ids; above its bound this falls back to a shuffle join.
    starts = broadcast_if_small(segments.join(shards, "shard").select("shard", "segment", (F.col("shard_start") + F.col("segment_start")).alias("first")))
    decoded = in_arrow(files.select("shard", "segment", "content"), run, "shard bigint, segment bigint, within bigint, doc_id bigint, n_tokens bigint, ids binary")
    return decoded.join(starts, ["shard", "segment"]).select("doc_id", (F.col("first") + F.col("within")).alias("start"), "n_tokens", "ids")


def token_report(docs: DataFrame, path: str, vocabulary: str, end_id: int) -> DataFrame:
    """Write the token files of ``docs`` to ``path`` and read from them doc_id, start, n_tokens and ids_crc32."""
    write_token_files(docs, path, vocabulary, end_id)
    return read_token_files(docs.sparkSession, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
