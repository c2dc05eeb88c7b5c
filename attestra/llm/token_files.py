"""Token ids in Parquet files that can be read in part.

A row is a document: its id, the file's number, the ids before it in the file, the
number of its ids, and the ids as a list. Ids are dictionary-encoded (a vocabulary is
small against a row group), the other columns delta-encoded. Row groups and pages have
fixed sizes, and pages have indexes, so a reader of the numbers leaves the ids on disk,
and a reader of a range of documents reads the pages that hold it. Files follow each
other in ascending order of doc_id.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attestra.llm.common import documents_of, map_arrow
from attestra.llm.encoding import encoder

TOKENIZER = "byte_bpe_50k.json"
END_ID = 0
FILE_SCHEMA = "doc_id long, file int, before long, n_tokens long, ids array<int>"
ROW_GROUP_BYTES = 32 << 20
PAGE_BYTES = 256 << 10


def encode_sorted(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Rows of a sorted partition to rows of its file; ``before`` counts on from batch to batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, total, enc = TaskContext.get().partitionId(), 0, encoder(tokenizer)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                counts, ids = enc.encode(part.column(1))
                ids = np.insert(ids, np.cumsum(counts), end_id)
                bounds = np.concatenate([[0], np.cumsum(counts + 1)])
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids.view(np.int32)))
                files = pa.array(np.full(len(counts), file, dtype=np.int32))
                yield pa.RecordBatch.from_arrays([part.column(0), files, pa.array(total + bounds[:-1]), pa.array(counts + 1), lists], names=["doc_id", "file", "before", "n_tokens", "ids"])
                total += int(bounds[-1])

    return map_arrow(docs, FILE_SCHEMA, run)


def write_token_files(
    df: DataFrame, path: str, tokenizer: str = TOKENIZER, end_id: int = END_ID, n_files: int | None = None, id_col: str = "doc_id", text_col: str = "text",
    row_group_bytes: int = ROW_GROUP_BYTES, page_bytes: int = PAGE_BYTES,
) -> None:
    """Encode all texts (null: empty, so only ``end_id``) and write them in ascending doc_id order.

    Rows with the same id follow each other by a hash of the text; null ids come first.
    A range of ids goes to a file, so many rows of one id are split by that hash too. A text
    is one row, however long; other columns play no part.
    """
    docs = documents_of(df, id_col, text_col).withColumn("tie", F.xxhash64("text"))
    n_files = n_files or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = docs.repartitionByRange(n_files, "doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    (
        encode_sorted(ranged, tokenizer, end_id)
        .write.option("parquet.writer.version", "v2")
        .option("parquet.enable.dictionary", "false")
        .option("parquet.enable.dictionary#ids.list.element", "true")
        .option("parquet.block.size", row_group_bytes)
        .option("parquet.page.size", page_bytes)
        .option("parquet.dictionary.page.size", 4 << 20)
        .option("compression", "zstd")
        .parquet(path)
    )


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FILE_SCHEMA).parquet(path)


def file_starts(files: DataFrame) -> DataFrame:
    """(file, base): ids in all files before it; reads numbers only, one row per file."""
    totals = files.groupBy("file").agg(F.max(F.col("before") + F.col("n_tokens")).alias("total"))
    return totals.select("file", (F.sum("total").over(Window.orderBy("file")) - F.col("total")).alias("base"))


def checksums(files: DataFrame) -> DataFrame:
    """(doc_id, file, before, n_tokens, ids_crc32), from the ids as little-endian uint32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(4)
            offsets = ids.offsets.to_numpy().tolist()
            data = memoryview(ids.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False).view(np.uint8))
            crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(offsets, offsets[1:])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(crc, pa.int64())], names=[*batch.schema.names[:4], "ids_crc32"])

    return map_arrow(files, "doc_id long, file int, before long, n_tokens long, ids_crc32 long", run)


def token_file_digest(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, read back from the files."""
    files = read_token_files(spark, path)
    starts = F.broadcast(file_starts(files))
    return checksums(files).join(starts, "file").select("doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")
