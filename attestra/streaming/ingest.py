"""Incremental ingest and windowed counts with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from attestra.operators.chunking import Settings, chunk_blocks, manifest
from attestra.sources.documents import text_blocks


def stream_json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.readStream.schema(schema).json(path)


def ingest_documents(docs: DataFrame, out: str, checkpoint: str, project: str, settings: Settings = Settings()) -> StreamingQuery:
    """Streamed (doc_key, text) to chunk manifests, one folder per batch; a batch that runs again overwrites its own folder."""

    def write(batch: DataFrame, batch_id: int) -> None:
        chunks = chunk_blocks(text_blocks(batch.select("doc_key", "text")), settings)
        manifest(chunks, project, f"batch-{batch_id}").write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events per window and type, with a watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n")).select("w.start", "w.end", "event_type", "n")
