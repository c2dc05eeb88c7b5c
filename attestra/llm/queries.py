"""The queries of this package and their SQL, as ``__spark_entry__`` registers them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from attestra.llm.alignment import alignments
from attestra.llm.common import prepare, read_table, shared_dir
from attestra.llm.decontaminate import contaminated
from attestra.llm.langid import languages
from attestra.llm.licenses import license_scan
from attestra.llm.lm import lm_scores
from attestra.llm.minhash import near_duplicates
from attestra.llm.quality import quality_rules
from attestra.llm.sentencepiece import encode_documents
from attestra.llm.sharding import shard_documents
from attestra.llm.substring import repeated_passages
from attestra.llm.token_counts import token_counts
from attestra.llm.token_files import token_file_digest, write_token_files
from attestra.llm.whitening import whiten


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read_table(spark, sf_dir, "documents"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(read_table(spark, sf_dir, "documents")).drop("places")


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"), size=2)


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark)
    write_token_files(read_table(spark, sf_dir, "documents"), path)
    return token_file_digest(spark, path)


def op5_gru_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(read_table(spark, sf_dir, "documents"))


def op6_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(read_table(spark, sf_dir, "documents"))


def op7_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(read_table(spark, sf_dir, "documents"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(read_table(spark, sf_dir, "documents"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op10_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(read_table(spark, sf_dir, "documents"), n_shards=24, map_path=shared_dir(spark))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignments(read_table(spark, sf_dir, "documents"))


def op12_language_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages(read_table(spark, sf_dir, "documents"))


def op13_lobpcg_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(read_table(spark, sf_dir, "embeddings"))


QUERIES = (
    op1_token_counts, op2_license_scan, op3_minhash, op4_token_files, op5_gru_scores, op6_quality_cascade, op7_passages, op8_sentencepiece, op9_decontaminate, op10_virtual_slots,
    op11_token_alignment, op12_language_spans, op13_lobpcg_whitening,
)


def _prepared(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        prepare(spark)
        return query(spark, sf_dir)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {q.__name__: _prepared(q) for q in QUERIES} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {}
