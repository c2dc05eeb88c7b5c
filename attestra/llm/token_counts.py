"""Token counts of whole texts, with overlap resynchronisation for huge ones.

An ordinary text is encoded in its row. A huge one is cut into overlapping chunks, each
encoded with offsets by whatever task gets it, and the counts are spliced:

* The pre-tokenizer reads from left to right and what it does from a match's start
  depends only on the text from there on, up to one character beyond the match. So a
  boundary between matches that ends well inside a chunk (``MARGIN``) is a boundary of
  the whole text, if the chunk's reading was right before it.
* Where such a boundary also is one in the next chunk's own reading, both read alike
  from there on: a proven common boundary. Ids before it are counted in the one chunk,
  ids after it in the next.
* Where an overlap has no common boundary, the texts concerned are cut anew with wider
  overlaps and chunks, at last into one chunk.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attestra.llm.common import documents_of, map_arrow, materialize
from attestra.llm.encoding import encoder, load_tokenizer

TOKENIZER = "byte_bpe_50k.json"
HUGE_CHARS = 32_768
CHUNK_CHARS = 16_384
OVERLAP_CHARS = 512
#: Characters before a chunk's end whose boundaries are not trusted; longer than any added token.
MARGIN = 64
WIDEN = 16


def chunks(texts: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """(key, text) to (key, seq, start, last, piece); piece ``seq`` starts at ``seq * chunk`` and runs ``overlap`` into the next."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                n = max(1, -(-max(0, len(text) - overlap) // chunk))
                for seq in range(n):
                    start = seq * chunk
                    piece = text[start:] if seq == n - 1 else text[start : start + chunk + overlap]
                    yield pa.RecordBatch.from_pydict({"key": [key], "seq": pa.array([seq], pa.int32()), "start": pa.array([start], pa.int64()), "last": [seq == n - 1], "piece": [piece]})

    return map_arrow(texts, "key string, seq int, start long, last boolean, piece string", run)


READINGS = "key string, seq int, last boolean, n long, head array<long>, head_ids array<long>, tail array<long>, tail_ids array<long>"


def read_chunks(pieces: DataFrame, tokenizer: str, overlap: int) -> DataFrame:
    """For each chunk its ids' number, and in its first and last ``overlap`` characters the boundaries with the ids before them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = load_tokenizer(tokenizer)
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                e = tok.encode(row["piece"], add_special_tokens=False)
                words, offsets = e.word_ids, e.offsets
                size, seen = len(row["piece"]), []
                for k in range(1, len(words)):
                    at = offsets[k][0]
                    if (words[k] is None or words[k] != words[k - 1]) and offsets[k - 1][1] == at and (at < overlap or at >= size - overlap):
                        seen.append((at, k))
                head = [x for x in seen if x[0] < overlap] if row["seq"] else []
                tail = [] if row["last"] else [x for x in seen if size - overlap <= x[0] < size - MARGIN]
                start = row["start"]
                out.append({"key": row["key"], "seq": row["seq"], "last": row["last"], "n": len(words), "head": [start + x for x, _ in head], "head_ids": [k for _, k in head], "tail": [start + x for x, _ in tail], "tail_ids": [k for _, k in tail]})
            kinds = pa.schema([("key", pa.string()), ("seq", pa.int32()), ("last", pa.bool_()), ("n", pa.int64()), *((x, pa.list_(pa.int64())) for x in ("head", "head_ids", "tail", "tail_ids"))])
            yield pa.RecordBatch.from_pylist(out, schema=kinds)

    return map_arrow(pieces, READINGS, run)


def splice(readings: DataFrame) -> DataFrame:
    """(key, n_tokens, n_chunks); n_tokens is null where some overlap has no common boundary."""
    order = Window.partitionBy("key").orderBy("seq")
    at = F.array_min(F.array_intersect("tail", F.lead("head").over(order)))
    pairs = readings.select("key", "seq", "last", "n", "tail", "tail_ids", at.alias("at"), F.lead("head").over(order).alias("next"), F.lead("head_ids").over(order).alias("next_ids"))
    place = lambda values, ids: F.element_at(ids, F.array_position(values, F.col("at")).cast("int"))
    gain = F.when(F.col("last"), F.col("n")).when(F.col("at").isNotNull(), place(F.col("tail"), F.col("tail_ids")) - place(F.col("next"), F.col("next_ids")))
    sums = pairs.select("key", gain.alias("gain")).groupBy("key").agg(F.sum("gain").alias("n"), F.count("gain").alias("joined"), F.count("*").alias("n_chunks"))
    return sums.select("key", F.when(F.col("joined") == F.col("n_chunks"), F.col("n")).alias("n_tokens"), "n_chunks")


def count_huge(texts: DataFrame, tokenizer: str = TOKENIZER, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> DataFrame:
    """(key, text) with distinct keys to (key, n_tokens, n_chunks, overlap)."""
    done = []
    while True:
        if overlap <= MARGIN or chunk < 2 * overlap:
            raise ValueError("overlaps must be longer than MARGIN, and chunks twice as long")
        pieces = chunks(texts, chunk, overlap).repartition("key", "seq")
        found = materialize(splice(read_chunks(pieces, tokenizer, overlap)))
        done.append(found.filter(F.col("n_tokens").isNotNull()).withColumn("overlap", F.lit(overlap)))
        failed = found.filter(F.col("n_tokens").isNull()).select("key")
        if failed.isEmpty():
            return reduce(DataFrame.unionByName, done)
        texts = texts.join(failed, "key", "left_semi")
        overlap *= WIDEN
        chunk = max(chunk, 4 * overlap)


def count_ordinary(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                counts, _ = enc.encode(part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(counts, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    return map_arrow(docs.select("doc_id", "text", F.octet_length("text").cast("long").alias("n_bytes")), "doc_id long, n_bytes long, n_tokens long", run)


def token_counts(
    df: DataFrame, tokenizer: str = TOKENIZER, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text",
    huge_chars: int = HUGE_CHARS, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS,
) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, n_chunks (1: read as a whole) for each row.

    Counts are those of the tokenizer for the whole text. A null or empty text has 0
    tokens. Rows with the same id, or none, stay apart. Equal huge texts are encoded once.
    Other columns play no part.
    """
    docs = documents_of(df, id_col, text_col)
    ordinary = count_ordinary(docs.filter(F.length("text") <= huge_chars), tokenizer).withColumn("n_chunks", F.lit(1).cast("long"))
    huge = docs.filter(F.length("text") > huge_chars).withColumn("key", F.sha2("text", 256))
    texts = materialize(huge.groupBy("key").agg(F.first("text").alias("text")))
    if not texts.isEmpty():
        counts = count_huge(texts, tokenizer, chunk, overlap).select("key", "n_tokens", "n_chunks")
        sized = huge.select("doc_id", "key", F.octet_length("text").cast("long").alias("n_bytes"))
        ordinary = ordinary.unionByName(sized.join(counts, "key").select("doc_id", "n_bytes", "n_tokens", "n_chunks"))
    return ordinary.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "n_chunks")
