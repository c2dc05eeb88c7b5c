"""Scoring texts by a gated recurrent language model learned from the corpus.

Counts of all training tokens come first. The most frequent words, the end token and a
token for all other words are the network's vocabulary; another word has the network's
probability of that token times its smoothed share of the other words. The network
learns in rounds: each task trains a copy on all its documents of the round, and the
copies are averaged, weighted by their tokens. Each training document is in one round.

Counts reach the texts in two ways: those of the most frequent words are sent to every
task, up to a fixed number; those of other words are joined to the documents that have
them. Only the network and its vocabulary, whose size is fixed, pass through the driver.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.llm import gru
from attestra.llm.common import SharedDict, documents_of, map_arrow, materialize

SHAPE = gru.Shape(hidden=32, classes=64, width=64)
RARE, END = 0, 1
#: Words whose counts are sent to every task, at some 100 bytes each.
KNOWN_WORDS = 300_000
#: Tokens that a task packs into lanes at once, about; and words it counts before it sends counts on.
PACK_TOKENS = 1_000_000
COUNTED = 400_000
#: Training tokens of a task and round, about, whatever the input's partitions: so many updates has each copy.
TASK_TOKENS = 1_000_000
ROUNDS = 4
SMOOTHING = 0.5
END_WORD = b"\n"


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split()


def id_hash(column: Column) -> Column:
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary"))


def count_words(texts: DataFrame) -> DataFrame:
    """(word, c) over all texts; the end token is the word ``END_WORD``, which no text has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                counts.update(words_of(text))
            counts[END_WORD] += batch.num_rows
            if len(counts) > COUNTED:
                yield _counts(counts)
                counts = Counter()
        yield _counts(counts)

    return map_arrow(texts, "word binary, c long", run).groupBy("word").agg(F.sum("c").alias("c"))


def _counts(counts: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "c"])


@dataclass(frozen=True)
class Counts:
    n: int
    distinct: int
    #: words known to every task, by rank of frequency, and their counts
    known: dict[bytes, int]
    known_counts: np.ndarray
    #: of words that the network has only as ``RARE``
    rare_n: int
    rare_distinct: int
    network_counts: np.ndarray
    n_end: int

    @property
    def base_log(self) -> float:
        return math.log10(self.n + SMOOTHING * (self.distinct + 1))

    @property
    def rare_log(self) -> float:
        return math.log10(self.rare_n + SMOOTHING * (self.rare_distinct + 1))


def frequent(counted: DataFrame, most: int, column: str = "c", tie: str = "word") -> DataFrame:
    """The ``most`` rows with the greatest counts, ties by the least hash of ``tie``.

    Histograms of the logarithms of counts, then of the counts of one bin of it, then of the
    hashes of one count, say where to cut: a few hundred rows each, or as many as a bin has
    counts, and nothing is sorted.
    """
    counts = F.col(column)
    step = F.floor(F.log2(counts) * 16)
    least_bin, left = _cut(counted, step, most)
    if least_bin is None:
        return counted
    cut = counted.filter(step == least_bin)
    least, left = _cut(cut, counts, left)
    part = F.floor(F.pmod(F.xxhash64(tie), F.lit(TIE_PARTS)))
    last, left = _cut(cut.filter(counts == least), -part, left)
    return counted.filter((step > least_bin) | ((step == least_bin) & ((counts > least) | ((counts == least) & (-part > last)))))


#: Parts into which rows of one count are dealt by their hash; the last part is left out whole, so up to a part's rows fewer are taken.
TIE_PARTS = 1 << 12


def _cut(rows: DataFrame, value: Column, most: int) -> tuple[int | None, int]:
    """(the greatest value whose rows, with those of greater values, are more than ``most``, or none; how many of its rows still fit)."""
    bins = sorted(((r["v"], r["n"]) for r in rows.groupBy(value.cast("long").alias("v")).agg(F.count("*").alias("n")).collect()), reverse=True)
    for v, n in bins:
        if n > most:
            return v, most
        most -= n
    return None, most


def gather(counted: DataFrame, shape: gru.Shape, known_words: int) -> Counts:
    """Totals, and up to ``known_words`` of the most frequent words (ties by word)."""
    n, distinct = counted.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    n_end = next((r["c"] for r in counted.filter(F.col("word") == END_WORD).collect()), 0)
    top = frequent(counted.filter(F.col("word") != END_WORD), known_words)
    rows = sorted(((bytes(r["word"]), r["c"]) for r in top.toLocalIterator()), key=lambda x: (-x[1], x[0]))
    own = min(shape.vocabulary - 2, len(rows))
    network = np.zeros(shape.vocabulary)
    network[END] = n_end
    network[2 : 2 + own] = [c for _, c in rows[:own]]
    network[RARE] = n - network.sum()
    counts = np.array([c for _, c in rows], dtype=np.float64)
    return Counts(n, distinct, {w: k for k, (w, _) in enumerate(rows)}, counts, int(network[RARE]), max(0, distinct - 1 - own), network, n_end)


def _packs(batches: Iterator[pa.RecordBatch], column: int, known: dict, own: int, scored: bool = True) -> Iterator[tuple[list, list]]:
    """(rows, network ids of their texts) in packs of about ``PACK_TOKENS`` tokens; a row, if ``scored``, is (batch without its texts, place, number of words, known ranks, unknown words with their numbers)."""
    rows, ids, size = [], [], 0
    for batch in batches:
        texts = batch.column(column).to_pylist()
        batch = batch.drop_columns(batch.schema.names[column]) if scored else None
        for k, text in enumerate(texts):
            words = words_of(text)
            ranks = np.fromiter(map(known.get, words, repeat(-1)), dtype=np.int32, count=len(words))
            got = np.full(len(words) + 1, END, dtype=np.int32)
            got[:-1] = np.where((ranks >= 0) & (ranks < own), ranks + 2, RARE)
            if scored:
                rows.append((batch, k, len(words), ranks[ranks >= 0], Counter(map(words.__getitem__, np.flatnonzero(ranks < 0).tolist()))))
            ids.append(got)
            size += len(got)
            if size >= PACK_TOKENS:
                yield rows, ids
                rows, ids, size = [], [], 0
    if ids:
        yield rows, ids


def share(spark: SparkSession, known: dict[bytes, int]) -> SharedDict:
    return SharedDict.of(spark, pa.array(list(known), pa.binary()), pa.array(list(known.values()), pa.int32()))


#: Bytes of a network that meet those of its other copies, and go to the driver, as one row; of whole 4-byte numbers.
BLOCK_BYTES = 1 << 14


def average(models: DataFrame, start: np.ndarray, n_parts: int) -> np.ndarray:
    """The mean of the copies (flat, tokens), weighted by their tokens."""
    places = F.sequence(F.lit(0), F.lit(-(-start.nbytes // BLOCK_BYTES) - 1))
    cut = F.transform(places, lambda k: F.substring("flat", k * BLOCK_BYTES + 1, F.lit(BLOCK_BYTES)))
    return average_blocks(models.select(F.posexplode(cut).alias("block", "data"), "tokens"), start, n_parts)


BLOCKS = "block int, data binary, tokens long"
#: Blocks that go to the JVM, or come from it, at once.
BLOCK_ROWS = 64


def blocks_of(flat: np.ndarray, tokens: int) -> Iterator[pa.RecordBatch]:
    """A copy as rows of ``BLOCKS``; whole, it would be a large object in each place that it passes."""
    data = [flat[at : at + BLOCK_BYTES // 4].tobytes() for at in range(0, len(flat), BLOCK_BYTES // 4)]
    for at in range(0, len(data), BLOCK_ROWS):
        part = data[at : at + BLOCK_ROWS]
        yield pa.RecordBatch.from_arrays([pa.array(range(at, at + len(part)), pa.int32()), pa.array(part, pa.binary()), pa.array([tokens] * len(part), pa.int64())], names=["block", "data", "tokens"])


def average_blocks(blocks: DataFrame, start: np.ndarray, n_parts: int) -> np.ndarray:
    """The mean of the copies, summed block by block in ``n_parts`` tasks; the driver gets a row for each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, int]] = {}
        for batch in batches:
            for k, data, n in zip(*(c.to_pylist() for c in batch.columns)):
                total, tokens = held.get(k, (0.0, 0))
                held[k] = total + n * np.frombuffer(data, dtype=np.float32).astype(np.float64), tokens + n
        means = [(total / tokens).astype(np.float32).tobytes() for total, tokens in held.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array(means, pa.binary())], names=["block", "mean"])

    out, step = start.copy(), BLOCK_BYTES // 4
    for r in map_arrow(blocks.repartition(n_parts, "block"), "block int, mean binary", run, BLOCK_ROWS).collect():
        out[r["block"] * step : (r["block"] + 1) * step] = np.frombuffer(r["mean"], dtype=np.float32)
    return out


def train(texts: DataFrame, counts: Counts, known: SharedDict, shape: gru.Shape, rounds: int) -> np.ndarray:
    """The network after all rounds; ``texts`` has (text, round, h). Its partitions play no part."""
    spark = texts.sparkSession
    flat = gru.initial(shape, counts.network_counts)
    own_words = shape.vocabulary - 2
    n_parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // 4)
    n_tasks = max(1, round(counts.n / rounds / TASK_TOKENS))
    order = ("h", F.xxhash64("text"))
    for k in range(rounds):
        start = spark.sparkContext.broadcast(flat)

        def run(batches: Iterator[pa.RecordBatch], start=start) -> Iterator[pa.RecordBatch]:
            own, tokens = start.value.copy(), 0
            squares = np.full_like(own, 1e-4)
            for _, ids in _packs(batches, 0, known.value, own_words, scored=False):
                gru.train(own, squares, shape, ids)
                tokens += sum(map(len, ids))
            if tokens:
                yield from blocks_of(own, tokens)

        models = map_arrow(texts.filter(F.col("round") == k).repartition(n_tasks, *order).sortWithinPartitions(*order).select("text"), BLOCKS, run)
        flat = average_blocks(models, flat, n_parts)
        start.destroy()
    return flat


FIRST = "row_doc long, held_out boolean, n_tokens long, n_known long, base double, network double, rare double, n_rare long, others array<struct<word:binary,n:int>>"


def first_pass(docs: DataFrame, counts: Counts, known: SharedDict, flat: np.ndarray, shape: gru.Shape) -> DataFrame:
    """Sums of each text over the words known to every task, the network's log10 probability, and the other words with their numbers."""
    sc = docs.sparkSession.sparkContext
    model, logs_of = sc.broadcast(flat), sc.broadcast(np.log10(counts.known_counts + SMOOTHING))
    own, end_log, end_known = shape.vocabulary - 2, math.log10(counts.n_end + SMOOTHING), int(counts.n_end > 0)
    names = [x.split()[0] for x in FIRST.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs = logs_of.value
        for rows, ids in _packs(batches, 1, known.value, own):
            network = gru.score(model.value, shape, ids) / math.log(10)
            out, words_out, numbers, ends = [], [], [], [0]
            for k, (batch, place, n_words, seen, others) in enumerate(rows):
                rare = seen[seen >= own]
                words_out += others.keys()
                numbers += others.values()
                ends.append(len(words_out))
                base = float(logs[seen].sum()) + end_log
                out.append((batch.column(0)[place].as_py(), batch.column(1)[place].as_py(), n_words + 1, len(seen) + end_known, base, float(network[k]), float(logs[rare].sum()), len(rare)))
            kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64())
            columns = [pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)]
            pairs = pa.StructArray.from_arrays([pa.array(words_out, pa.binary()), pa.array(numbers, pa.int32())], names=["word", "n"])
            whole = pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)], names=names)
            for at in range(0, whole.num_rows, 1000):
                yield whole.slice(at, 1000)

    return map_arrow(docs, FIRST, run)


def lm_scores(df: DataFrame, shape: gru.Shape = SHAPE, known_words: int = KNOWN_WORDS, rounds: int = ROUNDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row.

    Documents whose crc32 of the id, as text, leaves 1 modulo 5 are held out (a null id
    counts as empty text). A null or empty text is the end token alone. Rows with the
    same id stay apart. Whole texts are scored, however long; other columns play no part.
    Without training documents all counts are 0, the logarithms are those of the smoothing
    alone, and the network is as it begins. What is learned depends on the texts and their
    ids, not on the input's partitions.
    """
    docs = documents_of(df, id_col, text_col).withColumn("h", id_hash(F.col("doc_id"))).withColumn("held_out", F.col("h") % 5 == 1)
    training = docs.filter(~F.col("held_out")).select("text", "h", (F.floor(F.col("h") / 5) % rounds).cast("int").alias("round"))
    counted = materialize(count_words(training.select("text")))
    counts = gather(counted, shape, known_words)
    # one for both, as a worker would hold two while it changes from one to the other
    known = share(df.sparkSession, counts.known)
    flat = train(training, counts, known, shape, rounds)
    first = first_pass(docs.select("doc_id", "text", "held_out"), counts, known, flat, shape)
    rows = materialize(first.withColumn("row", F.monotonically_increasing_id()))
    others = rows.select("row", F.explode("others").alias("o")).select("row", "o.word", "o.n")
    log = F.log10(F.coalesce("c", F.lit(0)) + SMOOTHING)
    joined = others.join(counted, "word", "left").select("row", "n", (log * F.col("n")).alias("log"), F.when(F.col("c") > 0, F.col("n")).otherwise(0).alias("seen"))
    more = joined.groupBy("row").agg(F.sum("log").alias("more"), F.sum("seen").alias("more_known"), F.sum("n").alias("more_n"))
    zero = lambda x: F.coalesce(x, F.lit(0))
    base = F.col("base") + zero("more") - F.col("n_tokens") * F.lit(counts.base_log)
    score = F.col("network") + F.col("rare") + zero("more") - (F.col("n_rare") + zero("more_n")) * F.lit(counts.rare_log)
    return rows.drop("others").join(more, "row", "left").select(
        F.col("row_doc").alias("doc_id"), "held_out", "n_tokens", (F.col("n_known") + zero("more_known")).cast("long").alias("n_known"),
        F.lit(counts.n).cast("long").alias("train_tokens"), base.alias("base_score"), score.alias("score"),
    )
