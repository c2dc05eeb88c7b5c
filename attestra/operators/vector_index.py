"""Nearest vectors: exact in blocks, and by an inverted file of lists around centroids.

Queries are a stated set and go to the tasks in blocks of a fixed number. A task reads its
vectors once for a block; matrix products say which can be among a query's k nearest, and
only those are measured exactly, entry by entry, so equal vectors are equally far. A task
sends k rows of a query at most.

The index deals all vectors into lists, by their nearest centroid; centroids are fitted
on a bounded sample. A query reads the lists of its nearest centroids alone. A list is a
folder of files, so a long one is read by many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Queries sent to the tasks at once; vectors, and queries of these, that are multiplied at once.
QUERY_BLOCK, ROWS, QUERIES = 4_096, 512, 256
#: Vectors, those with the least hashes of their ids, on which centroids are fitted.
SAMPLE_ROWS = 50_000
FIT_ROUNDS = 12
#: Pairs that a task holds at least before it forgets those beyond the k nearest.
HELD = 100_000
#: How far products may be off, as a share of the squared lengths.
SLACK = 1e-9


def matrix(vectors: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """(places, rows) of the vectors that are not null and have no null entry; they have one length."""
    lengths = vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    places = np.flatnonzero(lengths > 0)
    if len(np.unique(lengths[places])) > 1:
        raise ValueError("vectors have different lengths")
    rows = flat.reshape(len(places), -1) if len(places) else np.empty((0, 0))
    whole = ~np.isnan(rows).any(axis=1)
    return places[whole], rows[whole]


def exact_distances(a: np.ndarray, b: np.ndarray, rows: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of ``a`` numbered ``rows`` to those of ``b`` numbered ``others``, summed from the first entry to the last, an entry at a time."""
    out = np.zeros(len(rows))
    for j in range(a.shape[1]):
        out += np.square(a[rows, j] - b[others, j])
    return out


class Nearest:
    """The k nearest vectors so far of each of some queries."""

    def __init__(self, queries: np.ndarray, k: int):
        self.queries, self.k = queries, k
        self.squares = np.square(queries).sum(axis=1)
        self.bound = np.full(len(queries), np.inf)
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.n_held, self.most = 0, max(HELD, 2 * k * len(queries))

    def add(self, ids: np.ndarray, rows: np.ndarray, which: np.ndarray | None = None) -> None:
        """Compare vectors with all queries, or with those numbered ``which``."""
        which = np.arange(len(self.queries)) if which is None else which
        for at in range(0, len(rows), ROWS):
            part, numbers = rows[at : at + ROWS], ids[at : at + ROWS]
            for q in range(0, len(which), QUERIES):
                self._compare(numbers, part, which[q : q + QUERIES])

    def _compare(self, ids: np.ndarray, rows: np.ndarray, which: np.ndarray) -> None:
        """A block of vectors with a block of queries; the k-th nearest of the block bounds what is held of it from the start."""
        queries, squares = self.queries[which], self.squares[which]
        lengths = np.square(rows).sum(axis=1)
        about = lengths[:, None] + squares[None, :] - 2 * (rows @ queries.T)
        slack = SLACK * (squares + lengths.max(initial=0))
        if len(rows) >= self.k:
            self.bound[which] = np.fmin(self.bound[which], np.partition(about, self.k - 1, axis=0)[self.k - 1] + slack)
        row, query = np.nonzero(about <= (self.bound[which] + slack)[None, :])
        self.held.append((which[query], exact_distances(rows, queries, row, query), ids[row]))
        self.n_held += len(row)
        if self.n_held > self.most:
            self.settle()
            self.most = max(HELD, 2 * self.n_held)

    def settle(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query numbers, distances, ids) of the k nearest, ties by id; others are forgotten."""
        query, distance, ids = (np.concatenate(x) for x in zip(*self.held)) if self.held else (np.empty(0, dtype=int), np.empty(0), np.empty(0))
        order = np.lexsort((np.unique(ids, return_inverse=True)[1].ravel(), distance, query))
        query, distance, ids = query[order], distance[order], ids[order]
        rank = np.arange(len(query)) - np.searchsorted(query, query)
        keep = rank < self.k
        last = rank == self.k - 1
        self.bound[query[last]] = distance[last]
        self.held = [(query[keep], distance[keep], ids[keep])]
        self.n_held = int(keep.sum())
        return self.held[0]


def _found(nearest: Nearest, query_ids: list, kind: pa.DataType, vec_kind: pa.DataType) -> pa.RecordBatch:
    query, distance, ids = nearest.settle()
    return pa.RecordBatch.from_arrays([pa.array([query_ids[q] for q in query.tolist()], kind), pa.array(ids.tolist(), vec_kind), pa.array(distance, pa.float64())], names=["query_id", "vec_id", "distance"])


def _result(queries: DataFrame, vectors: DataFrame) -> T.StructType:
    return T.StructType([T.StructField("query_id", queries.schema["query_id"].dataType), T.StructField("vec_id", vectors.schema["vec_id"].dataType), T.StructField("distance", T.DoubleType())])


def ranked(candidates: DataFrame, k: int) -> DataFrame:
    """The k nearest of each query, of those that tasks have found: (query_id, vec_id, distance, rank)."""
    near = Window.partitionBy("query_id").orderBy("distance", "vec_id")
    return candidates.withColumn("rank", F.row_number().over(near)).filter(F.col("rank") <= k)


def query_blocks(queries: DataFrame, size: int) -> Iterator[pa.Table]:
    """(query_id, embedding) in blocks that hold about ``size``; the driver sees one at a time."""
    asked = queries.select("query_id", F.col("embedding").cast("array<double>").alias("embedding")).filter("embedding IS NOT NULL")
    blocks = max(1, -(-asked.count() // size))
    for b in range(blocks):
        yield (asked if blocks == 1 else asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)).toArrow()


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def nearest(queries: DataFrame, vectors: DataFrame, k: int, block: int = QUERY_BLOCK) -> DataFrame:
    """Exact: (query_id, embedding) and (vec_id, embedding) to (query_id, vec_id, distance, rank); null vectors are near to nothing."""
    source = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    schema, parts = _result(queries, vectors), []
    for asked in query_blocks(queries, block):
        places, rows = matrix(asked.column("embedding").combine_chunks())
        ids, kind = asked.column("query_id").take(pa.array(places)).to_pylist(), asked.schema.field("query_id").type
        sent = vectors.sparkSession.sparkContext.broadcast(rows)

        def run(batches: Iterator[pa.RecordBatch], sent=sent, ids=ids, kind=kind) -> Iterator[pa.RecordBatch]:
            best, vec_kind = Nearest(sent.value, k), pa.int64()
            for batch in batches:
                vec_kind = batch.column(0).type
                places, rows = matrix(batch.column(1))
                if len(places) and len(ids):
                    best.add(np.array(batch.column(0).to_pylist())[places], rows)
            if best.held:
                yield _found(best, ids, kind, vec_kind)

        parts.append(source.mapInArrow(run, schema))
    return ranked(_union(parts), k)


def fit_centroids(vectors: DataFrame, n_lists: int, sample_rows: int = SAMPLE_ROWS, rounds: int = FIT_ROUNDS) -> np.ndarray:
    """Centroids of the sample, by Lloyd's rounds from distinct vectors of it; fewer than ``n_lists`` if it has fewer distinct ones."""
    sample = vectors.select(F.col("embedding").cast("array<double>").alias("embedding"), F.xxhash64("vec_id").alias("h")).filter("embedding IS NOT NULL").orderBy("h").limit(sample_rows).toArrow()
    _, rows = matrix(sample.column("embedding").combine_chunks())
    distinct = np.unique(rows, axis=0)
    if not len(distinct):
        return rows
    centroids = distinct[np.random.default_rng(3).permutation(len(distinct))[:n_lists]]
    for _ in range(rounds):
        of = closest(rows, centroids, 1)[:, 0]
        sizes = np.bincount(of, minlength=len(centroids))
        sums = np.zeros_like(centroids)
        np.add.at(sums, of, rows)
        centroids = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], centroids)
    return centroids


def closest(rows: np.ndarray, centroids: np.ndarray, n: int) -> np.ndarray:
    """Numbers of the n nearest centroids of each row, nearest first."""
    out = np.empty((len(rows), min(n, len(centroids))), dtype=np.int64)
    squares = np.square(centroids).sum(axis=1)
    for at in range(0, len(rows), ROWS):
        about = squares[None, :] - 2 * (rows[at : at + ROWS] @ centroids.T)
        out[at : at + ROWS] = np.argsort(about, axis=1, kind="stable")[:, : out.shape[1]]
    return out


@dataclass(frozen=True)
class InvertedFile:
    """Centroids, and where the vectors lie by list."""

    spark: SparkSession
    path: str
    centroids: np.ndarray

    @staticmethod
    def build(vectors: DataFrame, path: str, n_lists: int, sample_rows: int = SAMPLE_ROWS) -> InvertedFile:
        """Every vector goes to the list of its nearest centroid; null vectors to none. Lists are written as folders; long ones by several tasks."""
        spark = vectors.sparkSession
        centroids = fit_centroids(vectors, n_lists, sample_rows)
        sent = spark.sparkContext.broadcast(centroids)
        source = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
        schema = T.StructType([*source.schema, T.StructField("list", T.IntegerType())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                places, rows = matrix(batch.column(1))
                if len(places):
                    kept = batch.take(pa.array(places))
                    yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(closest(rows, sent.value, 1)[:, 0], pa.int32())], names=schema.names)

        source.mapInArrow(run, schema).hint("rebalance", "list").write.partitionBy("list").parquet(path)
        return InvertedFile(spark, path, centroids)

    def read(self, lists: list[int] | None = None) -> DataFrame:
        rows = self.spark.read.parquet(self.path)
        return rows if lists is None else rows.filter(F.col("list").isin(lists))

    def search(self, queries: DataFrame, k: int, probes: int, block: int = QUERY_BLOCK) -> DataFrame:
        """(query_id, vec_id, distance, rank): the k nearest in the ``probes`` lists nearest to each query, with exact distances."""
        vectors = self.read()
        schema, parts = _result(queries, vectors), []
        for asked in query_blocks(queries, block):
            places, rows = matrix(asked.column("embedding").combine_chunks())
            ids, kind = asked.column("query_id").take(pa.array(places)).to_pylist(), asked.schema.field("query_id").type
            lists = closest(rows, self.centroids, probes) if len(self.centroids) and len(rows) else np.empty((0, 0), dtype=np.int64)
            query, of = np.nonzero(np.ones(lists.shape))
            probed = {int(c): query[lists[query, of] == c] for c in np.unique(lists)}
            sent = self.spark.sparkContext.broadcast((rows, probed))

            def run(batches: Iterator[pa.RecordBatch], sent=sent, ids=ids, kind=kind) -> Iterator[pa.RecordBatch]:
                (rows_of, probed), vec_kind = sent.value, pa.int64()
                best = Nearest(rows_of, k)
                for batch in batches:
                    vec_kind = batch.column(0).type
                    places, rows = matrix(batch.column(1))
                    of_list, vec_ids = batch.column(2).to_numpy()[places], np.array(batch.column(0).to_pylist())[places]
                    for c in np.unique(of_list):
                        if int(c) in probed:
                            best.add(vec_ids[of_list == c], rows[of_list == c], probed[int(c)])
                if best.held:
                    yield _found(best, ids, kind, vec_kind)

            parts.append(self.read(sorted(probed)).select("vec_id", "embedding", "list").mapInArrow(run, schema))
        return ranked(_union(parts), k)


def recall(found: DataFrame, exact: DataFrame) -> float:
    """The share of the exact (query_id, vec_id) pairs that were found."""
    n = exact.count()
    return found.select("query_id", "vec_id").join(exact.select("query_id", "vec_id"), ["query_id", "vec_id"], "left_semi").count() / n if n else 1.0
