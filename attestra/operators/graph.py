"""Bounded traversal, closures and fixpoints over edge tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MAX_HOPS = 4
#: Spark then removes a statement's shuffle files when it ends.
CLEANUP_SETTING = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def clamp_hops(hops: int) -> int:
    return max(1, min(hops, MAX_HOPS))


def paths(starts: DataFrame, edges: DataFrame, hops: int) -> DataFrame:
    """Undirected paths of 1 to ``hops`` edges, none used twice: (anchor, node, edges, allowed).

    ``starts`` is (anchor, node); ``edges`` is (edge_id, source, target, allowed). Each
    hop is one join on the frontier's node.
    """
    there = edges.select("edge_id", F.col("source").alias("at"), F.col("target").alias("to"), "allowed")
    both = there.unionByName(edges.filter("source <> target").select("edge_id", F.col("target").alias("at"), F.col("source").alias("to"), "allowed"))
    front = starts.select("anchor", "node", F.array().cast("array<string>").alias("edges"), F.array().cast("array<string>").alias("allowed_edges"))
    out = None
    for _ in range(clamp_hops(hops)):
        step = front.join(both, F.col("node") == F.col("at")).filter(~F.array_contains("edges", F.col("edge_id")))
        more = F.when(F.col("allowed"), F.concat("allowed_edges", F.array("edge_id"))).otherwise(F.col("allowed_edges"))
        front = step.select("anchor", F.col("to").alias("node"), F.concat("edges", F.array("edge_id")).alias("edges"), more.alias("allowed_edges"))
        out = front if out is None else out.unionByName(front)
    return out


def graph_evidence(starts: DataFrame, edges: DataFrame, hops: int, limit: int) -> DataFrame:
    """Chunks of allowed edges on paths of 1 to ``hops`` edges from each anchor: (anchor, chunk_id, score, pos), the score 1 / hops.

    An edge is on such a path exactly if one of its ends is at most ``hops - 1`` edges away:
    a shortest way to the nearer end doesn't use the edge itself, and goes on with it. Order:
    score, the chunk's place in its document, then chunk_id; ``edges`` also has chunk_id and
    sequence_index. As all anchors order chunks alike, a node needs the first ``limit`` of
    what its neighbours have, so each level hands on ``limit`` rows an edge at most, and the
    pairs of a hub's neighbours are never made.
    """
    chunk = ["chunk_id", "sequence_index"]
    ways = F.array(*(F.struct(F.col(a).alias("node"), F.col(b).alias("to")) for a in ("source", "target") for b in ("source", "target")))
    ways = edges.select(F.explode(ways).alias("w")).select("w.*").distinct()  # to neighbours, and to itself
    near = first_chunks(edges.filter("allowed").select(F.explode(F.array_distinct(F.array("source", "target"))).alias("node"), *chunk), "node", limit)
    for _ in range(clamp_hops(hops) - 1):
        near = first_chunks(near.join(ways, "node").select(F.col("to").alias("node"), *chunk), "node", limit)
    found = first_chunks(starts.select("anchor", "node").distinct().join(near, "node").select("anchor", *chunk), "anchor", limit, "pos")
    return found.select("anchor", "chunk_id", F.lit(1.0 / hops).alias("score"), "pos")


def first_chunks(rows: DataFrame, key: str, limit: int, place: str = "_n") -> DataFrame:
    """(key, chunk_id, sequence_index, place): of each key its first ``limit`` chunks by their least place in their document, then chunk_id."""
    each = rows.groupBy(key, "chunk_id").agg(F.min("sequence_index").alias("sequence_index"))
    order = Window.partitionBy(key).orderBy("sequence_index", "chunk_id")
    kept = each.withColumn(place, F.row_number().over(order)).filter(F.col(place) <= limit)
    return kept.drop("_n")


def evidence_summary(edges: DataFrame) -> DataFrame:
    """Per chunk: best score, distinct sources then distinct targets, distinct edges."""
    return edges.groupBy("chunk_id").agg(F.max("confidence").alias("score"), F.concat(F.array_sort(F.collect_set("source")), F.array_sort(F.collect_set("target"))).alias("entity_ids"), F.array_sort(F.collect_set("edge_id")).alias("edge_ids"))


def neighbours(seeds: DataFrame, edges: DataFrame, depth: int, relations: tuple[str, ...] | None = None) -> DataFrame:
    """Directed breadth-first: (seed, node, depth) of the nodes reached, each at its least depth, seeds left out."""
    if relations:
        edges = edges.filter(F.col("relation").isin(*relations))
    edges = edges.select(F.col("source").alias("node"), F.col("target").alias("to")).distinct()
    seen = seeds.select("seed", F.col("seed").alias("node"), F.lit(0).alias("depth"))
    front = seen
    for k in range(1, clamp_hops(depth) + 1):
        reached = front.join(edges, "node").select("seed", F.col("to").alias("node")).distinct()
        front = reached.join(seen.select("seed", "node"), ["seed", "node"], "left_anti").withColumn("depth", F.lit(k))
        seen = seen.unionByName(front)
    return seen.filter("depth > 0")


def neighbours_in_order(seeds: DataFrame, edges: DataFrame, depth: int, place: str, relations: tuple[str, ...] | None = None) -> DataFrame:
    """``neighbours`` with ``way``, by which they are in the order of a breadth-first search that takes a node's edges by ``place``.

    A node's way is that of the node it was found from, then its edge's place. The search
    finds nodes by depth, then by way; of several ways to a node the least is its own. So the
    order needs no numbering of a level, and a hub's neighbours stay in many tasks.
    """
    if relations:
        edges = edges.filter(F.col("relation").isin(*relations))
    edges = edges.groupBy(F.col("source").alias("node"), F.col("target").alias("to")).agg(F.min(F.col(place).cast("long")).alias("_place"))
    seen = front = seeds.select("seed", F.col("seed").alias("node"), F.lit(0).alias("depth"), F.array().cast("array<bigint>").alias("way"))
    for k in range(1, clamp_hops(depth) + 1):
        reached = front.join(edges, "node").select("seed", F.col("to").alias("node"), F.concat("way", F.array("_place")).alias("way"))
        first = reached.groupBy("seed", "node").agg(F.min("way").alias("way"))
        front = first.join(seen.select("seed", "node"), ["seed", "node"], "left_anti").select("seed", "node", F.lit(k).alias("depth"), "way")
        seen = seen.unionByName(front)
    return seen.filter("depth > 0")


def merged_neighbours(seeds: DataFrame, edges: DataFrame, relations: tuple[str, ...], limit: int) -> DataFrame:
    """Direct neighbours of each seed with the relations that lead there, the first ``limit`` by node."""
    found = edges.filter(F.col("relation").isin(*relations)).join(seeds, F.col("source") == F.col("seed")).filter("target <> seed")
    grouped = found.groupBy("seed", F.col("target").alias("node")).agg(F.array_sort(F.collect_set("relation")).alias("relations"))
    order = Window.partitionBy("seed").orderBy("node")
    return grouped.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= limit).drop("n")


def closure(roots: DataFrame, references: DataFrame) -> DataFrame:
    """(root, record_id, round): all records reached by (from_id, to_id), in rounds until nothing is new.

    Each round is checkpointed in the session's shared folder, so plans do not grow and a
    lost executor costs one round. Each adds records to ``seen``, so the rounds end.
    """
    references = references.select(F.col("from_id").alias("record_id"), F.col("to_id").alias("next")).distinct()
    seen = front = durable(roots.select(F.col("root"), F.col("record_id"), F.lit(0).alias("round")).distinct())
    k = 0
    while not front.isEmpty():
        k += 1
        reached = front.join(references, "record_id").select("root", F.col("next").alias("record_id")).distinct()
        front = durable(reached.join(seen.select("root", "record_id"), ["root", "record_id"], "left_anti").withColumn("round", F.lit(k)))
        seen = seen.unionByName(front)
        if k % 10 == 0:
            seen = durable(seen)
    return seen


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir.

    Where the setting is missing, a folder of this machine is taken if the master is local,
    as in tests; on a cluster that is an error, as executors would not share it.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="attestra-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def durable(df: DataFrame) -> DataFrame:
    """``checkpoint()`` in the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """``df`` as a compressed table in the shared folder; the statement's shuffle files go when it ends.

    Unlike ``durable``'s rows, its columns take few bytes where they repeat.
    """
    spark = df.sparkSession
    path, before = f"{shared_folder(spark).rstrip('/')}/attestra-{uuid.uuid4().hex}", spark.conf.get(CLEANUP_SETTING)
    spark.conf.set(CLEANUP_SETTING, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP_SETTING, before)
    return spark.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """``df`` with its rows' places from 0 in ``order``, a total order: rows are sorted by ranges, and a range begins at the number of rows before it."""
    ranged = durable(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    parts = ranged.groupBy("_part").agg(F.count("*").alias("_n"))  # one row a partition
    before = parts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return ranged.join(F.broadcast(before), "_part").withColumn(name, own + F.col("_before")).drop("_part", "_before")


def closure_by_key(records: DataFrame, roots: DataFrame, leaves: DataFrame) -> DataFrame:
    """Closure over payload values under keys that end in _id or _ids; ``leaves`` is (record_id, key, value)."""
    refs = leaves.filter(F.col("key").endswith("_id") | F.col("key").endswith("_ids")).join(records.select(F.col("record_id").alias("value")), "value", "left_semi")
    return closure(roots, refs.select(F.col("record_id").alias("from_id"), F.col("value").alias("to_id")))


def closure_by_value(records: DataFrame, roots: DataFrame, leaves: DataFrame) -> DataFrame:
    """Closure over any payload string that is the id of a record."""
    refs = leaves.filter("kind = 'string'").join(records.select(F.col("record_id").alias("value")), "value", "left_semi")
    return closure(roots, refs.select(F.col("record_id").alias("from_id"), F.col("value").alias("to_id")))


def differences(expected: DataFrame, found: DataFrame) -> DataFrame:
    """Rows of either side that the other lacks, with their number: empty if both are equal as bags."""
    return expected.exceptAll(found).withColumn("side", F.lit("missing")).unionByName(found.exceptAll(expected).withColumn("side", F.lit("extra")))
