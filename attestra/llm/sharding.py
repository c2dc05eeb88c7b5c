"""Sharding by fixed virtual slots.

A record's slot is a hash of its id modulo a fixed number of slots (thousands), which
never changes. Only the slot-to-shard map changes: it is a small versioned table, made
from the bytes of each slot and edited, slot by slot, when shards are added or removed.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attestra.llm.common import documents_of, materialize

N_SLOTS = 4096
RECORD_OVERHEAD = 8


@dataclass(frozen=True)
class SlotMap:
    """``shards[s]`` is the shard of virtual slot ``s``."""

    version: int
    n_shards: int
    shards: tuple[int, ...]


def records(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_slots: int = N_SLOTS) -> DataFrame:
    """One narrow row per input row: doc_id, size, text_crc32, virtual_slot.

    A null text is empty (size 8, crc 0). Rows without an id are dealt by their texts.
    Repeated rows stay, each a record of its own.
    """
    docs = documents_of(df, id_col, text_col)
    return docs.select(
        "doc_id",
        (F.octet_length("text").cast("long") + RECORD_OVERHEAD).alias("size"),
        F.crc32(F.col("text").cast("binary")).alias("text_crc32"),
        F.pmod(F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("doc_id")), F.lit(n_slots)).cast("int").alias("virtual_slot"),
    )


def slot_sizes(recs: DataFrame) -> DataFrame:
    return recs.groupBy("virtual_slot").agg(F.count("*").alias("n_rows"), F.sum("size").alias("n_bytes"))


def assign_slots(sizes: dict[int, int], n_shards: int, n_slots: int = N_SLOTS, version: int = 1) -> SlotMap:
    """Largest slot first, each to the shard with the fewest bytes, then fewest slots.

    ``sizes`` has at most ``n_slots`` entries, whatever the table's size; slots without
    records get a shard too, for records still to come.
    """
    heap = [(0, 0, shard) for shard in range(n_shards)]
    shards = [0] * n_slots
    for slot in sorted(range(n_slots), key=lambda s: (-sizes.get(s, 0), s)):
        n_bytes, n_held, shard = heapq.heappop(heap)
        shards[slot] = shard
        heapq.heappush(heap, (n_bytes + sizes.get(slot, 0), n_held + 1, shard))
    return SlotMap(version, n_shards, tuple(shards))


def rebalance(old: SlotMap, sizes: dict[int, int], n_shards: int) -> SlotMap:
    """The next version of the map for ``n_shards`` shards, moving few slots.

    Slots of shards that no longer exist move to the emptiest shards. Then, while a
    slot's move from the fullest to the emptiest shard narrows their gap, it is moved;
    so a new shard only receives, and slots not named in the edit stay where they are.
    """
    shards = list(old.shards)
    load = [0] * n_shards
    held: list[list[int]] = [[] for _ in range(n_shards)]
    homeless = []
    for slot, shard in enumerate(shards):
        if shard < n_shards:
            load[shard] += sizes.get(slot, 0)
            held[shard].append(slot)
        else:
            homeless.append(slot)
    for slot in sorted(homeless, key=lambda s: -sizes.get(s, 0)):
        to = min(range(n_shards), key=lambda k: (load[k], len(held[k]), k))
        shards[slot] = to
        load[to] += sizes.get(slot, 0)
        held[to].append(slot)
    for _ in range(len(shards)):
        low, high = min(range(n_shards), key=load.__getitem__), max(range(n_shards), key=load.__getitem__)
        gap = load[high] - load[low]
        fitting = [s for s in held[high] if 0 < sizes.get(s, 0) < gap]
        if not fitting:
            break
        slot = min(fitting, key=lambda s: (abs(gap / 2 - sizes[s]), s))
        shards[slot] = low
        held[high].remove(slot)
        held[low].append(slot)
        load[high] -= sizes[slot]
        load[low] += sizes[slot]
    return SlotMap(old.version + 1, n_shards, tuple(shards))


def write_map(spark: SparkSession, slot_map: SlotMap, path: str) -> None:
    """Append this version under ``path/version=N``; a version is written once."""
    rows = [(s, shard, slot_map.n_shards) for s, shard in enumerate(slot_map.shards)]
    out = spark.createDataFrame(rows, "virtual_slot int, shard int, n_shards int").coalesce(1)
    out.write.mode("errorifexists").parquet(f"{path.rstrip('/')}/version={slot_map.version}")


def read_map(spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
    """The given version, else the latest."""
    table = spark.read.parquet(path)
    if version is None:
        version = table.agg(F.max("version")).first()[0]
    rows = table.filter(F.col("version") == version).orderBy("virtual_slot").collect()
    return SlotMap(int(version), rows[0]["n_shards"], tuple(r["shard"] for r in rows))


def sizes_on_driver(sizes: DataFrame) -> dict[int, tuple[int, int]]:
    """slot -> (rows, bytes); as many entries as there are slots at most, however long the table."""
    return {r["virtual_slot"]: (r["n_rows"], r["n_bytes"]) for r in sizes.collect()}


def place(recs: DataFrame, slot_map: SlotMap, counts: dict[int, int]) -> DataFrame:
    """Add ``shard`` and ``slot``, the record's place in its shard, gapless from 0.

    ``counts`` has the rows of each virtual slot. A shard's places are those of its
    virtual slots one after another; within one they follow (doc_id, text_crc32, size).
    No task holds a whole shard.
    """
    spark = recs.sparkSession
    base = [0] * slot_map.n_shards
    rows = []
    for slot, shard in enumerate(slot_map.shards):
        rows.append((slot, shard, base[shard]))
        base[shard] += counts.get(slot, 0)
    table = F.broadcast(spark.createDataFrame(rows, "virtual_slot int, shard int, base long"))
    order = Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")
    within = recs.withColumn("within", F.row_number().over(order) - 1)
    return within.join(table, "virtual_slot").withColumn("slot", F.col("base") + F.col("within")).drop("base", "within")


def shard_documents(df: DataFrame, n_shards: int, n_slots: int = N_SLOTS, map_path: str | None = None) -> DataFrame:
    """Shard rows of (doc_id, text) so that bytes per shard are near equal (law ``bytes``).

    Returns doc_id, size, text_crc32, law, shard, slot, grown_shard (null under this
    law) and virtual_slot. With ``map_path`` the map is stored there as version 1. An
    empty table gives no rows. One id that holds most rows stays in one slot: sizes are
    then as near equal as whole slots allow.
    """
    recs = materialize(records(df, n_slots=n_slots))
    sizes = sizes_on_driver(slot_sizes(recs))
    slot_map = assign_slots({s: b for s, (_, b) in sizes.items()}, n_shards, n_slots)
    if map_path:
        write_map(df.sparkSession, slot_map, map_path)
    return place(recs, slot_map, {s: n for s, (n, _) in sizes.items()}).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot"
    )
