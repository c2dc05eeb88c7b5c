"""Keyed upserts, cascade deletes and set operations over tables without transactions.

Each function returns the table as it should be; ``commits`` writes it as a new version.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestra.operators.graph import numbered


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


#: The relations that the semantic graph may have.
RELATIONSHIP_TYPES = ("USES", "SUPPORTS", "CONTROLS", "COLLECTS_FROM", "COMMUNICATES_VIA", "CONNECTS_TO", "REFERS_TO")


def upsert(base: DataFrame, new: DataFrame, keys: list[str], order: list[Column] | None = None) -> DataFrame:
    """New rows replace old ones of the same key; of several new ones the first by ``order`` counts."""
    if order:
        new = latest(new, keys, order)
    return base.join(new.select(*keys), keys, "left_anti").unionByName(new)


def insert_absent(base: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New keys are added once; rows that exist stay as they are."""
    return base.unionByName(new.dropDuplicates(keys).join(base.select(*keys), keys, "left_anti"))


def insert_or_verify(base: DataFrame, new: DataFrame, keys: list[str], value: str) -> DataFrame:
    """New keys are added; an existing key with another value fails the job that reads it."""
    old = base.select(*keys, F.col(value).alias("_old"))
    message = F.concat(F.lit("differs from the stored row: "), F.concat_ws("|", *(F.col(k).cast("string") for k in keys)))
    joined = new.join(old, keys, "left").withColumn("_ok", F.when(F.col("_old").isNull(), True).when(F.col("_old") == F.col(value), False).otherwise(F.raise_error(message).cast("boolean")))
    return base.unionByName(joined.filter("_ok").drop("_ok", "_old"))


def allocate_numbers(existing: DataFrame, new: DataFrame, key: str, low: int = 100_001, high: int = 999_999) -> DataFrame:
    """(key, number): known keys keep their number, others get the next ones in key order; beyond ``high`` the job fails."""
    fresh = new.select(key).distinct().join(existing.select(key), key, "left_anti")
    top = existing.agg(F.coalesce(F.max("number"), F.lit(low - 1)).alias("top"))
    counted = numbered(fresh, [key], "n").join(F.broadcast(top)).withColumn("number", F.col("top") + F.col("n") + 1)
    checked = counted.withColumn("number", F.when(F.col("number") <= high, F.col("number").cast("int")).otherwise(F.raise_error(F.lit("numbers are used up")).cast("int")))
    return existing.select(key, "number").unionByName(checked.select(key, "number"))


def replace_children(rows: DataFrame, new: DataFrame, parents: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with all children of ``parents`` gone and the ``new`` ones in their place; a parent without new ones has none."""
    return delete_children(rows, parents, keys).unionByName(new.join(parents.select(*keys).distinct(), keys, "left_semi"))


def upsert_with_children(base: DataFrame, new: DataFrame, keys: list[str], bridges: dict[str, tuple[DataFrame, str, str]]) -> tuple[DataFrame, dict[str, DataFrame]]:
    """(parents, bridge tables) after an upsert of parents whose array columns are the children.

    ``bridges`` names each bridge table: (table, array column, child column). Bridge rows
    accumulate: those of earlier upserts stay, each row is there once. (Steps of a case are
    replaced instead, by ``replace_children``.)
    """
    parent, *more = keys
    if more:
        raise ValueError("bridges have one parent key")
    tables = {name: insert_absent(rows, children(new, parent, items, child).select(*rows.columns), [parent, child]) for name, (rows, items, child) in bridges.items()}
    return upsert(base, new.drop(*(items for _, items, _ in bridges.values())), keys), tables


def upsert_vectors(base: DataFrame, new: DataFrame, keys: list[str], column: str = "embedding") -> DataFrame:
    """An upsert in which an empty vector, or one with a value that is no finite number, fails the job."""
    bad = F.col(column).isNull() | (F.size(column) == 0) | F.exists(column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    kind = new.schema[column].dataType.simpleString()
    checked = F.when(F.coalesce(bad, F.lit(True)), F.raise_error(F.lit("an embedding must have finite values")).cast(kind)).otherwise(F.col(column))
    return upsert(base, new.withColumn(column, checked), keys)


def typed_edges(edges: DataFrame, allowed: tuple[str, ...] = RELATIONSHIP_TYPES, column: str = "relationship_type") -> DataFrame:
    """``edges``, each of an allowed type; another type fails the job that reads them."""
    message = F.concat(F.lit("unsupported relationship type: "), F.coalesce(F.col(column), F.lit("")))
    return edges.withColumn(column, F.when(F.col(column).isin(*allowed), F.col(column)).otherwise(F.raise_error(message)))


def accepted_cases(cases: DataFrame, run_cases: DataFrame, project: str, run_id: str) -> DataFrame:
    """Accepted cases of a run, each once, in order of their number."""
    of_run = run_cases.filter((F.col("project") == project) & (F.col("run_id") == run_id)).select("tc_id").distinct()
    return cases.filter("status = 'ACCEPTED'").join(of_run, "tc_id", "left_semi").orderBy("tc_id")


def mentioned_entities(entities: DataFrame, mentions: DataFrame, chunk_id: str) -> DataFrame:
    """(entity_id, mentioned): every entity, and whether the chunk mentions it."""
    found = mentions.filter(F.col("chunk_id") == chunk_id).select("entity_id").distinct().withColumn("_m", F.lit(True))
    return entities.select("entity_id").distinct().join(found, "entity_id", "left").select("entity_id", F.col("_m").isNotNull().alias("mentioned"))


def with_prefix(rows: DataFrame, column: str, prefix: str) -> DataFrame:
    """Rows whose key begins with ``prefix``, taken literally; the filter reaches the scan."""
    return rows.filter(F.col(column).startswith(prefix))


def of_run(rows: DataFrame, run_id: str, payload: str = "payload") -> DataFrame:
    """Rows whose JSON payload is of the run."""
    return rows.filter(F.get_json_object(payload, "$.run_id") == run_id)


def project_delete(tables: dict[str, DataFrame], project: str, parents: dict[str, tuple[str, str]]) -> dict[str, DataFrame]:
    """``tables`` without a project's rows; a table named in ``parents`` (parent table, key) has no project itself and loses the rows of parents that go.

    Children come before parents in the result, the order in which foreign keys let them be deleted.
    """
    gone = {name: df.filter(F.col("project") == project) for name, df in tables.items() if name not in parents}
    out: dict[str, DataFrame] = {}
    for name, (parent, key) in parents.items():
        out[name] = delete_children(tables[name], gone[parent], [key])
    return out | {name: tables[name].filter(F.col("project") != project) for name in gone}


def children(parents: DataFrame, parent: str, items: str, child: str) -> DataFrame:
    """Bridge rows of an array column, each once."""
    return parents.select(parent, F.explode(items).alias(child)).distinct()


def delete_children(rows: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(gone.select(*keys).distinct(), keys, "left_anti")


def orphans(entities: DataFrame, references: list[DataFrame], key: str) -> DataFrame:
    """Entities that none of the tables refers to."""
    out = entities
    for ref in references:
        out = out.join(ref.select(key).distinct(), key, "left_anti")
    return out


def reset_run(chunks: DataFrame, mentions: DataFrame, edges: DataFrame, entities: DataFrame, run_id: str) -> dict[str, DataFrame]:
    """The graph without a run's chunks, what hangs on them, and entities left without references."""
    gone = chunks.filter(F.col("run_id") == run_id).select("chunk_id")
    left_mentions, left_edges = delete_children(mentions, gone, ["chunk_id"]), delete_children(edges, gone, ["chunk_id"])
    refs = [left_mentions.select("entity_id"), left_edges.select(F.col("source_entity_id").alias("entity_id")), left_edges.select(F.col("target_entity_id").alias("entity_id"))]
    lost = orphans(entities, refs, "entity_id")
    return {"chunks": chunks.filter(F.col("run_id") != run_id), "mentions": left_mentions, "edges": left_edges, "entities": delete_children(entities, lost, ["entity_id"])}


def cascade_stages(rows: DataFrame, project: str, run_id: str, stage: int) -> DataFrame:
    """Without rows of this stage and later ones of the run."""
    return rows.filter(~((F.col("project") == project) & (F.col("run_id") == run_id) & (F.col("stage") >= stage)))


def keep_permanent(rows: DataFrame, project: str, permanent: tuple[str, ...]) -> DataFrame:
    return rows.filter(~((F.col("project") == project) & ~F.col("kind").isin(*permanent)))


def removable_snapshots(snapshots: DataFrame, references: DataFrame) -> DataFrame:
    """Snapshots that are neither active nor referred to."""
    return snapshots.filter(~F.col("active")).join(references.select("snapshot_id").distinct(), "snapshot_id", "left_anti")


def removed_counts(before: DataFrame, after: DataFrame, label: str) -> DataFrame:
    n = lambda df, name: df.groupBy(label).agg(F.count("*").alias(name))
    both = n(before, "had").join(n(after, "has"), label, "full")
    return both.select(label, (F.coalesce("had", F.lit(0)) - F.coalesce("has", F.lit(0))).alias("removed")).filter("removed <> 0")


def set_differences(expected: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """(key, side): keys that only one side has."""
    a, b = expected.select(key).distinct(), found.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("side", F.lit("missing")).unionByName(b.join(a, key, "left_anti").withColumn("side", F.lit("extra")))
