"""Hybrid retrieval for many anchors at once: authoritative, graph and vector evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestra.operators import vector_index

#: Rows and bytes of an allowlist up to which it is broadcast; beyond, joins shuffle.
BROADCAST_ROWS, BROADCAST_BYTES = 100_000, 16 << 20
PRIORITY = {"authoritative": 0, "graph": 1, "vector": 2}


def small(df: DataFrame, rows: int = BROADCAST_ROWS, most: int = BROADCAST_BYTES) -> DataFrame:
    """With a broadcast hint if it has few rows and few bytes (as JSON); what is read to see that stops beyond the bound of rows."""
    n, size = df.limit(rows + 1).agg(F.count("*"), F.coalesce(F.sum(F.octet_length(F.to_json(F.struct(*df.columns)))), F.lit(0))).first()
    return F.broadcast(df) if n <= rows and size <= most else df


def similarity_score(distance: Column) -> Column:
    return 1 / (1 + F.greatest(distance, F.lit(0.0)))


def allowed_only(rows: DataFrame, manifest: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(manifest.select(*keys).distinct(), keys, "left_semi")


def require_subset(values: DataFrame, allowed: DataFrame, key: str, label: str) -> DataFrame:
    """``values``, each of whose keys must be allowed; an outsider fails the job that reads it."""
    known = allowed.select(key).distinct().withColumn("_known", F.lit(True))
    message = F.concat(F.lit(f"{label} outside the allowed set: "), F.col(key).cast("string"))
    return values.join(known, key, "left").withColumn("_known", F.when(F.col("_known"), True).otherwise(F.raise_error(message).cast("boolean"))).filter("_known").drop("_known")


def vector_top_k(queries: DataFrame, vectors: DataFrame, k: int, allowed: DataFrame | None = None) -> DataFrame:
    """Exact nearest neighbours: (query_id, embedding) and (vec_id, embedding) to (query_id, vec_id, distance, rank).

    Every vector is compared with every query, as an exact search must; ``vector_index`` has
    the blocks in which this is done, and an index that compares fewer.
    """
    if allowed is not None:
        vectors = vectors.join(small(allowed.select("vec_id").distinct()), "vec_id", "left_semi")
    return vector_index.nearest(queries.select("query_id", "embedding"), vectors.select("vec_id", "embedding"), k)


def embedding_contract(vectors: DataFrame) -> DataFrame:
    """(n, dimensions, fingerprints, finite): one dimension, one fingerprint and finite values are required."""
    finite = ~F.exists("embedding", lambda x: F.isnan(x) | (F.abs(x) == float("inf")))
    fingerprint = F.countDistinct("fingerprint") if "fingerprint" in vectors.columns else F.lit(1).cast("long")
    return vectors.agg(F.count("*").alias("n"), F.countDistinct(F.size("embedding")).alias("dimensions"), fingerprint.alias("fingerprints"), F.bool_and(finite).alias("finite"))


def merge_evidence(sources: dict[str, DataFrame]) -> DataFrame:
    """(anchor, chunk_id, pos, score) by source; the first source of each anchor and chunk stays."""
    tagged = None
    for name, rows in sources.items():
        one = rows.select("anchor", "chunk_id", F.col("pos").cast("long").alias("pos"), F.col("score").cast("double").alias("score"), F.lit(name).alias("source"), F.lit(PRIORITY[name]).alias("priority"))
        tagged = one if tagged is None else tagged.unionByName(one)
    order = Window.partitionBy("anchor", "chunk_id").orderBy("priority", "pos")
    return tagged.withColumn("first", F.row_number().over(order)).filter("first = 1").drop("first")


def rerank(evidence: DataFrame, score: Column, top_k: int) -> DataFrame:
    """Authoritative rows first, in their order; of the others the ``top_k`` best by ``score``, ties in their order."""
    other = F.col("priority") > 0
    kept = evidence.withColumn("rerank_score", score)
    order = Window.partitionBy("anchor", other).orderBy(F.col("rerank_score").desc_nulls_last(), "priority", "pos")
    ranked = kept.withColumn("place", F.row_number().over(order)).filter(~other | (F.col("place") <= top_k))
    last = Window.partitionBy("anchor").orderBy(other, F.when(other, F.col("place")).otherwise(F.col("pos")))
    return ranked.withColumn("rank", F.row_number().over(last)).drop("place")


def budget_fold(items: Column, cost: str, budget: int, keep_first: bool = True, free: str | None = None) -> Column:
    """Of items in order those that fit: one that doesn't is skipped, and the fold goes on."""
    start = F.struct(F.lit(0).cast("long").alias("spent"), F.array().cast("array<boolean>").alias("taken"))

    def step(acc: Column, item: Column) -> Column:
        fits = acc["spent"] + item[cost] <= budget
        if keep_first:
            fits = fits | (F.size(acc["taken"]) == 0)
        if free:
            fits = fits | item[free]
        paid = F.when(item[free], F.lit(0).cast("long")).otherwise(item[cost].cast("long")) if free else item[cost].cast("long")
        return F.struct((acc["spent"] + F.when(fits, paid).otherwise(F.lit(0).cast("long"))).alias("spent"), F.concat(acc["taken"], F.array(fits)).alias("taken"))

    taken = F.aggregate(items, start, step, lambda acc: acc["taken"])
    return F.filter(F.zip_with(items, taken, lambda i, t: F.struct(i.alias("item"), t.alias("taken"))), lambda x: x["taken"])


def within_budget(rows: DataFrame, anchor: str, order: list[str], cost: Column, budget: int, keep_first: bool = True, free: Column | None = None) -> DataFrame:
    """Rows of each anchor that fit the budget, in order; an anchor's candidates are the few that retrieval returned."""
    keyed = rows.withColumn("_cost", cost.cast("long")).withColumn("_free", F.lit(False) if free is None else free)
    names = [c for c in keyed.columns if c not in (anchor, *order)]
    held = keyed.groupBy(anchor).agg(F.array_sort(F.collect_list(F.struct(*order, *names))).alias("_items"))
    kept = held.select(anchor, F.posexplode(budget_fold(F.col("_items"), "_cost", budget, keep_first, "_free" if free is not None else None)).alias("kept_pos", "_x"))
    return kept.select(anchor, "kept_pos", "_x.item.*").drop("_cost", "_free")


def scenario_query(title: Column, statement: Column, criteria: Column) -> Column:
    """Text that a scenario is searched by: title, statement, and what each criterion expects."""
    return F.concat_ws(" ", title, statement, F.array_join(F.transform(criteria, lambda c: c["then"]), " "))


def story_requirements(stories: DataFrame, requirements: DataFrame) -> DataFrame:
    """(story_id, pos, requirement_id, ...) of each story's ``requirement_ids`` in order; one that is not there fails the job."""
    asked = stories.select("story_id", F.posexplode("requirement_ids").alias("pos", "requirement_id"))
    known = requirements.withColumn("_there", F.lit(True))
    message = F.concat(F.lit("story requirement IDs are unresolved: "), F.col("requirement_id"))
    return asked.join(known, "requirement_id", "left").filter(F.when(F.col("_there"), True).otherwise(F.raise_error(message).cast("boolean"))).drop("_there")


def scenario_lineage(scenarios: DataFrame, stories: DataFrame, requirements: DataFrame) -> DataFrame:
    """(scenario_id, story_ids, requirement_ids): a scenario's stories in order, and their requirements, each at its first place."""
    of_story = scenarios.select("scenario_id", F.posexplode("story_ids").alias("story_pos", "story_id"))
    known = stories.select("story_id").withColumn("_there", F.lit(True))
    message = F.concat(F.lit("scenario story IDs are unresolved: "), F.col("story_id"))
    of_story = of_story.join(known, "story_id", "left").filter(F.when(F.col("_there"), True).otherwise(F.raise_error(message).cast("boolean"))).drop("_there")
    linked = of_story.join(story_requirements(stories, requirements).select("story_id", "pos", "requirement_id"), "story_id", "left")
    once = linked.filter("requirement_id IS NOT NULL").groupBy("scenario_id", "requirement_id").agg(F.min(F.struct("story_pos", "pos")).alias("at"))
    held = once.groupBy("scenario_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "requirement_id"))), lambda x: x["requirement_id"]).alias("requirement_ids"))
    return scenarios.select("scenario_id", "story_ids").join(held, "scenario_id", "left").withColumn("requirement_ids", F.coalesce("requirement_ids", F.array().cast("array<string>")))


def ordered_chunks(chunks: DataFrame, wanted: DataFrame) -> DataFrame:
    """The wanted chunks (project, chunk_id) in their documents' order."""
    return allowed_only(chunks, wanted, ["project", "chunk_id"]).orderBy("project", "sequence_index", "chunk_id")


def story_query(title: Column, as_a: Column, want: Column, so_that: Column, criteria: Column) -> Column:
    """Text that a story is searched by: its parts, then what each criterion expects."""
    return F.concat_ws(" ", title, as_a, want, so_that, F.array_join(F.transform(criteria, lambda c: c["then"]), " "))
