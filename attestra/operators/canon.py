"""Candidates merged into canonical rows, with identities taken over from earlier runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestra.functions.ids import stable_id, stable_token
from attestra.functions.text import fold
from attestra.operators.graph import numbered


def ordered_union(position: Column, items: Column) -> Column:
    """Aggregate: items of all rows in order, each once."""
    rows = F.array_sort(F.collect_list(F.struct(position.alias("p"), items.alias("i"))))
    return F.array_distinct(F.flatten(F.transform(rows, lambda r: r["i"])))


def first_per(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("_first", F.row_number().over(w)).filter("_first = 1").drop("_first")


def source_conflicts(rows: DataFrame, prior: DataFrame) -> DataFrame:
    """Source ids with texts that differ, within the run or from an earlier one: (source_req_id, n_texts)."""
    here = rows.filter("source_req_id_type = 'source'").select("source_req_id", F.col("requirement_text").alias("t"))
    before = prior.filter("source_req_id_type = 'source'").select("source_req_id", F.col("requirement_text").alias("t"))
    both = here.unionByName(before.join(here.select("source_req_id").distinct(), "source_req_id", "left_semi"))
    return both.groupBy("source_req_id").agg(F.countDistinct("t").alias("n_texts")).filter("n_texts > 1")


def requirement_keys(rows: DataFrame, prior: DataFrame) -> DataFrame:
    """``rows`` with ``canon_key``.

    A source row's key is its id. A generated row whose folded text is that of a source
    row of this run takes its key (the first one's), else of an earlier run's; else its
    key is its text.
    """
    text = fold(F.col("requirement_text"))
    order = ["sequence_index", "pos"]
    sources = rows.filter("source_req_id_type = 'source'").select(text.alias("folded"), "source_req_id", *order)
    here = first_per(sources, ["folded"], order).select("folded", F.col("source_req_id").alias("here_id"))
    before = prior.filter("source_req_id_type = 'source'").select(text.alias("folded"), F.col("source_req_id").alias("prior_id"))
    before = before.groupBy("folded").agg(F.min("prior_id").alias("prior_id"))
    keyed = rows.withColumn("folded", text).join(here, "folded", "left").join(before, "folded", "left")
    source = F.when(F.col("source_req_id_type") == "source", F.col("source_req_id")).otherwise(F.coalesce("here_id", "prior_id"))
    return keyed.withColumn("canon_key", F.when(source.isNotNull(), F.concat(F.lit("source|"), source)).otherwise(F.concat(F.lit("generated|"), F.col("folded")))).drop("folded", "here_id", "prior_id")


def merge_requirements(rows: DataFrame, prior: DataFrame, project: str) -> DataFrame:
    """One row per canonical requirement.

    The representative is the first source member, else the first member. An earlier
    requirement gives its id, type and priority, and its text only if it is a source.
    Confidence is the best of this run; lists are this run's, each item once.
    """
    keyed = requirement_keys(rows, prior).withColumn("n", F.struct("sequence_index", "pos"))
    is_source = F.col("source_req_id_type") == "source"
    lead = F.min_by(F.struct("requirement_text", "requirement_type", "priority", "source_req_id", "source_req_id_type"), F.struct((~is_source).alias("s"), "n"))
    merged = keyed.groupBy("canon_key").agg(
        lead.alias("lead"), F.max("confidence").alias("confidence"), ordered_union(F.col("n"), F.col("constraints")).alias("constraints"),
        ordered_union(F.col("n"), F.col("entity_ids")).alias("entity_ids"), ordered_union(F.col("n"), F.array("chunk_id")).alias("chunk_ids"), F.min("n").alias("n"),
    )
    text = fold(F.col("requirement_text"))
    key = F.when(F.col("source_req_id_type") == "source", F.concat(F.lit("source|"), F.col("source_req_id"))).otherwise(F.concat(F.lit("generated|"), text))
    earlier = prior.select(key.alias("canon_key"), F.col("requirement_id").alias("prior_id"), F.col("requirement_text").alias("prior_text"), F.col("requirement_type").alias("prior_type"), F.col("priority").alias("prior_priority"), (F.col("source_req_id_type") == "source").alias("prior_source"))
    out = merged.join(earlier, "canon_key", "left")
    made = F.concat(F.lit("REQ-"), stable_token(F.lit(project), F.col("canon_key")))
    found = out.select(
        F.coalesce("prior_id", made).alias("requirement_id"), F.when(F.col("prior_source"), F.col("prior_text")).otherwise(F.col("lead.requirement_text")).alias("requirement_text"),
        F.coalesce("prior_type", "lead.requirement_type").alias("requirement_type"), F.coalesce("prior_priority", "lead.priority").alias("priority"), F.col("lead.source_req_id").alias("source_req_id"),
        F.col("lead.source_req_id_type").alias("source_req_id_type"), "confidence", "constraints", "entity_ids", "chunk_ids", "n",
    )
    return numbered(found, ["n"], "pos").drop("n")


def merge_entities(rows: DataFrame) -> DataFrame:
    """By entity_id: the first row's fields, all aliases once, mentions once by chunk, start and end."""
    mention = F.struct("chunk_id", "start", "end")
    return rows.groupBy("entity_id").agg(
        F.min_by(F.struct("name", "entity_type"), "pos").alias("f"), ordered_union(F.col("pos"), F.col("aliases")).alias("aliases"), ordered_union(F.col("pos"), F.array(mention)).alias("mentions")
    ).select("entity_id", "f.name", "f.entity_type", "aliases", "mentions")


def story_key(title: Column, persona: Column, as_a: Column, want: Column, so_that: Column) -> Column:
    return F.concat_ws("|", *(fold(F.coalesce(x, F.lit(""))) for x in (title, persona, as_a, want, so_that)))


def scenario_key(title: Column, description: Column, kind: Column, action: Column, expected: Column) -> Column:
    return F.concat_ws("|", *(fold(F.coalesce(x, F.lit(""))) for x in (title, description, kind, action, expected)))


def merge_candidates(rows: DataFrame, key: Column, prior: DataFrame, kind: str, project: str, parent: str, links: list[str]) -> DataFrame:
    """Stories or scenarios: one row per (source id, its type, key).

    Parents and links are of this run's members in order; an earlier row gives its id
    only. ``prior`` is (source_req_id, source_req_id_type, key, id); a null source id
    equals a null one.
    """
    keyed = rows.withColumn("key", key)
    by = ["source_req_id", "source_req_id_type", "key"]
    merged = keyed.groupBy(*by).agg(F.min("pos").alias("pos"), F.max("confidence").alias("confidence"), ordered_union(F.col("pos"), F.array(parent)).alias(f"{parent}s"), *(ordered_union(F.col("pos"), F.col(x)).alias(x) for x in links))
    old = prior.select(*(F.col(c).alias(f"old_{c}") for c in by), F.col("id").alias("old_id"))
    same = [F.col(c).eqNullSafe(F.col(f"old_{c}")) for c in by]
    made = F.concat(F.lit(f"{kind}-"), stable_token(F.lit(project), *(F.col(c) for c in by)))
    return merged.join(old, same, "left").withColumn("id", F.coalesce("old_id", made)).drop("old_id", *(f"old_{c}" for c in by))


def criterion_ids(criteria: DataFrame, prior: DataFrame) -> DataFrame:
    """(story_id, ordinal, title, given, when, then) with the id of an equal criterion of the story before, else a new one."""
    content = F.concat_ws("|", *(fold(F.coalesce(F.col(f"`{c}`"), F.lit(""))) for c in ("title", "given", "when", "then")))
    keyed = criteria.withColumn("content", content)
    out = keyed.join(prior.select("story_id", "content", F.col("criterion_id").alias("old_id")), ["story_id", "content"], "left")
    return out.withColumn("criterion_id", F.coalesce("old_id", stable_id("AC", F.col("story_id"), F.col("ordinal"), F.col("content")))).drop("old_id")
