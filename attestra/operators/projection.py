"""Relation edges of test-data snapshots and accepted cases: (source, relation, target, snapshot_id), each once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

EDGE = ("source", "relation", "target", "snapshot_id")
#: Id columns of a binding that name no record.
NO_RECORDS = ("binding_id", "scenario_id", "execution_profile_id")
ACCEPTED = "ACCEPTED"


def record_ids(bindings: DataFrame) -> Column:
    """Ids that a binding's columns *_id and *_ids name, in the columns' order, each once; its own, the scenario's and the profile's aside."""
    parts = []
    for f in bindings.schema:
        if f.name.endswith("_id") and f.name not in NO_RECORDS and isinstance(f.dataType, T.StringType):
            parts.append(F.array(F.col(f.name)))
        elif f.name.endswith("_ids") and isinstance(f.dataType, T.ArrayType):
            parts.append(F.coalesce(F.col(f.name).cast("array<string>"), F.array().cast("array<string>")))
    named = F.concat(*parts) if parts else F.array().cast("array<string>")
    return F.array_distinct(F.filter(named, lambda x: x.isNotNull() & (x != "")))


def _edges(rows: DataFrame, source: str, relation: str, target: Column, snapshot: Column | None = None) -> DataFrame:
    return rows.select(F.col(source).cast("string").alias("source"), F.lit(relation).alias("relation"), target.cast("string").alias("target"), (F.lit(None).cast("string") if snapshot is None else snapshot.cast("string")).alias("snapshot_id"))


def _distinct(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out.filter("source IS NOT NULL AND target IS NOT NULL").distinct()


def test_data_edges(records: DataFrame, bindings: DataFrame, snapshot_id: str) -> DataFrame:
    """Edges of a test-data snapshot: it has records; scenarios have bindings; these are for a profile and use records."""
    snapshot = F.lit(snapshot_id)
    used = bindings.select("binding_id", F.explode(record_ids(bindings)).alias("record"))
    return _distinct([
        _edges(records.select(snapshot.alias("snapshot"), "record_id"), "snapshot", "HAS_RECORD", F.col("record_id"), snapshot),
        _edges(bindings, "scenario_id", "HAS_DATA_BINDING", F.col("binding_id"), snapshot),
        _edges(bindings, "binding_id", "FOR_PROFILE", F.col("execution_profile_id"), snapshot),
        _edges(used, "binding_id", "USES_RECORD", F.col("record"), snapshot),
    ])


def case_edges(cases: DataFrame) -> DataFrame:
    """Edges of accepted cases to their scenario, stories, requirements, snapshots and generated files.

    ``cases`` is (tc_id, status, scenario_id, story_ids, requirement_ids,
    test_data_snapshot_id, framework_snapshot_id, generated_files). A case that isn't
    accepted, or has no framework snapshot, fails the job that reads the edges.
    """
    sound = (F.col("status") == ACCEPTED) & F.col("framework_snapshot_id").isNotNull()
    message = F.concat(F.lit("only accepted cases with a framework snapshot have edges: "), F.col("tc_id").cast("string"))
    checked = cases.filter(F.when(F.coalesce(sound, F.lit(False)), True).otherwise(F.raise_error(message).cast("boolean")))
    each = lambda items: checked.select("tc_id", F.explode(items).alias("item"))
    return _distinct([
        _edges(checked, "tc_id", "IMPLEMENTS", F.col("scenario_id")),
        _edges(each("story_ids"), "tc_id", "TRACES_TO", F.col("item")),
        _edges(each("requirement_ids"), "tc_id", "VERIFIES", F.col("item")),
        _edges(checked, "tc_id", "USES_TEST_DATA", F.col("test_data_snapshot_id")),
        _edges(checked, "tc_id", "GENERATED_IN", F.col("framework_snapshot_id")),
        _edges(each("generated_files"), "tc_id", "GENERATED_FILE", F.col("item")),
    ])
