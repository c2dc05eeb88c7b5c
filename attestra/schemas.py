"""Schemas of the library's tables, as DDL, and the check at operator boundaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from attestra.operators.codegraph import RELATIONS

BLOCKS = "doc_key string, pos int, text string, start int, end int, kind string, section string, location string, paragraph int"
ENTITIES = "project string, entity_id string, name string, normalized_name string, entity_type string, aliases array<string>"
MENTIONS = "project string, chunk_id string, entity_id string"
EDGES = "project string, relationship_id string, chunk_id string, source_entity_id string, relationship_type string, target_entity_id string, confidence double"
RECORDS = "record_id string, record_type string, record_status string, enabled boolean, natural_key string, name string, payload string, source_sheet string, source_row int"
BINDINGS = "binding_id string, scenario_id string, execution_profile_id string, variant_id string, fixture_id string, action_sequence_id string, test_vector_ids array<string>, oracle_ids array<string>, cleanup_id string, selection_priority int, approval_status string"
ISSUES = "issue_code string, severity string, message string, record_id string, sheet string, row int, cell string"
SYMBOLS = "snapshot_id string, symbol_id string, fqn string, kind string, relative_path string, start_line int, end_line int, body_hash string"
CODE_EDGES = "snapshot_id string, edge_id string, source_symbol_id string, target_symbol_id string, relation string, confidence string"

#: The code graph's relations.
CODE_RELATIONS = tuple(sorted(set(RELATIONS.values())))


def assert_schema(df: DataFrame, ddl: str) -> DataFrame:
    """``df`` if it has the fields of ``schema`` with their types; extra fields are refused."""
    schema = T.StructType.fromDDL(ddl)
    have = {f.name: f.dataType.simpleString() for f in df.schema}
    want = {f.name: f.dataType.simpleString() for f in schema}
    if have != want:
        raise ValueError(f"schema differs: missing {sorted(set(want) - set(have))}, extra {sorted(set(have) - set(want))}, types {sorted(k for k in have.keys() & want.keys() if have[k] != want[k])}")
    return df.select(*(f.name for f in schema))


def load_checked(df: DataFrame, ddl: str, issues: DataFrame | None = None) -> DataFrame:
    """``df`` as it was read, with its schema and rules checked again: any row of ``issues``, made of ``df`` by its rules, is an error."""
    checked = assert_schema(df, ddl)
    if issues is not None and (found := issues.limit(5).collect()):
        raise ValueError(f"stored rows break their rules: {[r.asDict() for r in found]}")
    return checked
