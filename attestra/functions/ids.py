"""Stable identities: upper-case prefixes of SHA-256 digests over joined parts."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestra.functions.text import fold, slug

#: Prefix and digest length of each kind of id.
LENGTHS = {"CHK": 20, "ENT": 20, "REL": 24, "EVD": 20, "AC": 18, "FWS": 24, "TDS": 24, "BND": 22, "TDB": 22, "CTX": 22, "CAP": 22, "TDR": 22, "SYM": 24, "EDG": 24, "LKH": 32, "PFP": 28}


def stable_token(*parts: Column, length: int = 20) -> Column:
    """A null part counts as empty, and keeps its place."""
    joined = F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))
    return F.upper(F.substring(F.sha2(joined, 256), 1, length))


def stable_id(kind: str, *parts: Column) -> Column:
    return F.concat(F.lit(f"{kind}-"), stable_token(*parts, length=LENGTHS[kind]))


def chunk_id(text: Column, start: Column, end: Column, location: Column) -> Column:
    """Depends on neither project nor run."""
    return stable_id("CHK", text, start, end, location)


def entity_id(project: Column, name: Column, kind: Column) -> Column:
    return stable_id("ENT", slug(project), fold(name), kind)


def relationship_id(project: Column, chunk: Column, requirement_text: Column, source: Column, kind: Column, target: Column, evidence: Column) -> Column:
    return stable_id("REL", project, chunk, F.sha2(requirement_text, 256), source, kind, target, F.sha2(evidence, 256))


def evidence_id(parent: Column, chunk: Column, start: Column, end: Column) -> Column:
    return stable_id("EVD", parent, chunk, start, end)


def criterion_id(story: Column, ordinal: Column, content: Column) -> Column:
    return stable_id("AC", story, ordinal, content)


def logical_case_key(project: Column, scenario: Column, profile: Column, variant: Column) -> Column:
    return stable_id("LKH", project, scenario, profile, F.coalesce(variant, F.lit("default")))


def provider_fingerprint(provider: Column, model: Column, revision: Column, params: Column, prompt: Column) -> Column:
    return stable_id("PFP", provider, model, revision, params, prompt)


def content_hash(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text, 256))


def canonical_checksum(value: object, drop: tuple[str, ...] = ("checksum", "generated_at")) -> str:
    """Of the value as compact JSON with sorted keys, without the dropped top-level fields."""
    if isinstance(value, dict):
        value = {k: v for k, v in value.items() if k not in drop}
    text = json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    return "sha256:" + hashlib.sha256(text.encode()).hexdigest()


@F.pandas_udf(T.StringType())
def json_checksum(values: pd.Series) -> pd.Series:
    """``canonical_checksum`` of JSON texts; null for null."""
    return values.map(lambda x: None if x is None else canonical_checksum(json.loads(x)))
