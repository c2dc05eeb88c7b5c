"""Nested payloads and model output as JSON text."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed values.
PLACEHOLDERS = ("PLACEHOLDER", "TBD", "UNKNOWN", "N/A", "TODO")
SECRET_KEYS = r"(?i)secret|password|credential|api_key|token"
SECRET_PREFIX = "secret://"


def leaves(value: object, path: str = "") -> Iterator[tuple[str, str, str, str]]:
    """(path, key, kind, text) of all scalars below, in order."""
    if isinstance(value, dict):
        for k, v in value.items():
            yield from leaves(v, f"{path}.{k}" if path else str(k))
    elif isinstance(value, list):
        for i, v in enumerate(value):
            yield from leaves(v, f"{path}[{i}]")
    else:
        key = re.sub(r"\[\d+\]", "", path.rpartition(".")[2])
        kind = "null" if value is None else "boolean" if isinstance(value, bool) else "number" if isinstance(value, (int, float)) else "string"
        yield path, key, kind, value if isinstance(value, str) else json.dumps(value)


LEAF = T.ArrayType(T.StructType([T.StructField(x, T.StringType()) for x in ("path", "key", "kind", "value")]))


@F.pandas_udf(LEAF)
def leaf_array(payloads: pd.Series) -> pd.Series:
    def of(text):
        try:
            return [dict(zip(("path", "key", "kind", "value"), x)) for x in leaves(json.loads(text))] if text else []
        except ValueError:
            return []

    return payloads.map(of)


def explode_leaves(df: DataFrame, payload: str) -> DataFrame:
    """All columns but the payload, and pos, path, key, kind, value of each leaf."""
    keep = [c for c in df.columns if c != payload]
    return df.select(*keep, F.posexplode(leaf_array(payload)).alias("pos", "leaf")).select(*keep, "pos", "leaf.*")


def is_placeholder(value: Column) -> Column:
    return (F.trim(value) == "") | F.upper(F.trim(value)).isin(*PLACEHOLDERS)


def is_plain_secret(key: Column, value: Column, kind: Column | None = None) -> Column:
    """A value under a secret's key that names no stored secret; an empty text or null is none, but a blank one, a number or a boolean is."""
    plain = (value != "") & ~value.startswith(SECRET_PREFIX)
    return key.rlike(SECRET_KEYS) & (plain if kind is None else F.when(kind == "null", False).when(kind == "string", plain).otherwise(True))


def last_json_object(text: str | None) -> str | None:
    """The last balanced object that parses, of model output without reasoning tags and fences."""
    if not text:
        return None
    text = re.sub(r"<think>.*?</think>", "", text, flags=re.S).replace("```json", "").replace("```", "")
    decoder, at, found = json.JSONDecoder(), 0, None
    while (start := text.find("{", at)) >= 0:
        try:
            _, end = decoder.raw_decode(text, start)
            found, at = text[start:end], end
        except ValueError:
            at = start + 1
    return found


@F.pandas_udf(T.StringType())
def model_json(texts: pd.Series) -> pd.Series:
    return texts.map(last_json_object)
