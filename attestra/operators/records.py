"""Accepted cases, frozen runs, paths and literals."""

from __future__ import annotations

import ast
import datetime
import hashlib
import secrets
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra.functions.ids import json_checksum, logical_case_key
from attestra.functions.text import is_safe_relative

#: Where generated files may be; a helper's or wrapper's file is named after its module.
_MODULE, _STEM = r"[a-z][a-z0-9_]*", r"Tc(\d{6})[A-Z][A-Za-z0-9]*"
PATH_CLASSES = {
    "test": rf"^tests/{_MODULE}/{_STEM}\.py$",
    "init": rf"^(tests|test_lib)/{_MODULE}/__init__\.py$",
    "robot": rf"^tests_robot/{_MODULE}/{_STEM}\.robot$",
    "wrapper": rf"^test_lib/({_MODULE})/\1_wrappers\.py$",
    "helper": rf"^test_lib/({_MODULE})/\1_helpers\.py$",
}
#: Files of these classes may be changed; others are only created.
CHANGEABLE = ("wrapper", "helper")
LEAST_CASE, GREATEST_CASE = 100001, 999999


def run_id(project: str, now: datetime.datetime | None = None) -> str:
    """Time and a token of the project and a random part; not an identity of content."""
    now = now or datetime.datetime.now(datetime.UTC)
    token = hashlib.sha256(f"{project}|{secrets.token_hex(16)}".encode()).hexdigest()[:6].upper()
    return f"RUN-{now:%Y%m%dT%H%M%SZ}-{token}"


def path_class(path: Column) -> Column:
    """The class whose pattern the path has; null for none, for paths that leave the folder, and for case numbers out of range."""
    out = F.lit(None).cast("string")
    for name, pattern in reversed(PATH_CLASSES.items()):
        out = F.when(path.rlike(pattern), name).otherwise(out)
    number = F.regexp_extract(path, r"/Tc(\d{6})", 1)
    in_range = (number == "") | number.try_cast("int").between(LEAST_CASE, GREATEST_CASE)
    return F.when(is_safe_relative(path) & in_range & ~path.contains("\\") & ~path.rlike(r"(^|/)\.?/"), out)


def classify_writes(new: DataFrame, existing: DataFrame, key: str, content: str) -> DataFrame:
    """``new`` with ``action``: insert, no_op for an equal accepted row, conflict for a changed one."""
    old = existing.filter("status = 'ACCEPTED'").select(key, F.col(content).alias("_old"))
    return new.join(old, key, "left").withColumn("action", F.when(F.col("_old").isNull(), "insert").when(F.col("_old") == F.col(content), "no_op").otherwise("conflict")).drop("_old")


def frozen_rows(scenarios: DataFrame, project: str, profile: str) -> DataFrame:
    """Per scenario in order: its logical key and a checksum of its JSON."""
    key = logical_case_key(F.lit(project), F.col("scenario_id"), F.lit(profile), F.col("variant_id"))
    return scenarios.select("pos", "scenario_id", "variant_id", key.alias("case_key"), json_checksum(F.to_json(F.struct(*scenarios.columns))).alias("checksum"))


def input_fingerprint(scenario: Column, profile: Column, variant: Column, data_checksum: Column, provider: Column, policy: Column) -> Column:
    """Checksum of all that decides what is made of a case: scenario and provider are JSON texts, the others strings; a null is JSON's null."""
    text = lambda c: F.coalesce(F.regexp_replace(F.to_json(F.array(c)), r"^\[|\]$", ""), F.lit("null"))
    parts = {
        "scenario": F.coalesce(scenario, F.lit("null")), "execution_profile_id": text(profile), "variant_id": text(variant), "test_data_checksum": text(data_checksum),
        "provider_fingerprint": F.coalesce(provider, F.lit("null")), "generation_policy_version": text(policy),
    }
    fields = [F.concat(F.lit(f'"{name}":'), value) for name, value in parts.items()]
    return json_checksum(F.concat(F.lit("{"), F.concat_ws(",", *fields), F.lit("}")))


def in_frozen_order(frozen: DataFrame, scenarios: DataFrame) -> DataFrame:
    """Scenarios of a frozen run in its order; one that is missing fails the job."""
    known = scenarios.withColumn("_there", F.lit(True))
    joined = frozen.select("pos", "scenario_id").join(known.drop("pos") if "pos" in known.columns else known, "scenario_id", "left")
    message = F.concat(F.lit("scenario is missing: "), F.col("scenario_id"))
    return joined.filter(F.when(F.col("_there"), True).otherwise(F.raise_error(message).cast("boolean"))).drop("_there").orderBy("pos")


def context_rows(items: DataFrame) -> DataFrame:
    """One JSON payload per anchor of what a context holds, with the numbers of its budget nested."""
    held = F.array_sort(F.collect_list(F.struct("tier", "pos", "item_id")))
    return items.groupBy("anchor").agg(F.to_json(F.struct(held.alias("items"), F.struct(F.sum("cost").alias("selected_tokens"), F.count("*").alias("n_items")).alias("budget"))).alias("payload"))


def literals_of(source: str) -> list[tuple[int, str, str]]:
    """(line, type, value) of the constants in Python source, docstrings and none aside."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError):
        return []
    docs = {id(n.body[0].value) for n in ast.walk(tree) if isinstance(n, (ast.Module, ast.FunctionDef, ast.ClassDef, ast.AsyncFunctionDef)) and n.body and isinstance(n.body[0], ast.Expr)}
    return [(n.lineno, type(n.value).__name__, str(n.value)) for n in ast.walk(tree) if isinstance(n, ast.Constant) and n.value is not None and n.value is not ... and id(n) not in docs]


def invented_literals(sources: DataFrame, approved: DataFrame) -> DataFrame:
    """(relative_path, line, type, value) of literals that no approved (type, value) equals; true is not 1."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame([(p, *x) for p, c in zip(frame["relative_path"], frame["content"]) for x in literals_of(c or "")], columns=["relative_path", "line", "type", "value"])

    found = sources.select("relative_path", "content").mapInPandas(run, "relative_path string, line int, type string, value string")
    return found.join(approved.select("type", "value").distinct(), ["type", "value"], "left_anti").select("relative_path", "line", "type", "value")
