"""File trees, JSON lines, code-graph extractions and Python functions as tables."""

from __future__ import annotations

import ast
import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed values.
EXCLUDED_DIRS = (
    ".git", ".global_cache", ".graphify_python", ".mypy_cache", ".pytest_cache", ".ruff_cache", ".tox", ".venv", ".vscode", "__pycache__",
    "generated", "graphify-out", "logs", "node_modules", "runtime", "venv",
)
EXCLUDED_SUFFIXES = (".log", ".pyc", ".pyo", ".tmp")
#: Files of an extraction, the first of which that has nodes counts.
EXTRACTION_FILES = (".graphify_extract.json", ".graphify_ast.json", "graph.json")


def tree_entries(spark: SparkSession, root: str) -> DataFrame:
    """(relative_path, size, digest) of the files below ``root``, without excluded folders and suffixes."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    path = F.regexp_replace(F.col("path"), "^file:/+", "/")
    relative = F.expr(f"substring(regexp_replace(path, '^file:/+', '/'), {len(root.rstrip('/')) + 2})")
    rows = found.select(path.alias("path"), relative.alias("relative_path"), F.col("length").alias("size"), F.sha2("content", 256).alias("digest")).drop("path")
    inside = "|".join(x.replace(".", r"\.") for x in EXCLUDED_DIRS)
    suffix = "|".join(x.replace(".", r"\.") for x in EXCLUDED_SUFFIXES)
    return rows.filter(~F.col("relative_path").rlike(f"(^|/)({inside})/") & ~F.lower("relative_path").rlike(f"({suffix})$"))


def case_collisions(entries: DataFrame) -> DataFrame:
    """(folded, paths) of paths that differ by case only."""
    return entries.groupBy(F.lower("relative_path").alias("folded")).agg(F.array_sort(F.collect_set("relative_path")).alias("paths")).filter(F.size("paths") > 1)


def tree_checksum(entries: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """One digest over path, zero, digest and line end of all entries in path order; a framework's tree is one group."""
    held = F.array_sort(F.collect_list(F.struct("relative_path", "digest")))
    text = F.array_join(F.transform(held, lambda x: F.concat(x["relative_path"], F.decode(F.unhex(F.lit("00")), "UTF-8"), x["digest"], F.lit("\n"))), "")
    return entries.groupBy(*by).agg(F.concat(F.lit("sha256:"), F.sha2(text, 256)).alias("tree_checksum"))


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).json(path)


def latest_per_key(rows: DataFrame, key: str, order: Column, position: str) -> DataFrame:
    """Over all runs: the last value of each key, at its first position."""
    last = Window.partitionBy(key).orderBy(order.desc(), F.col(position).desc())
    whole = Window.partitionBy(key)
    return rows.withColumn("rank", F.row_number().over(last)).withColumn("first_position", F.min(position).over(whole)).filter("rank = 1").drop("rank", position).withColumnRenamed("first_position", position)


def code_graph_tables(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, links) of rows with arrays ``nodes`` and ``links`` or ``edges``."""
    links = F.coalesce(*(F.col(c) for c in ("edges", "links") if c in raw.columns))
    return raw.select(F.explode("nodes").alias("n")).select("n.*"), raw.select(F.explode(links).alias("l")).select("l.*")


def helper_files(files: DataFrame, modules: tuple[str, ...] = ()) -> DataFrame:
    """Of (relative_path, content) the wrapper and helper files of test_lib, named after their folder; of ``modules`` only, in any case, if there are any."""
    module = F.regexp_extract("relative_path", r"^test_lib/([^/]+)/\1_(?:wrappers|helpers)\.py$", 1)
    found = files.filter(module != "")
    return found.filter(F.lower(module).isin(*(m.lower() for m in modules))) if any(modules) else found


def choose_extraction(texts: DataFrame) -> DataFrame:
    """Of (folder, name, text) JSON files, the first of ``EXTRACTION_FILES`` in each folder that has nodes."""
    order = F.array_position(F.array(*(F.lit(x) for x in EXTRACTION_FILES)), F.col("name"))
    usable = texts.filter((order > 0) & F.get_json_object("text", "$.nodes").isNotNull()).withColumn("_at", order)
    return usable.groupBy("folder").agg(F.min_by(F.struct("name", "text"), "_at").alias("x")).select("folder", "x.*")


def functions_of(source: str) -> list[tuple[str, int, int, str]]:
    """(name, first line, last line, body digest) of functions at any depth; none if the source does not parse."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError):
        return []
    lines = source.split("\n")
    found = [n for n in ast.walk(tree) if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef))]
    return [(n.name, n.lineno, n.end_lineno, hashlib.sha256("\n".join(lines[n.lineno - 1 : n.end_lineno]).encode()).hexdigest()) for n in sorted(found, key=lambda n: n.lineno)]


def python_functions(files: DataFrame) -> DataFrame:
    """(relative_path, content) to (relative_path, name, start_line, end_line, body_hash)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(p, *f) for p, c in zip(frame["relative_path"], frame["content"]) for f in functions_of(c or "")]
            yield pd.DataFrame(rows, columns=["relative_path", "name", "start_line", "end_line", "body_hash"])

    return files.select("relative_path", "content").mapInPandas(run, "relative_path string, name string, start_line int, end_line int, body_hash string")


def source_slices(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """Lines of each symbol from its file, and whether they still have the symbol's hash."""
    joined = symbols.join(files.select("relative_path", "content"), "relative_path", "left")
    cut = F.array_join(F.slice(F.split("content", "\n"), F.col("start_line"), F.col("end_line") - F.col("start_line") + 1), "\n")
    return joined.withColumn("source", cut).drop("content").withColumn("intact", F.coalesce(F.sha2("source", 256) == F.col("body_hash"), F.lit(False)))
