"""Raw code-graph extractions to files, symbols, edges and package dependencies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestra.functions.ids import stable_id

#: Names of relations in extractions, and the code graph's; other relations go.
RELATIONS = {
    "calls": "CALLS", "indirect_call": "CALLS", "uses": "REFERENCES", "references": "REFERENCES", "contains": "CONTAINS", "method": "DECLARES", "declares": "DECLARES", "inherits": "INHERITS",
    "implements": "IMPLEMENTS", "imports": "IMPORTS", "imports_from": "IMPORTS", "decorated_by": "DECORATED_BY", "returns": "RETURNS",
}
CONFIDENCES = ("EXTRACTED", "INFERRED", "AMBIGUOUS")
FILE_SUFFIX = r"(?i)\.(py|robot)$"


def line_span(location: Column) -> tuple[Column, Column]:
    """Least and greatest line of locations such as L12 or L12-L20; 1 where there is none."""
    numbers = F.transform(F.regexp_extract_all(F.coalesce(location, F.lit("")), F.lit(r"L(\d+)"), 1), lambda x: x.cast("int"))
    return F.coalesce(F.array_min(numbers), F.lit(1)), F.coalesce(F.array_max(numbers), F.lit(1))


def symbol_kind(label: Column) -> Column:
    """A label with () is a function, or a method if a dot is in it; one in capitals a constant; one that starts with a capital a class; any other a variable."""
    return (
        F.when(label.endswith("()"), F.when(label.contains("."), "Method").otherwise("Function"))
        .when(label.rlike(r"^\p{Lu}") & ~label.rlike(r"\p{Ll}"), "Constant")
        .when(label.rlike(r"^\p{Lu}"), "Class")
        .otherwise("Variable")
    )


def code_files(nodes: DataFrame, snapshot_id: str) -> DataFrame:
    """(snapshot_id, relative_path, language) of the code nodes that are files, each path once."""
    path = F.replace(F.col("source_file"), F.lit("\\"), F.lit("/"))
    found = nodes.filter((F.col("file_type") == "code") & F.col("label").rlike(FILE_SUFFIX)).select(path.alias("relative_path")).filter("relative_path <> ''").distinct()
    return found.select(F.lit(snapshot_id).alias("snapshot_id"), "relative_path", F.when(F.lower("relative_path").endswith(".robot"), "robot").otherwise("python").alias("language"))


def symbols(nodes: DataFrame, snapshot_id: str) -> DataFrame:
    """Code nodes of known Python files, named by path and label; files, packages, suites and nodes without a label go."""
    first, last = line_span(F.col("source_location"))
    path, label = F.replace(F.col("source_file"), F.lit("\\"), F.lit("/")), F.trim("label")
    code = nodes.filter((F.col("file_type") == "code") & ~F.col("label").rlike(FILE_SUFFIX) & (F.coalesce("type", F.lit("")) != "package") & (label != ""))
    code = code.withColumn("relative_path", path).withColumn("name", label).filter(~F.lower("relative_path").endswith(".robot")).join(code_files(nodes, snapshot_id).select("relative_path"), "relative_path", "left_semi")
    kind, fqn = symbol_kind(F.col("name")), F.concat(F.col("relative_path"), F.lit("::"), F.col("name"))
    sid = stable_id("SYM", F.lit(snapshot_id), fqn, kind, first, last)
    signature = F.when(F.col("name").endswith("()"), F.col("name"))
    return code.select(F.lit(snapshot_id).alias("snapshot_id"), F.col("id").alias("node_id"), sid.alias("symbol_id"), fqn.alias("fqn"), kind.alias("kind"), signature.alias("signature"), "relative_path", first.alias("start_line"), last.alias("end_line"))


def edges(links: DataFrame, syms: DataFrame, snapshot_id: str) -> DataFrame:
    """Links of known relations between known symbols, each once."""
    names = F.create_map(*(F.lit(x) for pair in RELATIONS.items() for x in pair))
    mapped = links.withColumn("rel", F.try_element_at(names, F.col("relation"))).filter("rel IS NOT NULL")
    end = lambda side: syms.select(F.col("node_id").alias(side), F.col("symbol_id").alias(f"{side}_symbol_id"))
    joined = mapped.join(end("source"), "source").join(end("target"), "target")
    eid = stable_id("EDG", F.lit(snapshot_id), F.col("source_symbol_id"), F.col("rel"), F.col("target_symbol_id"), F.col("source_location"))
    said = F.upper("confidence")
    confidence = F.when(said.isin(*CONFIDENCES), said).otherwise("EXTRACTED")
    out = joined.select(F.lit(snapshot_id).alias("snapshot_id"), eid.alias("edge_id"), "source_symbol_id", "target_symbol_id", F.col("rel").alias("relation"), confidence.alias("confidence"), "source_location")
    return out.dropDuplicates(["edge_id"])


def package_dependencies(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """(name, version) of packages that something depends on; the first by node id for each name."""
    named = links.filter("relation = 'depends_on'").join(nodes.select(F.col("id").alias("target"), F.col("label").alias("name"), "version"), "target")
    w = Window.partitionBy("name").orderBy("target")
    return named.select("target", "name", "version").distinct().withColumn("n", F.row_number().over(w)).filter("n = 1").select("name", "version")


def extraction_problems(syms: DataFrame, code_edges: DataFrame) -> DataFrame:
    """(problem, id): repeated symbols, repeated edges, edges without an end."""
    twice = syms.groupBy("symbol_id", "node_id").count().filter("count > 1").select(F.lit("DUPLICATE_SYMBOL").alias("problem"), F.col("symbol_id").alias("id"))
    again = code_edges.groupBy("edge_id").count().filter("count > 1").select(F.lit("DUPLICATE_EDGE").alias("problem"), F.col("edge_id").alias("id"))
    ids = syms.select("symbol_id").distinct()
    ends = code_edges.select("edge_id", F.explode(F.array("source_symbol_id", "target_symbol_id")).alias("symbol_id"))
    loose = ends.join(ids, "symbol_id", "left_anti").select(F.lit("DANGLING_EDGE").alias("problem"), F.col("edge_id").alias("id")).distinct()
    return twice.unionByName(again).unionByName(loose)
