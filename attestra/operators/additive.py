"""Whether new source only adds to old source: trees of digests, compared by place. Nothing is run.

A module becomes a table of its statements. A statement's place is its number in the body
that holds it, after the place of its holder; its digest is that of its whole syntax
tree, made of its children's digests, so equal digests are equal trees whatever lines or
comments. Old and new tables meet by place.
"""

from __future__ import annotations

import ast
import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TREE = "relative_path string, place string, holder string, position int, kind string, names array<string>, line int, digest string, error string"
COLUMNS = [x.split()[0] for x in TREE.split(", ")]
FUNCTIONS = ("FunctionDef", "AsyncFunctionDef")
CHANGED, UNREADABLE = "EXISTING_BEHAVIOR_CHANGE_FORBIDDEN", "ADDITIVE_AST_PARSE_ERROR"


def digests(tree: ast.AST) -> dict[int, str]:
    """Digest of each node by its identity, children first; places in the source play no part."""
    found: dict[int, str] = {}

    def said(value: object) -> str:
        if isinstance(value, ast.AST):
            return found[id(value)]
        return f"[{','.join(map(said, value))}]" if isinstance(value, list) else f"{type(value).__name__}:{value!r}"

    waiting: list[tuple[ast.AST, bool]] = [(tree, False)]
    while waiting:
        node, ready = waiting.pop()
        if not ready:
            waiting.append((node, True))
            waiting += [(child, False) for child in ast.iter_child_nodes(node)]
        elif id(node) not in found:  # nodes without fields are shared between places
            fields = ";".join(f"{name}={said(value)}" for name, value in ast.iter_fields(node))
            found[id(node)] = hashlib.sha256(f"{type(node).__name__}({fields})".encode("utf-8", "surrogatepass")).hexdigest()
    return found


def names_of(node: ast.stmt) -> list[str]:
    """Names that a statement of a module binds: of functions and classes, imports and assignments."""
    match node:
        case ast.FunctionDef() | ast.AsyncFunctionDef() | ast.ClassDef():
            return [node.name]
        case ast.Import():
            return [a.asname or a.name.partition(".")[0] for a in node.names]
        case ast.ImportFrom():
            return [a.asname or a.name for a in node.names]
        case ast.Assign():
            targets = node.targets
        case ast.AnnAssign():
            targets = [node.target]
        case _:
            return []
    return sorted({n.id for t in targets for n in ast.walk(t) if isinstance(n, ast.Name)})


def tree_rows(path: str, source: str) -> Iterator[tuple]:
    """Rows of ``TREE`` of one module; a source that can't be parsed is one row with an error."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError) as error:
        yield path, None, None, None, None, None, getattr(error, "lineno", None), None, f"line {getattr(error, 'lineno', None)}: {getattr(error, 'msg', error)}"
        return
    of = digests(tree)
    waiting: list[tuple[str, ast.AST]] = [("", tree)]
    while waiting:
        place, holder = waiting.pop()
        bodies = [(name, value) for name, value in ast.iter_fields(holder) if isinstance(value, list) and value and isinstance(value[0], ast.stmt)]
        for name, body in bodies:
            for k, node in enumerate(body):
                own = f"{place}/{name}[{k}]"
                yield path, own, place, k, type(node).__name__, names_of(node), node.lineno, of[id(node)], None
                waiting.append((own, node))


def syntax_trees(files: DataFrame) -> DataFrame:
    """(relative_path, content) of Python modules to their statements (``TREE``)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [r for path, source in zip(frame["relative_path"], frame["content"]) for r in tree_rows(path, source or "")]
            out = pd.DataFrame(rows, columns=COLUMNS)
            yield out.astype({"position": "Int32", "line": "Int32"})

    return files.select("relative_path", "content").mapInPandas(run, TREE)


def changed_statements(before: DataFrame, after: DataFrame) -> DataFrame:
    """(relative_path, place, change, line): statements of ``before`` that ``after`` lacks at their place, or has otherwise; of nested ones the innermost."""
    new = after.filter("error IS NULL").select("relative_path", "place", F.col("digest").alias("_new"), F.col("line").alias("_line"))
    both = before.filter("error IS NULL").join(new, ["relative_path", "place"], "left").filter("_new IS NULL OR _new <> digest")
    change = F.when(F.col("_new").isNull(), "removed").otherwise("changed")
    found = both.select("relative_path", "place", "holder", change.alias("change"), F.coalesce("_line", "line").alias("line"))
    outer = found.select("relative_path", F.col("holder").alias("place")).distinct()
    return found.join(outer, ["relative_path", "place"], "left_anti").drop("holder")


def additive_issues(before: DataFrame, after: DataFrame) -> DataFrame:
    """(relative_path, code, message, line): why ``after`` isn't ``before`` with functions of new names at the end.

    Both are ``syntax_trees``; files that only one of them has play no part. A file may
    have several issues.
    """
    files = before.select("relative_path").distinct().join(after.select("relative_path").distinct(), "relative_path", "left_semi")
    old, new = (t.join(files, "relative_path", "left_semi") for t in (before, after))
    bad = old.unionByName(new).filter("error IS NOT NULL")
    broken = bad.select("relative_path").distinct()
    old, new = (t.join(broken, "relative_path", "left_anti") for t in (old, new))
    issue = lambda df, code, message: df.select("relative_path", F.lit(code).alias("code"), message.alias("message"), "line")
    sizes = old.filter("holder = ''").groupBy("relative_path").agg(F.count("*").alias("_n"))
    known = old.filter("holder = ''").select("relative_path", F.explode("names").alias("name")).distinct()
    added = new.filter("holder = ''").join(sizes, "relative_path", "left").filter(F.col("position") >= F.coalesce("_n", F.lit(0)))
    functions = added.filter(F.col("kind").isin(*FUNCTIONS)).withColumn("name", F.col("names")[0])
    earlier = functions.groupBy("relative_path", "name").agg(F.min("position").alias("_first"))
    taken = functions.join(known, ["relative_path", "name"], "left_semi").unionByName(functions.join(earlier, ["relative_path", "name"]).filter("position > _first").select(*functions.columns)).distinct()
    return (
        issue(bad, UNREADABLE, F.concat(F.lit("cannot be parsed: "), "error"))
        .unionByName(issue(changed_statements(old, new), CHANGED, F.concat("change", F.lit(" at "), "place")))
        .unionByName(issue(added.filter(~F.col("kind").isin(*FUNCTIONS)), CHANGED, F.concat(F.lit("only functions may be appended, not "), "kind")))
        .unionByName(issue(taken, CHANGED, F.concat(F.lit("appended function name is not unique: "), "name")))
    )
