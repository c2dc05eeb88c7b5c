"""Additive sources, extractions as a data source, documents by suffix, projections."""

import ast
import json
import random

import pytest
from pyspark.sql import functions as F

from attestra.functions.ids import canonical_checksum
from attestra.operators import additive, projection, readiness, records
from attestra.schemas import CODE_RELATIONS
from attestra.sources import documents, extractions, workbook

FILES = "relative_path string, content string"
OLD = "import os\nX = 1\n\n\ndef one(a):\n    if a:\n        return 1\n    return 2\n\n\nclass C:\n    y = 3\n\n    def m(self):\n        return 4\n"
CASES = {
    "same": (OLD, set()),
    "comments": ("# new\n" + OLD.replace("return 2", "return  2  # two"), set()),
    "appended": (OLD + "\n\ndef two():\n    return 1\n\n\nasync def three():\n    pass\n", set()),
    "body": (OLD.replace("return 1", "return 9"), {"changed at /body[2]/body[0]/body[0]"}),
    "method": (OLD.replace("return 4", "return 5"), {"changed at /body[3]/body[1]/body[0]"}),
    "signature": (OLD.replace("one(a)", "one(a, b=1)"), {"changed at /body[2]"}),
    "decorator": (OLD.replace("def one", "@cache\ndef one"), {"changed at /body[2]"}),
    "removed": (OLD[: OLD.index("class")], {"removed at /body[3]/body[0]", "removed at /body[3]/body[1]/body[0]"}),
    "inserted": (OLD.replace("X = 1", "X = 1\nY = 2"), {"changed at /body[2]", "changed at /body[3]", "only functions may be appended, not ClassDef", "removed at /body[2]/body[0]/body[0]", "removed at /body[2]/body[1]", "removed at /body[3]/body[1]/body[0]"}),
    "statement": (OLD + "\nZ = 1\n", {"only functions may be appended, not Assign"}),
    "known": (OLD + "\n\ndef one():\n    pass\n\n\ndef os():\n    pass\n\n\ndef C():\n    pass\n", {f"appended function name is not unique: {n}" for n in ("one", "os", "C")}),
    "twice": (OLD + "\n\ndef two():\n    pass\n\n\ndef two():\n    pass\n", {"appended function name is not unique: two"}),
    "broken": (OLD + "def", {"cannot be parsed"}),
}


def test_additive_and_other_changes(spark):
    before = additive.syntax_trees(spark.createDataFrame([(k, OLD) for k in CASES] + [("gone", OLD)], FILES))
    after = additive.syntax_trees(spark.createDataFrame([(k, new) for k, (new, _) in CASES.items()] + [("new", OLD)], FILES))
    found = {k: set() for k in CASES}
    for r in additive.additive_issues(before, after).collect():
        found[r["relative_path"]].add("cannot be parsed" if r["code"] == additive.UNREADABLE else r["message"])
    assert {k for k, v in found.items() if not v} == {"same", "comments", "appended"}
    for name in ("body", "method", "signature", "decorator", "statement", "known", "twice", "broken"):
        assert found[name] == CASES[name][1], name
    assert all(m.startswith("removed") for m in found["removed"]) and any("at /body[2]" in m for m in found["inserted"])


def test_digests_are_equal_exactly_where_trees_are():
    rng = random.Random(3)
    parts = ["x", "1", "1.0", "True", "'1'", "b'1'", "None", "(x, 1)", "[x]", "x + 1", "x - 1", "f(x)", "f(x=1)", "lambda x: x", "f'{x}'", "x.y", "x[1:2]", "-x", "not x", "x if x else 1", "{1: x, **y}"]
    trees = [ast.parse(f"def f({rng.choice('ab')}):\n    y = {rng.choice(parts)}\n    return {rng.choice(parts)}") for _ in range(400)]
    by_digest = {}
    for t in trees:
        by_digest.setdefault(additive.digests(t)[id(t)], set()).add(ast.dump(t))
    assert all(len(v) == 1 for v in by_digest.values()) and len(by_digest) == len({ast.dump(t) for t in trees})


def test_extractions_by_format_name(spark, tmp_path):
    for name, files in {"a": {"graph.json": {"nodes": [{"id": "n1", "label": "x", "type": 3}], "links": [{"source": "n1", "target": "n1"}]}}, "b/c": {".graphify_ast.json": {"nodes": [{"id": "m"}], "edges": []}, ".graphify_extract.json": {"other": 1}}}.items():
        folder = tmp_path / name
        folder.mkdir(parents=True)
        for file, data in files.items():
            (folder / file).write_text(json.dumps(data))
    extractions.register(spark)
    nodes = spark.read.format("attestra_extraction").load(str(tmp_path))
    assert sorted((r["folder"], r["id"], r["type"]) for r in nodes.collect()) == [("a", "n1", "3"), ("b/c", "m", None)]
    assert nodes.rdd.getNumPartitions() == 2
    only = nodes.filter("folder = 'a'")
    assert only.rdd.getNumPartitions() == 1 and [r["id"] for r in only.collect()] == ["n1"]
    links = spark.read.format("attestra_extraction").option("table", "links").load(str(tmp_path))
    assert [(r["folder"], r["source"]) for r in links.collect()] == [("a", "n1")]
    (tmp_path / "a" / "graph.json").write_text("[]")
    with pytest.raises(Exception, match="no usable extraction"):
        spark.read.format("attestra_extraction").load(str(tmp_path)).collect()
    with pytest.raises(Exception, match="table is one of"):
        spark.read.format("attestra_extraction").option("table", "x").load(str(tmp_path)).collect()


def test_documents_go_by_suffix(spark, tmp_path):
    (tmp_path / "a.TXT").write_text("One.\n\nTwo.")
    (tmp_path / "b.bin").write_bytes(b"xyz")
    block = {"text": "xyz", "start": 0, "end": 3, "kind": "paragraph", "section": None, "location": "p", "paragraph": 1}
    got = documents.read_documents(spark, str(tmp_path), {".BIN": lambda content: [block | {"text": content.decode()}]})
    assert sorted((r["doc_key"].rpartition("/")[2], r["pos"], r["text"]) for r in got.collect()) == [("a.TXT", 0, "One."), ("a.TXT", 1, "Two."), ("b.bin", 0, "xyz")]
    with pytest.raises(Exception, match="unsupported document type: .bin"):
        documents.read_documents(spark, str(tmp_path)).collect()


def test_edges_of_snapshots_and_cases(spark):
    recs = spark.createDataFrame([("R1",), ("R2",)], "record_id string")
    bindings = spark.createDataFrame([("B1", "S1", "P1", "R1", None, ["R2", "", "R1"])], "binding_id string, scenario_id string, execution_profile_id string, fixture_id string, cleanup_id string, oracle_ids array<string>")
    got = {(r["source"], r["relation"], r["target"]) for r in projection.test_data_edges(recs, bindings, "T").collect()}
    assert got == {("T", "HAS_RECORD", "R1"), ("T", "HAS_RECORD", "R2"), ("S1", "HAS_DATA_BINDING", "B1"), ("B1", "FOR_PROFILE", "P1"), ("B1", "USES_RECORD", "R1"), ("B1", "USES_RECORD", "R2")}
    kind = "tc_id int, status string, scenario_id string, story_ids array<string>, requirement_ids array<string>, test_data_snapshot_id string, framework_snapshot_id string, generated_files array<string>"
    case = (100001, "ACCEPTED", "S1", ["U1", "U1"], ["Q1", "Q2"], "T", "F", ["a.py"])
    got = {(r["source"], r["relation"], r["target"]) for r in projection.case_edges(spark.createDataFrame([case], kind)).collect()}
    assert got == {("100001", *x) for x in (("IMPLEMENTS", "S1"), ("TRACES_TO", "U1"), ("VERIFIES", "Q1"), ("VERIFIES", "Q2"), ("USES_TEST_DATA", "T"), ("GENERATED_IN", "F"), ("GENERATED_FILE", "a.py"))}
    for bad in ((*case[:1], "FAILED", *case[2:]), (*case[:6], None, case[7])):
        with pytest.raises(Exception, match="only accepted cases"):
            projection.case_edges(spark.createDataFrame([bad], kind)).collect()


def test_runs_end_with_their_frozen_ids_in_order(spark):
    frozen = spark.createDataFrame([("a", 0, "s"), ("a", 1, "t"), ("b", 0, "s")], "run_id string, pos int, scenario_id string")
    results = lambda rows: spark.createDataFrame(rows, "run_id string, pos int, scenario_id string, status string")
    ok = [("a", 0, "s", "ACCEPTED"), ("a", 1, "t", "ACCEPTED"), ("b", 0, "s", "FAILED")]
    assert {r["run_id"]: r["run_status"] for r in readiness.run_exit(frozen, results(ok)).collect()} == {"a": "COMPLETED", "b": "PARTIAL_FAILED"}
    swapped = [("a", 0, "t", "ACCEPTED"), ("a", 1, "s", "ACCEPTED"), ok[2]]
    for bad in (ok[1:], swapped, [*ok, ("b", 1, "t", "ACCEPTED")]):
        with pytest.raises(Exception, match="expected"):
            readiness.run_exit(frozen, results(bad)).collect()


def test_fingerprint_of_a_case(spark):
    parts = {"scenario": {"id": "s\"1", "n": [1, 2]}, "execution_profile_id": "p", "variant_id": None, "test_data_checksum": "sha256:x", "provider_fingerprint": {"b": 1, "a": None}, "generation_policy_version": "v1"}
    row = spark.createDataFrame([(json.dumps(parts["scenario"]), "p", None, "sha256:x", json.dumps(parts["provider_fingerprint"]), "v1")], "a string, b string, c string, d string, e string, f string")
    assert row.select(records.input_fingerprint(*(F.col(c) for c in "abcdef"))).first()[0] == canonical_checksum(parts)


def test_date_cells_as_iso_text(spark):
    df = spark.sql("select date'2024-02-03' d, timestamp_ntz'2024-02-03 04:05:06' t, timestamp_ntz'2024-02-03 04:05:06.25' u, 7 n")
    kinds = dict(df.dtypes)
    assert tuple(df.select(*(workbook.iso_cell(F.col(c), kinds[c]) for c in "dtun")).first()) == ("2024-02-03", "2024-02-03T04:05:06", "2024-02-03T04:05:06.250000", "7")


def test_relations_of_the_code_graph():
    assert CODE_RELATIONS == ("CALLS", "CONTAINS", "DECLARES", "DECORATED_BY", "IMPLEMENTS", "IMPORTS", "INHERITS", "REFERENCES", "RETURNS")
