"""Operators on small inline rows."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from attestra import ports
from attestra.operators import canon, chunking, codegraph, context, discovery, graph, readiness, retrieval, store, testdata, vector_index
from attestra.sources import documents, files, pages, workbook


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def block(text, kind="paragraph", start=0):
    return {"text": text, "start": start, "end": start + len(text), "kind": kind, "section": None, "location": "p"}


def test_heading_after_table_row_starts_a_chunk():
    got = list(chunking.pack([block("a", "table_row"), block("H", "heading"), block("b")], chunking.Settings(100, 10, 200)))
    assert [c["text"] for c in got] == ["a", "H\n\nb"]


def test_a_piece_that_fills_a_chunk_ends_it():
    got = list(chunking.pack([block("x" * 1200), block("y"), block("z")], chunking.Settings()))
    assert [len(c["text"]) for c in got] == [1200, 4]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab \n", max_size=400), st.integers(4, 60), st.integers(0, 80))
def test_pieces_are_bounded_and_cover_the_text(text, maximum, overlap):
    spans = chunking.pieces(text, maximum, overlap)
    assert all(b - a <= maximum for a, b in spans)
    assert not text or {i for a, b in spans for i in range(a, b)} == set(range(len(text)))
    assert spans == sorted(spans)


def test_pieces_of_a_long_block_are_stripped_and_never_empty():
    text = "x" * 60 + " " + "y" * 30 + " " * 50 + "z"
    got = list(chunking.pack([block(text, start=7)], chunking.Settings(20, 5, 40)))
    assert all(c["text"] == c["text"].strip() != "" for c in got)
    assert (got[0]["start"], got[0]["end"]) == (7, 47)
    assert chunking.Settings().fingerprint == "block-pack-v4-structural-headings:size=1200:overlap=150:max=2000"


def test_blocks_are_normalized_before_they_are_packed(spark):
    rows_ = [("d", 0, " a \t b ", 0, 7, "paragraph", None, "char=0:7"), ("d", 1, " \n ", 9, 12, "paragraph", None, "char=9:12"), ("d", 2, "c", 14, 15, "paragraph", None, "char=14:15")]
    blocks = spark.createDataFrame(rows_, "doc_key string, pos int, text string, start int, end int, kind string, section string, location string")
    (c,) = chunking.chunk_blocks(blocks).collect()
    assert (c["chunk_text"], c["start_char"], c["end_char"], c["source_location"]) == ("a b\n\nc", 0, 15, "char=0:7")


def test_text_blocks_have_spans_sections_and_kinds(spark):
    t = "# Title\n\n  body one \n\n\n- item"
    df = spark.createDataFrame([("d", t)], "doc_key string, text string")
    got = rows(documents.text_blocks(df).select("text", "start", "kind", "section"), "start")
    assert [g[0] for g in got] == ["# Title", "body one", "- item"]
    spans = rows(documents.text_blocks(df).select("start", "end", "location", "paragraph"), "start")
    assert [t[a:b] for a, b, *_ in spans] == ["# Title", "  body one ", "- item"]
    assert [(at, k) for *_, at, k in spans] == [("char=0:7", 1), ("char=9:20", 2), ("char=23:29", 3)]
    assert [g[2:] for g in got] == [("heading", "Title"), ("paragraph", "Title"), ("list_item", "Title")]


def test_a_bare_heading_keeps_the_section(spark):
    df = spark.createDataFrame([("d", "# A\n\nx\n\n##\n\ny")], "doc_key string, text string")
    assert rows(documents.text_blocks(df).select("text", "kind", "section"), "start") == [("# A", "heading", "A"), ("x", "paragraph", "A"), ("##", "heading", "A"), ("y", "paragraph", "A")]


def test_page_lines_without_noise(spark):
    words = [("d", p, 800.0, x, y, y + 8, w) for p in (1, 2) for x, y, w in ((10.0, 20.0, "Header"), (10.0, 100.0, f"body{p}"), (50.0, 101.0, "text"), (10.0, 780.0, f"{p}"), (20.0, 780.5, "/ 2"))]
    df = spark.createDataFrame(words, "doc_key string, page int, page_height double, x double, y0 double, y1 double, word string")
    assert [r["text"] for r in pages.without_page_noise(pages.page_lines(df)).orderBy("page").collect()] == ["body1 text", "body2 text"]


def test_sheet_rows_and_issues(spark):
    cells = [("Oracles", 2, "record_id", "R1"), ("Oracles", 2, "enabled", "yes"), ("Oracles", 2, "name", "n"), ("Oracles", 2, "payload.limit", "5"), ("Oracles", 3, "name", "=A1"), ("Other", 1, "record_id", "x"), ("Oracles", 4, "name", " ")]
    made = workbook.sheet_rows(spark.createDataFrame(cells, "sheet string, row int, column string, value string"))
    records = workbook.records_of(made)
    good = records.filter("record_id = 'R1'").first()
    assert good["enabled"] is True and good["payload"] == '{"limit":"5"}'
    assert {r["message"] for r in workbook.record_issues(records).collect()} == {"formula cell", "enabled is no boolean"}
    assert [r["sheet"] for r in workbook.unknown_sheet_issues(made, ("Oracles",)).collect()] == ["Other"]
    assert workbook.header_issues(["a", "a"], ("a", "b")) == ["duplicate column a", "missing column b"]


def test_budget_skips_and_goes_on(spark):
    df = spark.createDataFrame([("q", k, c) for k, c in enumerate([9, 3, 5, 2])], "anchor string, pos int, cost int")
    got = retrieval.within_budget(df, "anchor", ["pos"], F.col("cost"), 14)
    assert [r["pos"] for r in got.orderBy("kept_pos").collect()] == [0, 1, 3]
    first = retrieval.within_budget(df, "anchor", ["pos"], F.col("cost"), 6)
    assert [r["pos"] for r in first.collect()] == [0]


def test_tier_zero_is_free_and_mandatory(spark):
    df = spark.createDataFrame([("q", 1, 0, "x" * 40), ("q", 0, 0, "y" * 400), ("q", 1, 1, "z" * 8)], "anchor string, tier int, pos int, text string")
    assert sorted((r["tier"], r["pos"]) for r in context.assemble_manifest(df, 5).collect()) == [(0, 0), (1, 1)]


def test_symbol_budget_counts_drops(spark):
    groups = ("matched_symbols", "test_lib_symbols", "neighbor_symbols", "neighbor_symbols", "evidence_chunks")
    df = spark.createDataFrame([("q", k, g, f"s{k}", "x" * 8) for k, g in enumerate(groups)], "anchor string, tier int, group string, key string, json string")
    got = context.apply_budget(df, 100, 3)
    assert got.filter("kept").count() == 4
    assert rows(context.dropped_counts(got)) == [("q", "neighbor_symbols", 1)]


def test_require_subset_fails_on_outsiders(spark):
    some, all_ = spark.createDataFrame([("a",), ("b",)], "k string"), spark.createDataFrame([("a",)], "k string")
    assert retrieval.require_subset(all_, some, "k", "chunks").count() == 1
    with pytest.raises(Exception, match="outside the allowed set"):
        retrieval.require_subset(some, all_, "k", "chunks").collect()


def test_paths_need_an_allowed_edge_and_use_none_twice(spark):
    edges = spark.createDataFrame([("e1", "a", "b", False, "c1", 9), ("e2", "b", "c", True, "c2", 5), ("e3", "c", "a", True, "c3", 2)], "edge_id string, source string, target string, allowed boolean, chunk_id string, sequence_index int")
    start = spark.createDataFrame([("q", "a")], "anchor string, node string")
    assert rows(graph.graph_evidence(start, edges, 1, 9), "chunk_id") == [("q", "c3", 1.0, 1)]
    assert [r[1] for r in rows(graph.graph_evidence(start, edges, 2, 9), "pos")] == ["c3", "c2"]
    found = graph.paths(start, edges, 4)
    assert all(len(set(r["edges"])) == len(r["edges"]) for r in found.collect())


def test_closure_of_a_long_chain(spark):
    refs = spark.createDataFrame([(f"r{k}", f"r{k + 1}") for k in range(60)] + [("r60", "r0")], "from_id string, to_id string")
    got = graph.closure(spark.createDataFrame([("r0", "r0")], "root string, record_id string"), refs)
    assert {r["record_id"]: r["round"] for r in got.collect()} == {f"r{k}": k for k in range(61)}


def test_closures_by_key_and_by_value(spark):
    records = spark.createDataFrame([(x,) for x in "abcd"], "record_id string")
    leaves = spark.createDataFrame([("a", "step_ids", "string", "b"), ("b", "note", "string", "c"), ("c", "next_id", "string", "a")], "record_id string, key string, kind string, value string")
    roots = spark.createDataFrame([("a", "a")], "root string, record_id string")
    assert {r["record_id"] for r in graph.closure_by_key(records, roots, leaves).collect()} == {"a", "b"}
    assert {r["record_id"] for r in graph.closure_by_value(records, roots, leaves).collect()} == {"a", "b", "c"}


def requirement(seq, pos, sid, kind, text, conf=0.5):
    return (seq, pos, f"CHK-{seq}", sid, kind, text, "functional", "high", ["c"], ["e1", "e2"] if pos else ["e1"], conf)


REQ = "sequence_index int, pos int, chunk_id string, source_req_id string, source_req_id_type string, requirement_text string, requirement_type string, priority string, constraints array<string>, entity_ids array<string>, confidence double"
PRIOR = "requirement_id string, source_req_id string, source_req_id_type string, requirement_text string, requirement_type string, priority string"


def test_generated_text_joins_the_source_with_equal_text(spark):
    df = spark.createDataFrame([requirement(0, 0, None, "generated", "the LOCK  opens."), requirement(1, 0, "R-1", "source", "The lock opens.", 0.9), requirement(1, 1, None, "generated", "Other.")], REQ)
    got = {r["requirement_text"]: r for r in canon.merge_requirements(df, spark.createDataFrame([], PRIOR), "p").collect()}
    assert set(got) == {"The lock opens.", "Other."}
    assert got["The lock opens."]["chunk_ids"] == ["CHK-0", "CHK-1"] and got["The lock opens."]["confidence"] == 0.9


def test_prior_identity_is_reused(spark):
    prior = spark.createDataFrame([("REQ-OLD", "R-1", "source", "The lock opens.", "safety", "low")], PRIOR)
    df = spark.createDataFrame([requirement(0, 0, None, "generated", "the lock opens.")], REQ)
    got = canon.merge_requirements(df, prior, "p").first()
    assert (got["requirement_id"], got["requirement_text"], got["requirement_type"], got["priority"]) == ("REQ-OLD", "The lock opens.", "safety", "low")


def test_conflicting_source_texts_are_found(spark):
    df = spark.createDataFrame([requirement(0, 0, "R-1", "source", "A."), requirement(1, 0, "R-1", "source", "B.")], REQ)
    assert rows(canon.source_conflicts(df, spark.createDataFrame([], PRIOR))) == [("R-1", 2)]


def test_null_source_ids_are_equal_in_reuse(spark):
    cols = "source_req_id string, source_req_id_type string, title string, parent string, pos int, confidence double, ev array<string>"
    df = spark.createDataFrame([(None, "generated", "T", "r1", 0, 0.1, ["x"]), (None, "generated", " t ", "r2", 1, 0.3, ["y", "x"])], cols)
    prior = spark.createDataFrame([(None, "generated", "t", "US-OLD")], "source_req_id string, source_req_id_type string, key string, id string")
    from attestra.functions.text import fold

    got = canon.merge_candidates(df, fold(F.col("title")), prior, "US", "p", "parent", ["ev"]).collect()
    assert [(r["id"], r["parents"], r["ev"], r["confidence"]) for r in got] == [("US-OLD", ["r1", "r2"], ["x", "y"], 0.3)]


def test_upsert_is_idempotent_and_verify_fails_on_change(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    once = store.upsert(base, new, ["k"])
    assert rows(once, "k") == rows(store.upsert(once, new, ["k"]), "k") == [(1, "a"), (2, "c"), (3, "d")]
    assert rows(store.insert_or_verify(base, spark.createDataFrame([(2, "b"), (4, "x")], "k int, v string"), ["k"], "v"), "k") == [(1, "a"), (2, "b"), (4, "x")]
    with pytest.raises(Exception, match="differs from the stored row"):
        store.insert_or_verify(base, new, ["k"], "v").collect()


def test_numbers_are_kept_and_go_on(spark):
    old = spark.createDataFrame([("b", 100001)], "k string, number int")
    new = spark.createDataFrame([("a",), ("b",), ("c",)], "k string")
    assert rows(store.allocate_numbers(old, new, "k"), "number") == [("b", 100001), ("a", 100002), ("c", 100003)]


def test_reset_of_a_run_drops_orphans(spark):
    chunks = spark.createDataFrame([("c1", "r1"), ("c2", "r2")], "chunk_id string, run_id string")
    mentions = spark.createDataFrame([("c1", "e1"), ("c2", "e2")], "chunk_id string, entity_id string")
    edges = spark.createDataFrame([("c1", "e1", "e3"), ("c2", "e2", "e4")], "chunk_id string, source_entity_id string, target_entity_id string")
    entities = spark.createDataFrame([(f"e{k}",) for k in range(1, 5)], "entity_id string")
    left = store.reset_run(chunks, mentions, edges, entities, "r1")
    assert {r["entity_id"] for r in left["entities"].collect()} == {"e2", "e4"} and left["edges"].count() == 1


def test_validate_reports_each_rule(spark):
    from attestra import schemas

    records = spark.createDataFrame(
        [
            ("R1", "Oracle", "APPROVED", True, "k", "n", '{"x": "TBD", "password": 5}', "Oracle", 2), ("R1", "Oracle", "DRAFT", True, "k", "n", "{}", "Oracle", 3), ("C1", "Cleanup", "DRAFT", True, "k", "n", "{}", "Cleanup", 2),
            ("P1", "ExecutionProfile", "APPROVED", True, "k", "n", "{}", "ExecutionProfile", 2),
        ], schemas.RECORDS,
    )
    bindings = spark.createDataFrame([("B1", "S1", "P1", None, "C1", "A1", ["R9"], ["R1"], "C1", 1, "APPROVED")], schemas.BINDINGS)
    found = testdata.validate(records, bindings, spark.createDataFrame([("S1",), ("S2",)], "scenario_id string"))
    got = {(r["issue_code"], r["record_id"], r["message"]) for r in found.collect()}
    assert got == {
        ("IDENTITY_DUPLICATE_RECORD_ID", "R1", "record_id 'R1' appears 2 times"), ("SEMANTIC_PLACEHOLDER_VALUE", "R1", "record 'R1' contains placeholder value 'TBD'"),
        ("SEMANTIC_PLAINTEXT_SECRET", "R1", "record 'R1' field 'password' must contain a secret:// reference"), ("REFERENCE_MISSING_FK", "B1", "binding 'B1' references unknown record 'A1'"),
        ("REFERENCE_MISSING_FK", "B1", "binding 'B1' references unknown record 'R9'"), ("REFERENCE_WRONG_TYPE", "B1", "binding 'B1' expects Fixture for 'C1' but found Cleanup"),
        ("SEMANTIC_UNAPPROVED_RECORD", "B1", "binding 'B1' references non-APPROVED 'C1'"), ("COVERAGE_NO_BINDING", "S2", "scenario 'S2' has no approved binding"),
    }
    assert {r["severity"] for r in found.collect()} == {"ERROR"}
    assert testdata.gate(found).first()["status"] == "BLOCKED" and testdata.gate(found.limit(0)).first()["status"] == "READY"


def test_record_types_of_references(spark):
    names = ("execution_profile_id", "fixture_id", "action_sequence_id", "cleanup_id", "timing_policy_id", "oracle_ids", "test_vector_ids", "fault_profile_ids", "safety_rule_ids")
    types = ("ExecutionProfile", "Fixture", "Action", "Cleanup", "TimingPolicy", "Oracle", "TestVector", "FaultProfile", "SafetyRule")
    ddl = ", ".join(f"{n} {'array<string>' if n.endswith('_ids') else 'string'}" for n in names)
    df = spark.createDataFrame([("B", *(["x"] if n.endswith("_ids") else "x" for n in names))], f"binding_id string, {ddl}")
    assert {(r["field"], r["expected_type"]) for r in testdata.references(df).collect()} == set(zip(names, types))


BOUND = "scenario_id string, execution_profile_id string, variant_id string, binding_id string, selection_priority int, approval_status string"


def test_binding_priority_and_ambiguity(spark):
    b = spark.createDataFrame([
        ("S1", "P", None, "b1", 1, "APPROVED"), ("S1", "P", "default", "b2", 2, "APPROVED"), ("S1", "Q", None, "b9", 9, "APPROVED"), ("S1", "P", "v", "b8", 9, "APPROVED"),
        ("S2", "P", None, "b4", 1, "APPROVED"), ("S2", "P", None, "b3", 1, "APPROVED"), ("S2", "P", None, "b0", 0, "APPROVED"), ("S3", "P", None, "b5", 1, "DRAFT"),
    ], BOUND)
    asked = spark.createDataFrame([("S1", "P", None), ("S2", "P", None), ("S3", "P", None)], "scenario_id string, execution_profile_id string, variant_id string")
    got = {r["scenario_id"]: (r["status"], r["binding_id"], r["candidates"]) for r in testdata.resolve_bindings(asked, b).collect()}
    assert got == {"S1": ("READY", "b2", []), "S2": ("BLOCKED_AMBIGUOUS_BINDING", None, ["b3", "b4"]), "S3": ("BLOCKED_MISSING_DATA", None, [])}
    named = spark.createDataFrame([("S1", "P", None, "b1"), ("S1", "P", None, "b9"), ("S2", "P", None, "zz"), ("S3", "P", None, "b5"), ("S2", "P", None, None)], "scenario_id string, execution_profile_id string, variant_id string, binding_id string")
    found = sorted((r["scenario_id"], r["binding_id"] or "", r["status"]) for r in testdata.select_binding(named, b).collect())
    assert found == [("S1", "b1", "READY"), ("S1", "b9", "does_not_match"), ("S2", "", "BLOCKED_AMBIGUOUS_BINDING"), ("S2", "zz", "unavailable"), ("S3", "b5", "does_not_match")]


def test_variants_are_those_of_approved_bindings(spark):
    b = spark.createDataFrame([("S1", "P", None, "b1", 1, "APPROVED"), ("S1", "P", "x", "b2", 1, "DRAFT"), ("S1", "Q", "y", "b3", 1, "APPROVED"), ("S2", "P", "x", "b4", 1, "APPROVED"), ("S2", "P", "y", "b5", 1, "APPROVED")], BOUND)
    s = spark.createDataFrame([("S1",), ("S2",), ("S3",)], "scenario_id string")
    assert rows(testdata.select_variant(b, "P", s), "scenario_id") == [("S1", "default", "selected"), ("S2", None, "several"), ("S3", None, "none")]
    named = spark.createDataFrame([("S1", "y"), ("S2", "y")], "scenario_id string, variant_id string")
    assert rows(testdata.select_variant(b, "P", s, named), "scenario_id") == [("S1", None, "unknown_variant"), ("S2", "y", "selected"), ("S3", None, "none")]


def test_payload_references_of_any_id_field(spark):
    from attestra.functions.json_text import explode_leaves

    payload = '{"binding_id": "B", "scenario_id": "S", "execution_profile_id": "P", "endpoint_id": "E1", "step_ids": ["T1", "", "E1"], "nested": {"deep_id": "N"}, "n_id": 3, "none_ids": null}'
    leaves = explode_leaves(spark.createDataFrame([("B", payload)], "binding_id string, payload string"), "payload")
    assert rows(testdata.payload_references(leaves)) == [("B", ["E1", "T1"])]


def test_capability_decisions(spark):
    c = spark.createDataFrame([("s", k, i, f"{k}{i}", m) for k, ms in {"a": ["partial", "exact"], "b": ["partial", "partial"], "c": ["partial", "compatible"], "d": ["partial"], "e": ["none"]}.items() for i, m in enumerate(ms)], "scenario_id string, capability_id string, pos int, fqn string, match_kind string")
    asked = spark.createDataFrame([("s", k, k in "df") for k in "abcdefg"], "scenario_id string, capability_id string, authorized boolean")
    got = [r[2:] for r in rows(readiness.decide_capability(asked, c), "capability_id")]
    blocked = (None, None, "BLOCKED_MISSING_CAPABILITY")
    assert got == [("reuse", "a1", None), ("compose", "b0", None), ("wrap", "c1", None), ("implement", None, None), blocked, ("implement", None, None), blocked]


def test_gates_are_asked_in_order(spark):
    fails = [(), ("scenario_approved", "bundle_available"), ("worktree_matches_index", "safety_satisfied"), ("framework_modifications_authorized",), ("dependencies_available",), ("schema_conforms", "test_data_snapshot_ready")]
    gates = spark.createDataFrame([(k, "READY", k == 3, *(g not in f for g in readiness.GATES)) for k, f in enumerate(fails)], "k int, binding_status string, framework_modification_required boolean, " + ", ".join(f"{g} boolean" for g in readiness.GATES))
    got = [r[:] for r in rows(readiness.readiness(gates).select("k", "readiness", "failed_check"), "k")]
    assert got == [
        (0, "READY", None), (1, "BLOCKED_MISSING_DATA", "bundle_available"), (2, "BLOCKED_FRAMEWORK_STALE", "worktree_matches_index"), (3, "BLOCKED_AUTHORIZATION", "framework_modifications_authorized"),
        (4, "BLOCKED_DEPENDENCY", "dependencies_available"), (5, "BLOCKED_INVALID_TEST_DATA_DOCUMENT", "test_data_snapshot_ready"),
    ]
    bound = gates.filter("k = 0").withColumn("binding_status", F.lit("BLOCKED_AMBIGUOUS_BINDING"))
    assert rows(readiness.readiness(bound).select("readiness", "failed_check")) == [("BLOCKED_AMBIGUOUS_BINDING", "scenario_data_binding")]


def test_two_phase_activation(spark):
    snaps = spark.createDataFrame([("s1", "r", "ready", True), ("s2", "r", "building", False), ("s3", "q", "ready", True), ("s4", "r", "failed", False)], "snapshot_id string, repository_id string, status string, active boolean")
    none = spark.createDataFrame([], "relative_path string, problem string")
    state = lambda df: {r["snapshot_id"]: (r["status"], r["active"]) for r in df.collect()}
    assert state(readiness.activate(snaps, "s2", none)) == {"s1": ("ready", False), "s2": ("ready", True), "s3": ("ready", True), "s4": ("failed", False)}
    assert state(readiness.activate(snaps, "s1", none)) == state(snaps)
    for wrong, why in (("s9", "unknown snapshot"), ("s4", "is failed, expected building")):
        with pytest.raises(ValueError, match=why):
            readiness.activate(snaps, wrong, none)
    with pytest.raises(ValueError, match="missing"):
        readiness.activate(snaps, "s2", none.union(spark.createDataFrame([("f", "missing")], none.schema)))
    assert state(readiness.mark_failed(snaps, "s2"))["s2"] == ("failed", False) and state(readiness.mark_failed(snaps, "s1")) == state(snaps)


def test_code_graph(spark):
    kinds = spark.createDataFrame([(x,) for x in ("run()", "Motor.run()", "MAX_RPM", "Motor", "rpm", "_x")], "x string").select("x", codegraph.symbol_kind(F.col("x")))
    assert [r[1] for r in kinds.collect()] == ["Function", "Method", "Constant", "Class", "Variable", "Variable"]
    assert codegraph.RELATIONS["uses"] == "REFERENCES" and codegraph.RELATIONS["method"] == "DECLARES" and len(codegraph.RELATIONS) == 13
    nodes = spark.createDataFrame([("f1", "a.py", "code", None, "a.py", None, None), ("n4", "lost()", "code", None, "z.py", "L1", None), ("n1", "run()", "code", None, "a.py", "L3-L9", None), ("n2", "Motor", "code", None, "a.py", "L12", None), ("n3", "note", "doc", None, "r.md", None, None), ("p1", "lib", "package", None, None, None, "2.0")], "id string, label string, file_type string, type string, source_file string, source_location string, version string")
    links = spark.createDataFrame([("n1", "n2", "calls", "L4", None), ("n1", "n2", "calls", "L4", None), ("n1", "n3", "calls", None, None), ("n1", "n2", "likes", None, None), ("n1", "p1", "depends_on", None, None)], "source string, target string, relation string, source_location string, confidence string")
    syms = codegraph.symbols(nodes, "S")
    made = codegraph.edges(links, syms, "S")
    assert rows(syms.select("fqn", "kind", "start_line", "end_line"), "start_line") == [("a.py::run()", "Function", 3, 9), ("a.py::Motor", "Class", 12, 12)]
    assert [(r["relation"], r["confidence"]) for r in made.collect()] == [("CALLS", "EXTRACTED")] and codegraph.extraction_problems(syms, made).isEmpty()
    assert rows(codegraph.package_dependencies(links, nodes)) == [("lib", "2.0")]


def test_quote_spans():
    assert discovery.quote_span("a  b\nc", "b c") == (3, 6) and discovery.quote_span("abc", "x") is None


def test_project_chunk(spark):
    ents = spark.createDataFrame([("c", "e1", "Door", "component", ["D"]), ("c", "e2", "Lock", "component", [])], "chunk_id string, entity_ref string, name string, entity_type string, aliases array<string>")
    rels = spark.createDataFrame([("c", "k", "e1", "USES", "e2", 0.5, "door uses lock")], "chunk_id string, relationship_ref string, source_entity_ref string, relationship_type string, target_entity_ref string, confidence double, evidence_quote string")
    reqs = spark.createDataFrame([("c", "t", ["k"])], "chunk_id string, requirement_text string, relationship_refs array<string>")
    chunks = spark.createDataFrame([("c", "The door  uses lock.", 100)], "chunk_id string, chunk_text string, start_char int")
    nodes, mentions, edges = discovery.project_chunk(ents, rels, reqs, chunks, "P")
    assert nodes.count() == mentions.count() == 2
    assert [(r["evidence_start_char"], r["evidence_end_char"]) for r in edges.collect()] == [(104, 119)]


def test_source_slices_and_tree(spark, tmp_path):
    (tmp_path / "pkg").mkdir()
    (tmp_path / "pkg" / "a.py").write_text("x = 1\ndef f():\n    return 2\n")
    (tmp_path / "pkg" / "b.pyc").write_text("no")
    (tmp_path / "pkg" / "c.LOG").write_text("no")
    (tmp_path / "pkg" / "runtime").mkdir()
    (tmp_path / "pkg" / "runtime" / "d.py").write_text("no")
    entries = files.tree_entries(spark, str(tmp_path))
    assert [r["relative_path"] for r in entries.collect()] == ["pkg/a.py"]
    assert files.tree_checksum(entries).first()["tree_checksum"].startswith("sha256:")
    src = spark.createDataFrame([("a.py", (tmp_path / "pkg" / "a.py").read_text())], "relative_path string, content string")
    funcs = files.python_functions(src)
    got = files.source_slices(funcs, src).first()
    assert got["name"] == "f" and got["intact"] and got["source"] == "def f():\n    return 2"


def test_ports(spark):
    assert ports.requests([5, 5, 5], most_items=2) == [(0, 2), (2, 3)] and ports.requests([]) == []
    with pytest.raises(ValueError):
        ports.requests([9], most_each=5)
    df = ports.embed_column(spark.createDataFrame([(1, "a b"), (2, None)], "k int, t string"), "t", ports.embedder("hashed"))
    assert [len(r["embedding"]) for r in df.collect()] == [64, 64]
    with pytest.raises(KeyError):
        ports.embedder("other")
    other = type("RateLimitError", (Exception,), {})
    coded = type("Odd", (Exception,), {"code": 503}), type("Odd", (Exception,), {"status": "unavailable"}), type("Odd", (Exception,), {"code": 429})
    assert ports.is_transient(other()) and [ports.is_transient(x()) for x in coded] == [True, True, False]
    assert not ports.is_transient(ValueError("429 rate limit, try again"))
    calls = []

    def flaky():
        calls.append(1)
        if len(calls) == 1:
            raise TimeoutError
        return "ok"

    assert ports.once_more(flaky) == "ok" and len(calls) == 2


def test_streaming_ingest(spark, tmp_path):
    from pyspark.sql import types as T

    from attestra.streaming import ingest

    src, out = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()
    (src / "1.json").write_text('{"doc_key": "d", "text": "# T\\n\\nbody"}\n')
    schema = T.StructType.fromDDL("doc_key string, text string")
    for _ in range(2):
        ingest.ingest_documents(ingest.stream_json(spark, str(src), schema), out, str(tmp_path / "cp"), "p").awaitTermination()
        assert spark.read.parquet(out).count() == 1
    (src / "2.json").write_text('{"doc_key": "e", "text": "more"}\n')
    ingest.ingest_documents(ingest.stream_json(spark, str(src), schema), out, str(tmp_path / "cp"), "p").awaitTermination()
    assert spark.read.parquet(out).count() == 2


def test_markers_and_framing(spark):
    df = spark.createDataFrame([("It shall never stop while hot, up to 5 psi or 2.5 within 3 s.", "It shall stop.")], "a string, b string")
    assert rows(df.select(discovery.lost_markers(F.col("a"), F.col("b")))) == [(["never", "while", "up to", "5 psi", "within", "3 s"],)]
    framed = spark.createDataFrame([("Definition of Done: the feature is complete when: the door opens",)], "a string")
    assert rows(framed.select(discovery.unframed(F.col("a")))) == [("the door opens",)]


def test_lineage_keeps_order_and_fails_on_unknown_ids(spark):
    stories = spark.createDataFrame([("s1", ["r2", "r1"]), ("s2", ["r1", "r3"])], "story_id string, requirement_ids array<string>")
    reqs = spark.createDataFrame([("r1",), ("r2",), ("r3",)], "requirement_id string")
    scen = spark.createDataFrame([("x", ["s2", "s1"])], "scenario_id string, story_ids array<string>")
    assert rows(retrieval.scenario_lineage(scen, stories, reqs)) == [("x", ["s2", "s1"], ["r1", "r3", "r2"])]
    with pytest.raises(Exception, match="unresolved"):
        retrieval.story_requirements(stories, reqs.filter("requirement_id <> 'r3'")).collect()


def test_rows_are_numbered_over_ranges(spark):
    df = spark.createDataFrame([(k * 7 % 100,) for k in range(100)], "k int").repartition(5)
    assert rows(graph.numbered(df, ["k"], "n"), "k") == [(k, k) for k in range(100)]


def test_sinks_refuse_what_the_store_must_not_hold(spark):
    vectors = lambda *v: spark.createDataFrame([(k, list(x)) for k, x in enumerate(v)], "k int, embedding array<double>")
    assert store.upsert_vectors(vectors(), vectors([1.0]), ["k"]).count() == 1
    for bad in ([float("nan")], [float("inf"), 1.0], []):
        with pytest.raises(Exception, match="finite"):
            store.upsert_vectors(vectors(), vectors(bad), ["k"]).collect()
    edges = spark.createDataFrame([("USES",), ("LIKES",)], "relationship_type string")
    assert store.typed_edges(edges.limit(1)).count() == 1
    with pytest.raises(Exception, match="unsupported relationship type"):
        store.typed_edges(edges).collect()


def test_bridges_accumulate(spark):
    base = spark.createDataFrame([("a", 1), ("b", 1)], "id string, v int")
    new = spark.createDataFrame([("a", 2, ["y", "z", "y"])], "id string, v int, items array<string>")
    bridge = spark.createDataFrame([("a", "x"), ("b", "x")], "id string, item string")
    parents, tables = store.upsert_with_children(base, new, ["id"], {"bridge": (bridge, "items", "item")})
    assert rows(parents, "id") == [("a", 2), ("b", 1)] and rows(tables["bridge"], "id", "item") == [("a", "x"), ("a", "y"), ("a", "z"), ("b", "x")]


def test_project_delete_takes_children_first(spark):
    parents = spark.createDataFrame([("p", 1), ("q", 2)], "project string, id int")
    steps = spark.createDataFrame([(1, "s"), (2, "t")], "id int, step string")
    left = store.project_delete({"cases": parents, "steps": steps}, "p", {"steps": ("cases", "id")})
    assert list(left) == ["steps", "cases"] and rows(left["steps"]) == [(2, "t")] and rows(left["cases"]) == [("q", 2)]


def test_workbook_manifest_bindings_and_issues(spark):
    cells = [("w", "Manifest", 1, 0, "Key"), ("w", "Manifest", 1, 1, "Value"), ("w", "Manifest", 2, 0, " project "), ("w", "Manifest", 2, 1, "p"), ("w", "Manifest", 3, 0, "schema_version"), ("w", "Manifest", 3, 1, "1")]
    manifest = workbook.manifest_of(spark.createDataFrame(cells, "workbook string, sheet string, row int, col int, value string"))
    assert {r["key"]: r["value"] for r in manifest.collect()} == {"project": "p", "schema_version": "1"}
    assert [r["missing"] for r in workbook.manifest_problems(manifest).collect()] == ["workbook_checksum"]
    fields = {"binding_id": "B1", "scenario_id": "S", "execution_profile_id": "P", "fixture_id": "F", "cleanup_id": "C", "approval_status": "APPROVED", "oracle_ids": "O1, O2 ,"}
    cells = [("Bindings", k, c, v) for k, skip in ((2, ""), (3, "fixture_id"), (4, "oracle_ids")) for c, v in fields.items() if c != skip]
    bound = workbook.bindings_of(workbook.sheet_rows(spark.createDataFrame(cells, "sheet string, row int, column string, value string")))
    first = bound.filter("source_row = 2").first()
    assert (first["oracle_ids"], first["variant_id"], first["selection_priority"]) == (["O1", "O2"], "default", 0)
    found = sorted((r["issue_code"], r["message"]) for r in workbook.binding_issues(bound).collect())
    assert found == [("STRUCT_BINDING_INVALID", "fixture_id: required"), ("STRUCT_BINDING_INVALID", "oracle_ids: at least one"), *[("STRUCT_DUPLICATE_BINDING_ID", "duplicate binding_id 'B1'")] * 2]


def test_json_documents(spark):
    text = '{"manifest": {"project": "p"}, "records": [{"record_id": "R"}, 5], "bindings": ["x"]}'
    manifest, records, bindings = workbook.read_json_documents(spark.createDataFrame([("d", text)], "doc_key string, text string"))
    assert rows(manifest) == [("d", "project", "p")]
    assert [(r["issue_code"], r["row"]) for r in workbook.object_issues(records, "RECORD").collect()] == [("STRUCT_RECORD_NOT_OBJECT", 2)]
    assert [r["message"] for r in workbook.object_issues(bindings, "BINDING").collect()] == ["binding at position 0 is not an object"]


def test_helper_files_and_extractions(spark):
    paths = ["test_lib/door/door_wrappers.py", "test_lib/door/door_helpers.py", "test_lib/door/lock_helpers.py", "test_lib/Pump/Pump_helpers.py", "lib/door/door_helpers.py"]
    df = spark.createDataFrame([(p, "") for p in paths], "relative_path string, content string")
    assert sorted(r[0] for r in files.helper_files(df).collect()) == sorted([paths[0], paths[1], paths[3]])
    assert [r[0] for r in files.helper_files(df, ("pump",)).collect()] == [paths[3]]
    found = spark.createDataFrame([("a", "graph.json", '{"nodes": []}'), ("a", ".graphify_ast.json", '{"nodes": [1]}'), ("a", ".graphify_extract.json", "{}"), ("b", "other.json", '{"nodes": []}')], "folder string, name string, text string")
    assert rows(files.choose_extraction(found)) == [("a", ".graphify_ast.json", '{"nodes": [1]}')]


def test_a_line_is_measured_from_its_first_word(spark):
    words = [("d", 1, 800.0, x, y, y + 8, w) for x, y, w in ((50.0, 100.0, "b"), (10.0, 102.0, "a"), (90.0, 104.0, "c"), (10.0, 105.0, "d"))]
    df = spark.createDataFrame(words, "doc_key string, page int, page_height double, x double, y0 double, y1 double, word string")
    assert [r["text"] for r in pages.page_lines(df).orderBy("line").collect()] == ["a b", "d c"]


def test_styled_paragraphs(spark):
    rows_ = [("d", 1, " Title ", "Heading 1"), ("d", 2, "  ", None), ("d", 3, "body  text", "Normal")]
    got = documents.styled_blocks(spark.createDataFrame(rows_, "doc_key string, paragraph int, text string, style string"))
    assert rows(got.select("text", "start", "end", "kind", "section", "location"), "start") == [("Title", 0, 5, "heading", "Title", "paragraph=1"), ("body text", 6, 16, "paragraph", "Title", "paragraph=3")]


def test_embedding_responses_are_put_in_order():
    assert ports.ordered_vectors([(1, [2.0]), (0, [1.0])], 2) == ([[1.0], [2.0]], 1)
    for bad in ([(0, [1.0])], [(0, [1.0]), (0, [1.0])], [(0, [1.0]), (2, [1.0])], [(0, [1.0]), (1, [1.0, 2.0])], [(0, [1.0]), (1, [float("nan")])], [(0, [1.0]), (True, [1.0])]):
        with pytest.raises(ValueError):
            ports.ordered_vectors(bad, 2)


def test_bundles_have_records_and_their_provenance(spark):
    from attestra import schemas

    records = spark.createDataFrame([(r, t, s, True, "k", "n", '{"a": 1}', t, 2) for r, t, s in (("P", "ExecutionProfile", "APPROVED"), ("F", "Fixture", "APPROVED"), ("C", "Cleanup", "APPROVED"), ("O2", "Oracle", "APPROVED"), ("O1", "Oracle", "APPROVED"), ("X", "Oracle", "DRAFT"))], schemas.RECORDS)
    bound = lambda oracles, status: spark.createDataFrame([("B", "S", "P", None, "F", None, [], oracles, "C", 1, status)], schemas.BINDINGS)
    assert testdata.bundles(bound(["O2", "O1"], "APPROVED"), records).first()["refs"] == {"Cleanup": ["C"], "ExecutionProfile": ["P"], "Fixture": ["F"], "Oracle": ["O1", "O2"]}
    found = testdata.bundle_provenance(bound(["O1"], "APPROVED"), records).collect()
    assert {r["record_id"] for r in found} == {"P", "F", "C", "O1"} and all(r["record_checksum"].startswith("sha256:") and r["source_row"] == 2 for r in found)
    for oracles, what in ((["X"], "non-APPROVED"), (["Z"], "unknown")):
        with pytest.raises(Exception, match=what):
            testdata.bundles(bound(oracles, "APPROVED"), records).collect()
    assert testdata.bundles(bound(["X"], "DRAFT"), records).count() == 0


def test_case_numbers_of_more_customers_than_six_digits_have(spark, tmp_path):
    from attestra.plans.table_queries import case_numbers

    spark.createDataFrame([(k,) for k in (500_000, 500_001, 500_002)], "c_custkey long").write.parquet(f"{tmp_path}/customer.parquet")
    assert {tuple(r) for r in case_numbers(spark, str(tmp_path)).collect()} == {(500_000, 1_100_001), (500_001, 1_100_002), (500_002, 1_100_003)}
    some = spark.createDataFrame([("a", 999_999)], "k string, number int")
    with pytest.raises(Exception, match="used up"):
        store.allocate_numbers(some, spark.createDataFrame([("b",)], "k string"), "k").collect()


def test_issues_of_a_manifest_read_its_chunks_once(spark):
    from attestra.functions.ids import content_hash
    from attestra.operators.chunking import manifest_issues

    good = ("persisted", "persisted", 0, 4)
    made = [("ok", "i1", "text", 0, *good), ("ok", "i2", "text", 1, *good), ("two", "i", "text", 0, *good), ("two", "i", "text", 1, *good), ("gap", "i", "text", 1, *good), ("empty", "i", "", 0, *good)]
    made += [("null", None, "text", 0, *good), ("null", None, "text", 1, *good), ("back", "i", "text", 0, "persisted", "pending", 4, 0), ("hash", "i", "text", 0, None, "persisted", 0, 4)]
    kind = "doc_key string, chunk_id string, chunk_text string, sequence_index int, graph_status string, vector_status string, start_char int, end_char int"
    hashed = F.when(F.col("doc_key") == "hash", "sha256:0").otherwise(content_hash(F.col("chunk_text")))
    chunks = spark.createDataFrame(made, kind).withColumn("content_hash", hashed)
    issues = manifest_issues(chunks.mapInArrow(lambda batches: batches, chunks.schema))
    assert issues._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    assert {tuple(r) for r in issues.collect()} == {
        ("two", "DUPLICATE_CHUNK_ID"), ("null", "DUPLICATE_CHUNK_ID"), ("gap", "INDEX_NOT_CONTIGUOUS"), ("empty", "EMPTY_CHUNK"), ("back", "SPAN_REVERSED"), ("back", "NOT_PERSISTED"), ("hash", "HASH_MISMATCH")}
