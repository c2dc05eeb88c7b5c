"""Settings, accepted cases, frozen runs, paths and literals."""

import json

import pytest
from pyspark.sql import functions as F

from attestra import schemas, settings
from attestra.operators import records


def test_settings_precedence(tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"vector_k": 5, "graph_k": 7}))
    got = settings.load(str(tmp_path / "c.json"), {"ATTESTRA_VECTOR_K": "9", "ATTESTRA_MAX_HOPS": " "})
    assert (got.vector_k, got.graph_k, got.max_hops) == (9, 7, 2)
    (tmp_path / "d.json").write_text('{"other": 1}')
    with pytest.raises(ValueError):
        settings.load(str(tmp_path / "d.json"), {})


def test_accepted_rows_do_not_change(spark):
    old = spark.createDataFrame([(1, "a", "ACCEPTED"), (2, "b", "OPEN")], "k int, c string, status string")
    new = spark.createDataFrame([(1, "a"), (1, "x"), (2, "y"), (3, "z")], "k int, c string")
    assert sorted((r["k"], r["c"], r["action"]) for r in records.classify_writes(new, old, "k", "c").collect()) == [(1, "a", "no_op"), (1, "x", "conflict"), (2, "y", "insert"), (3, "z", "insert")]


def test_path_classes(spark):
    classes = {
        "tests/door/Tc100001Opens.py": "test", "tests/door/Tc000001Opens.py": None, "tests/door/Tc100001opens.py": None, "tests/door/__init__.py": "init", "test_lib/door/__init__.py": "init",
        "tests_robot/door/Tc100002Opens.robot": "robot", "test_lib/door/door_wrappers.py": "wrapper", "test_lib/door/door_helpers.py": "helper", "test_lib/door/lock_helpers.py": None,
        "../test_lib/door/door_helpers.py": None, "/tests/door/Tc100001Opens.py": None, "tests//Tc100001Opens.py": None, "setup.py": None,
    }
    df = spark.createDataFrame([(p,) for p in classes], "p string")
    assert {r["p"]: r["c"] for r in df.select("p", records.path_class(F.col("p")).alias("c")).collect()} == classes


def test_run_id_has_time_and_a_token():
    import re

    assert re.fullmatch(r"RUN-\d{8}T\d{6}Z-[0-9A-F]{6}", records.run_id("p"))


def test_frozen_order(spark):
    rows = spark.createDataFrame([(1, "S2", None, "b"), (0, "S1", "v", "a")], "pos int, scenario_id string, variant_id string, title string")
    frozen = records.frozen_rows(rows, "p", "x")
    assert all(r["case_key"].startswith("LKH-") and r["checksum"].startswith("sha256:") for r in frozen.collect())
    assert [r["scenario_id"] for r in records.in_frozen_order(frozen, rows).collect()] == ["S1", "S2"]
    with pytest.raises(Exception, match="scenario is missing"):
        records.in_frozen_order(frozen, rows.filter("pos = 0")).collect()


def test_invented_literals(spark):
    src = spark.createDataFrame([("t.py", '"""doc"""\nx = 1\ny = True\nz = "ok"\n'), ("bad.py", "def (")], "relative_path string, content string")
    approved = spark.createDataFrame([("int", "1"), ("str", "ok")], "type string, value string")
    assert [tuple(r) for r in records.invented_literals(src, approved).collect()] == [("t.py", 3, "bool", "True")]


def test_context_rows_nest_the_budget(spark):
    df = spark.createDataFrame([("q", 1, 0, "a", 3), ("q", 0, 0, "b", 2)], "anchor string, tier int, pos int, item_id string, cost int")
    got = json.loads(records.context_rows(df).first()["payload"])
    assert got["budget"] == {"selected_tokens": 5, "n_items": 2} and [i["item_id"] for i in got["items"]] == ["b", "a"]


def test_schema_is_checked(spark):
    df = spark.createDataFrame([("p", "c", "e")], schemas.MENTIONS)
    assert schemas.assert_schema(df.select("entity_id", "project", "chunk_id"), schemas.MENTIONS).columns == ["project", "chunk_id", "entity_id"]
    with pytest.raises(ValueError, match="extra"):
        schemas.assert_schema(df.withColumn("x", F.lit(1)), schemas.MENTIONS)


def test_settings_of_sections_kinds_and_limits(tmp_path):
    file = tmp_path / "c.json"
    file.write_text(json.dumps({"chunking": {"maximum_chunk_size": 900, "other": 1}, "retrieval": {"top_k": 3, "max_hops": ""}, "stage4": {"retain_referenced_snapshots": False, "framework_allowed_roots": ["a", "b"]}, "postgres": {"mode": "x"}}))
    (tmp_path / ".env").write_text("# no\nATTESTRA_LOG_LEVEL = 'DEBUG'\nATTESTRA_VECTOR_K=4\nnothing\n")
    got = settings.load(str(file), {"ATTESTRA_VECTOR_K": "9", "ATTESTRA_CONCURRENCY": "3"}, env_file=str(tmp_path / ".env"))
    assert (got.chunk_maximum, got.retrieval_top_k, got.max_hops, got.vector_k, got.concurrency, got.log_level) == (900, 3, 2, 9, 3, "DEBUG")
    assert got.retain_referenced_snapshots is False and got.framework_allowed_roots == ("a", "b")
    assert settings.load(None, {"ATTESTRA_FRAMEWORK_ALLOWED_ROOTS": "x, y", "ATTESTRA_RETAIN_REFERENCED_SNAPSHOTS": "off"}).framework_allowed_roots == ("x", "y")
    for bad in ({"MAX_HOPS": "5"}, {"TOKEN_BUDGET": "100"}, {"VECTOR_K": "many"}, {"RETAIN_REFERENCED_SNAPSHOTS": "perhaps"}, {"CHUNK_OVERLAP": "2000"}):
        with pytest.raises(ValueError):
            settings.load(None, {f"ATTESTRA_{k}": v for k, v in bad.items()})
