"""Versions of tables: commits, conflicts, parts."""

import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from attestra import schemas
from attestra.operators import commits
from attestra.operators.commits import CommitConflict, Table


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def stamps(root, part):
    """Names and times of a part's data files."""
    of = commits.F and part.encode().hex().upper()
    return {p.name: p.stat().st_mtime_ns for p in Path(root).rglob(f"_part={of}/*.parquet")}


@pytest.fixture
def table(spark, tmp_path):
    t = Table(spark, str(tmp_path / "t"), "project")
    t.overwrite(spark.createDataFrame([("p", 1, "a"), ("p", 2, "b"), ("q/..", 1, "c"), ("r", 3, "d")], "project string, id int, v string"))
    return t


def test_readers_see_the_last_version(spark, tmp_path):
    root = str(tmp_path / "t")
    with pytest.raises(FileNotFoundError):
        commits.read_published(spark, root)
    assert commits.publish(spark.range(3), root).number == 1
    old = commits.read_published(spark, root)
    assert commits.publish(spark.range(1, 3), root).number == 2
    assert rows(commits.read_published(spark, root)) == [(1,), (2,)] and old.count() == 3
    commits.publish(spark.range(0), root)
    assert commits.read_published(spark, root).count() == 0


def test_a_writer_that_stops_between_the_steps_changes_nothing(spark, table, monkeypatch):
    before = rows(table.read())
    monkeypatch.setattr(Table, "commit", lambda *_: (_ for _ in ()).throw(RuntimeError("stopped")))
    with pytest.raises(RuntimeError, match="stopped"):
        table.overwrite(spark.createDataFrame([("p", 9, "z")], "project string, id int, v string"))
    with pytest.raises(RuntimeError, match="stopped"):
        table.delete(["p"])
    monkeypatch.undo()
    assert rows(table.read()) == before and table.version().number == 1
    assert table.collect_garbage() == 1 and rows(table.read()) == before
    assert table.delete(["p"]).number == 2


def test_of_two_writers_one_loses(spark, table):
    base = table.version()
    new = lambda v: spark.createDataFrame([("p", 1, v)], "project string, id int, v string")
    table.overwrite(new("first"), base)
    for late in (lambda: table.overwrite(new("second"), base), lambda: table.delete(["q/.."], base)):
        with pytest.raises(CommitConflict):
            late()
    assert rows(table.read(["p"])) == [("p", 1, "first")] and table.version().number == 2
    assert not os.listdir(Path(table.root) / "staged") or all(n.startswith(".") for n in os.listdir(Path(table.root) / "staged"))


def test_files_of_other_parts_keep_names_and_times(spark, table):
    q, r = stamps(table.root, "q/.."), stamps(table.root, "r")
    assert len(q) == len(r) == 1
    table.upsert(spark.createDataFrame([("p", 2, "new"), ("p", 5, "e")], "project string, id int, v string"), ["project", "id"])
    assert rows(table.read(["p"])) == [("p", 1, "a"), ("p", 2, "new"), ("p", 5, "e")]
    table.delete(["p"])
    assert rows(table.read()) == [("q/..", 1, "c"), ("r", 3, "d")]
    assert (stamps(table.root, "q/.."), stamps(table.root, "r")) == (q, r)
    assert table.read(["p"]).count() == 0 and rows(table.read(["q/.."])) == [("q/..", 1, "c")]


def test_a_part_is_read_without_the_others(table):
    files = table.read(["r"]).inputFiles()
    assert files and all("_part=72/" in f for f in files)


def test_rows_without_a_part_are_refused(spark, table):
    with pytest.raises(ValueError, match="project"):
        table.overwrite(spark.createDataFrame([(None, 1, "a")], "project string, id int, v string"))


def test_projects_go_with_children_first(spark, table, tmp_path):
    steps = Table(spark, str(tmp_path / "steps"))
    steps.overwrite(spark.createDataFrame([(1, "s"), (2, "t"), (3, "u")], "id int, step string"))
    done = commits.delete_project({"cases": table, "steps": steps}, "p", {"steps": ("cases", "id")})
    assert list(done) == ["steps", "cases"]
    assert rows(table.read()) == [("q/..", 1, "c"), ("r", 3, "d")] and rows(steps.read()) == [(3, "u")]


@pytest.mark.parametrize("name", ["", "..", "a/b", "/a", "a..b", "a\\b", ".hidden", "x y"])
def test_names_cannot_leave_their_folder(name):
    with pytest.raises(ValueError):
        commits.safe_name(name)


def test_stored_rows_are_checked_again(spark, tmp_path):
    root = str(tmp_path / "t")
    commits.publish(spark.createDataFrame([("c", 5, 2)], "chunk string, a int, b int"), root)
    df, ddl = commits.read_published(spark, root), "chunk string, a int, b int"
    assert schemas.load_checked(df, ddl, df.filter("a < b")).count() == 1
    with pytest.raises(ValueError, match="break their rules"):
        schemas.load_checked(df, ddl, df.filter("a > b"))
    with pytest.raises(ValueError, match="schema differs"):
        schemas.load_checked(df.withColumn("a", F.col("a").cast("long")), ddl)
