"""Text, identity and JSON functions on small inline rows."""

import hashlib

import pytest
from pyspark.sql import functions as F

from attestra.functions import ids, json_text, text


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "made, value, expected",
    [
        (text.normalize_text, " a  b \n\n\n\n c\t d ", "a b\n\nc d"),
        (text.collapse, " a  b\n c ", "a b c"),
        (text.fold, " Straße  X ", "strasse x"),
        (text.slug, "  My Project! (v2) ", "my-project-v2"),
        (text.slug, "***", "project"),
        (text.singular, "entities", "entity"),
        (text.singular, "class", "class"),
        (text.singular, "sensors", "sensor"),
        (text.pascal_title, "check the door-lock 2x", "CheckTheDoorLock2x"),
        (text.is_one_sentence, "The lock shall open.", True),
        (text.is_one_sentence, "It opens. It shuts.", False),
        (text.is_one_sentence, 'The lock says "open."', True),
        (text.is_one_sentence, 'The lock says "open." ', False),
        (text.is_one_sentence, "The  lock opens.", False),
        (text.is_one_sentence, "The lock says (open.)", True),
        (text.is_one_sentence, "The lock opens in 2.5 s.", True),
        (text.is_one_sentence, "It opens. And then", False),
        (text.sentences, 'It says "Go!" Then\n it stops.', ['It says "Go!"', "Then it stops."]),
        (text.is_heading, "0.1 Scope", False),
        (text.is_heading, "# Scope", False),
        (text.is_heading, "3. Scope", True),
        (text.is_heading, "3 " + "x" * 120, False),
        (text.sentences, "One. Two! three", ["One.", "Two!", "three"]),
        (text.count_words, "  a b  c ", 3),
        (text.count_quarters, "abc", 1),
        (text.ipv4_literals, "at 10.0.0.1 and 300.1.1.1 or 1.2.3.4.5", ["10.0.0.1"]),
        (text.is_safe_relative, "a/../b", False),
        (text.is_safe_relative, "a/b.py", True),
        (text.is_heading, "2.1 Scope", True),
    ],
)
def test_text_functions(spark, made, value, expected):
    assert one(spark, made(F.col("v")), v=value) == expected


def test_query_terms_are_distinct_and_in_order(spark):
    assert one(spark, text.query_terms(F.col("v"), 3), v="The Door opens the door and 12ab Motor when is runs into") == ["door", "opens", "motor"]


def test_explicit_rows_and_quotes(spark):
    t = "BR-COM-001 The lock shall open.\nother\nBR-COM-002 It shall shut."
    assert [tuple(r) for r in one(spark, text.explicit_rows(F.col("v")), v=t)] == [("BR-COM-001", "The lock shall open."), ("BR-COM-002", "It shall shut.")]
    assert one(spark, text.quote_candidates(F.col("v")), v=t)[:2] == ["The lock shall open.", "It shall shut."]
    twice = "BR-1 A.\x0bBR-2  B.\u2028BR-1 C."
    assert [tuple(r) for r in one(spark, text.explicit_rows(F.col("v")), v=twice)] == [("BR-1", "C."), ("BR-2", "B.")]


def test_query_terms_leave_out_the_stop_words(spark):
    assert one(spark, text.query_terms(F.col("v")), v="and are for from into should that the then this when with") == []


def test_null_part_keeps_its_place(spark):
    got = one(spark, ids.stable_token(F.col("a"), F.col("b"), F.lit(3)), a=None, b="x")
    assert got == hashlib.sha256(b"|x|3").hexdigest().upper()[:20]


def test_checksum_ignores_key_order_and_time():
    assert ids.canonical_checksum({"a": 1, "b": "é", "generated_at": 1}) == ids.canonical_checksum({"b": "é", "a": 1, "checksum": "z"})


def test_leaves_placeholders_and_secrets(spark):
    df = spark.createDataFrame([("r", '{"a": {"b_ids": ["x", "TBD"]}, "password": "hunter", "api_token": "secret://k", "n": 1, "e": " ", "pin_secret": 7, "Credential": " ", "token": "", "secret": null}')], "record_id string, payload string")
    rows = json_text.explode_leaves(df, "payload").withColumn("p", json_text.is_placeholder(F.col("value"))).withColumn("s", json_text.is_plain_secret(F.col("key"), F.col("value"), F.col("kind"))).orderBy("pos").collect()
    assert [r["path"] for r in rows] == ["a.b_ids[0]", "a.b_ids[1]", "password", "api_token", "n", "e", "pin_secret", "Credential", "token", "secret"]
    assert [r["key"] for r in rows][:2] == ["b_ids", "b_ids"]
    assert [r["p"] for r in rows] == [False, True, False, False, False, True, False, True, True, False]
    assert [r["s"] for r in rows] == [False, False, True, False, False, False, True, True, False, False]


def test_last_json_object():
    assert json_text.last_json_object('<think>{"x": 0}</think> ```json\n{"a": {"b": 1}} and {"c": 2}\n``` {') == '{"c": 2}'
    assert json_text.last_json_object("none {") is None


def test_lines_are_read_once_and_not_once_an_id(spark):
    lines = [f"BR-{k % 300} text {k}." for k in range(400)]
    frame = spark.createDataFrame([("\n".join(lines),), (None,), ("no rows",)], "v string").select(text.explicit_rows(F.col("v")).alias("x"))
    assert frame._jdf.queryExecution().analyzed().toString().count("split(") == 1
    found, none, empty = [r["x"] for r in frame.collect()]
    assert [tuple(r) for r in found] == [(f"BR-{k}", f"text {k + 300 if k < 100 else k}.") for k in range(300)] and none is None and empty == []
