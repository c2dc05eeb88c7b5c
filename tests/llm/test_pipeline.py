"""The pipeline's stages on a small corpus, each judged on its own input."""

import corpus_pipeline
import __spark_entry__
from attestra.llm import minhash
from attestra.llm.common import materialize


def test_stages(spark, corpus, words, tmp_path):
    import random

    rng = random.Random(14)
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    item = text(30)
    rows = [*corpus, (900, f"{text(20)} {item} {text(20)}", "en", "s", 1), (901, "junk %%% *** " * 20, "en", "s", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, sizes = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, materialize(stage(spark, docs, str(tmp_path)))
        sizes.append(docs.count())
        ids = {r["doc_id"] for r in docs.collect()}
        if name != "sentencepiece":
            assert docs.columns == columns
        if name == "quality rules":
            assert 901 not in ids and 900 in ids and 0 in ids
        if name == "minhash near-dedup":
            assert {0, 1} <= ids and not ids & {30, 31, 32}
            assert ids == {r["doc_id"] for r in minhash.near_duplicates(before, 5).filter("kept").collect()}
        if name == "substring dedup":
            assert docs.count() == before.count() and all(r["n_chars"] == len(r["text"]) for r in docs.collect())
        if name == "benchmark decontamination":
            assert 900 not in ids and docs.count() == before.count() - 1
        if name == "sentencepiece":
            assert all(r["round_trip"] for r in docs.collect())
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == sizes[-1]


def test_near_dedup_keeps_one_of_repeated_rows(spark):
    rows = [(5, "a b c d e f g", "en"), (5, "a b c d e f g", "en"), (5, "q r s t u v w", "en"), (6, "h i j k l m n", "en"), (None, "x y", "en"), (None, "x y", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = corpus_pipeline.near_dedup(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, spark.createDataFrame(rows[1:], docs.schema).collect()))


def test_pipeline_of_odd_and_empty_tables(spark, words, tmp_path):
    import random

    rng = random.Random(15)
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    a, b, item = text(60), text(60), text(30)
    rows = [(None, a, 1, 60), (None, a, 2, 60), (3, b, 3, 60), (3, b, 4, 60), (4, None, 5, None), (5, "", 6, 0), (6, f"{text(20)} {item} {text(20)}", 7, 1), (None, f"{text(20)} {item}", 8, 1), (7, text(60), 9, 1)]
    ddl = "doc_id long, text string, hashes int, n_chars int"
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame(rows, ddl)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, str(tmp_path)))
        assert docs.columns == ["doc_id", "text", "hashes", "n_chars"], name
    left = {r["hashes"]: r["text"] for r in docs.collect()}
    # texts that are null or empty fail the rules; of equal rows one stays; of texts without an id both stay, the later one empty
    assert set(left) == {1, 2, 3, 9} and sorted((left[1], left[2])) == sorted((a, "")) and left[3] == b
    ids = {r["doc_id"] for r in corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()}
    assert ids == {None, 3, 7}
    none = spark.createDataFrame([], ddl)
    for name, stage in corpus_pipeline.STAGES:
        none = materialize(stage(spark, none, str(tmp_path)))
        assert none.count() == 0, name


def test_each_operator_is_registered():
    names = __spark_entry__.queries()
    assert all(any(x.startswith(f"op{n}_") for x in names) for n in range(1, 11)) and "pipeline" in names
