"""Pairs of windows and items that decontamination compares."""

import random

from pyspark.sql import functions as F

from attestra.llm import decontaminate as dc
from attestra.llm.common import materialize


def test_windows_meet_few_items_of_their_length(spark):
    """2,000 items of one length that begin with one phrase; documents with an item, and with the phrase alone."""
    rng = random.Random(3)
    fresh = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    phrase = fresh(8)
    items = [(k, " ".join(phrase + fresh(22))) for k in range(2_000)]
    docs = [(k, " ".join(fresh(40) + items[7 * k][1].split() + fresh(40))) for k in range(60)] + [(100 + k, " ".join(fresh(30) + phrase + fresh(30))) for k in range(200)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = dc.of_rows(spark.createDataFrame(docs, "doc_id long, text string"))
    prepared = materialize(dc.prepare_items(bench))
    laid = materialize(dc.lay_windows(rows, prepared, [dc.SHINGLE], dc.PERCENT))
    windows = laid.select("key", "n", "size", "start").distinct()
    assert laid.count() == windows.count() == 60  # not one for each item that has the phrase
    near = dc.probed_pairs(laid, dc.fingerprints(rows, windows, [dc.SHINGLE]), prepared)
    assert near.count() == 60
    found = sorted((r["doc_id"], r["item_id"], r["start_word"]) for r in dc.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect())
    assert found == [(k, 7 * k, 40) for k in range(60)]


def test_recall_at_the_radius(spark):
    """Windows at a similarity of 0.8 or more to an item of 50 words, with a few words replaced: at least 999 of 1,000 are within the radius, and all of those are found."""
    rng = random.Random(4)
    fresh = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    items, docs, sure = [], [], set()
    grams = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    for k in range(600):
        w = fresh(50)
        near = w[:]
        for at in rng.sample([0, 1, 2, 3, 47, 48, 49, rng.randrange(50)], rng.randint(1, 3)):
            near[at] = "edit"
        items.append((k, " ".join(w)))
        docs.append((k, " ".join(fresh(20) + near + fresh(20))))
        if 100 * len(grams(w) & grams(near)) >= 80 * len(grams(w) | grams(near)):
            sure.add(k)
    assert len(sure) > 300
    got = dc.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    found = {r["doc_id"] for r in got.filter(F.col("doc_id") == F.col("item_id")).collect()}
    assert len(sure - found) <= len(sure) / 1_000 and found <= sure
