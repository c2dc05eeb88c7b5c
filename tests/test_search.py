"""Vectors, levels and orders of graphs."""

import random
from collections import deque

import numpy as np
import pytest
from pyspark.sql import functions as F

from attestra.operators import context, graph, vector_index
from attestra.operators.vector_index import InvertedFile, nearest

VEC = "vec_id long, embedding array<float>"


def clustered(n, d, seed):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((20, d)) * 3
    return (centres[rng.integers(0, 20, n)] + rng.standard_normal((n, d))).astype(np.float32)


@pytest.mark.parametrize("block", [4096, 7])
def test_exact_neighbours_equal_brute_force(spark, block):
    rows = clustered(300, 6, 1)
    rows[50:60] = rows[0]  # ties
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(rows)] + [(900, None), (901, [None] * 6)], VEC).repartition(5)
    asked = df.filter("vec_id % 10 = 0").withColumnRenamed("vec_id", "query_id")
    got = {}
    for r in nearest(asked, df, 4, block).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["distance"]))
    exact = rows.astype(float)
    for q in range(0, 300, 10):
        d = np.square(exact - exact[q]).sum(axis=1)
        want = sorted(range(300), key=lambda k: (round(d[k], 12), k))[:4]
        assert [v for _, v, _ in sorted(got[q])] == want and np.allclose([x for *_, x in sorted(got[q])], d[want])
    assert set(got) == set(range(0, 300, 10))


def test_many_candidates_are_settled_on_the_way(spark, monkeypatch):
    rows = clustered(3_000, 3, 4).astype(float)
    best = vector_index.Nearest(rows[:500], 2)
    for at in range(0, 3_000, 100):
        best.add(np.arange(at, at + 100), rows[at : at + 100])
    query, distance, ids = best.settle()
    d = np.square(rows[:500, None, :] - rows[None, :, :]).sum(axis=2)
    assert np.allclose(distance.reshape(500, 2), np.sort(d, axis=1)[:, :2]) and (ids.reshape(500, 2)[:, 0] == np.arange(500)).all()


def test_recall_of_the_inverted_file(spark, tmp_path):
    rows = clustered(4_000, 16, 2)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(rows)] + [(9_999, None)], VEC)
    index = InvertedFile.build(df, str(tmp_path / "ivf"), 32, sample_rows=1_000)
    assert index.read().count() == 4_000 and index.centroids.shape == (32, 16)
    asked = df.filter("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id")
    exact = nearest(asked, df, 10)
    found = index.search(asked, 10, probes=8)
    assert vector_index.recall(found, exact) >= 0.9 and found.count() == 400
    same = found.withColumnRenamed("distance", "d").join(exact, ["query_id", "vec_id"]).filter(F.abs(F.col("d") - F.col("distance")) > 1e-9)
    assert same.isEmpty()
    assert index.search(asked, 10, probes=32, block=11).drop("rank").exceptAll(exact.drop("rank")).isEmpty()
    assert "list" in index.read([3]).select("list").distinct().columns and {r["list"] for r in index.read([3]).select("list").distinct().collect()} == {3}


def test_the_first_block_measures_few_pairs(monkeypatch):
    rng, real, sizes = np.random.default_rng(4), vector_index.exact_distances, []
    monkeypatch.setattr(vector_index, "exact_distances", lambda *a: sizes.append(len(out := real(*a))) or out)
    queries, rows = rng.random((1_000, 16)), rng.random((2_000, 16))
    best = vector_index.Nearest(queries, 12)
    for at in range(0, len(rows), 500):
        best.add(np.arange(at, at + 500), rows[at : at + 500])
    assert max(sizes) < 10_000  # of 500,000 pairs a part
    ids = best.settle()[2]
    true = np.square(queries[:, None, :] - rows[None, :, :]).sum(axis=2)
    assert (ids.reshape(1_000, 12) == np.argsort(true, axis=1, kind="stable")[:, :12]).all()


def test_an_index_of_nothing(spark, tmp_path):
    index = InvertedFile.build(spark.createDataFrame([(1, [1.0, 2.0])], VEC), str(tmp_path / "one"), 8)
    assert index.search(spark.createDataFrame([(5, [0.0, 0.0])], "query_id long, embedding array<float>"), 3, 2).collect()[0]["vec_id"] == 1
    assert nearest(spark.createDataFrame([], "query_id long, embedding array<float>"), index.read().select("vec_id", "embedding"), 3).count() == 0


EDGE = "edge_id string, source string, target string, allowed boolean, chunk_id string, sequence_index int"


def test_levels_give_the_edges_of_paths(spark):
    rng = random.Random(6)
    for hops in (1, 2, 3):
        edges = [(f"e{k}", rng.choice("abcdefgh"), rng.choice("abcdefgh"), rng.random() < 0.4, f"c{k % 7}", k % 5) for k in range(14)]
        df = spark.createDataFrame(edges, EDGE)
        starts = spark.createDataFrame([(x, x) for x in "abz"], "anchor string, node string")
        trails = graph.paths(starts, df, hops).select("anchor", F.explode("allowed_edges").alias("edge_id")).distinct()
        want = {(r["anchor"], r["chunk_id"]) for r in trails.join(df, "edge_id").select("anchor", "chunk_id").collect()}
        assert {(r["anchor"], r["chunk_id"]) for r in graph.graph_evidence(starts, df, hops, 100).collect()} == want


def test_a_hub_makes_as_many_rows_as_it_has_edges(spark):
    hub = spark.range(10_000).select(F.concat(F.lit("e"), "id").alias("edge_id"), F.lit("hub").alias("source"), F.concat(F.lit("n"), "id").alias("target"), F.lit(True).alias("allowed"), F.concat(F.lit("c"), F.col("id") % 100).alias("chunk_id"), F.lit(0).alias("sequence_index"))
    starts = spark.createDataFrame([("x", "n5"), ("y", "n6")], "anchor string, node string")
    got = graph.graph_evidence(starts, hub, 4, 1_000)
    assert got.count() == 200 and "array<string>" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_first_chunks_of_anchors_need_no_pairs_of_them(spark):
    rng = random.Random(8)
    edges = [(f"e{k}", rng.choice("abcdefgh"), rng.choice("abcdefgh"), rng.random() < 0.5, f"c{k % 9}", rng.randint(0, 4)) for k in range(18)]
    df, starts = spark.createDataFrame(edges, EDGE), spark.createDataFrame([(x, x) for x in "abcz"], "anchor string, node string")
    for hops in (1, 2, 3):
        whole = graph.paths(starts, df, hops).select("anchor", F.explode("allowed_edges").alias("edge_id")).distinct().join(df, "edge_id").groupBy("anchor", "chunk_id").agg(F.min("sequence_index").alias("s")).collect()
        want = {(a, r["chunk_id"], k + 1) for a in "abcz" for k, r in enumerate(sorted((r for r in whole if r["anchor"] == a), key=lambda r: (r["s"], r["chunk_id"]))[:2])}
        got = graph.graph_evidence(starts, df, hops, 2)
        assert {(r["anchor"], r["chunk_id"], r["pos"]) for r in got.collect()} == want
        joins = [line for line in got._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join " in line]
        assert len(joins) == hops and sum("LeftAnti" in line for line in joins) == 0  # anchors meet nodes once, at the end


def search(edges, seed, depth):
    """Breadth-first with a queue."""
    found, seen, queue = [], {seed}, deque([(seed, 0)])
    while queue:
        node, level = queue.popleft()
        for _, target in sorted((p, t) for p, s, t in edges if s == node) if level < depth else ():
            if target not in seen:
                seen.add(target)
                found.append((target, level + 1))
                queue.append((target, level + 1))
    return found


def test_neighbours_in_the_order_of_a_search(spark):
    rng = random.Random(9)
    edges = [(p, rng.choice("abcdefghijkl"), rng.choice("abcdefghijkl")) for p in rng.sample(range(200), 40)]
    df = spark.createDataFrame(edges, "place int, source string, target string")
    seeds = spark.createDataFrame([(x,) for x in "abcdz"], "seed string")
    for depth in (1, 2, 4):
        got = graph.neighbours_in_order(seeds, df, depth, "place").collect()
        for seed in "abcdz":
            own = sorted(((r["depth"], r["way"], r["node"]) for r in got if r["seed"] == seed))
            assert [(n, d) for d, _, n in own] == search(edges, seed, depth)


def test_short_terms_match_too(spark):
    terms = spark.createDataFrame([(1, "io"), (1, "x"), (1, "lock"), (1, "")], "anchor int, term string")
    symbols = spark.createDataFrame([("s1", "ioLock"), ("s2", "x"), ("s3", "do"), ("s4", "Lo")], "symbol_id string, fqn string")
    got = {r["symbol_id"]: r["n_terms"] for r in context.symbol_matches(terms, symbols, 9).collect()}
    assert got == {"s1": 2, "s2": 1}
