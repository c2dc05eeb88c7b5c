"""Passages of which earlier texts hold parts: nothing of 50 equal words is lost; recall of changed ones."""

import random
from collections import defaultdict

import numpy as np
import pytest

from attestra.llm import minhash, sentencepiece, substring

SCHEMA = "doc_id long, text string"


def fresh(rng, n):
    return [f"w{rng.randrange(10**7)}" for _ in range(n)]


def exact_words(rows):
    """Words of each text in windows of 50 that occur earlier."""
    seen, want = {}, defaultdict(set)
    for k, text in sorted(rows):
        w = text.split()
        for i in range(len(w) - 49):
            if seen.setdefault(tuple(w[i : i + 50]), (k, i)) != (k, i):
                want[k].update(range(i, i + 50))
    return want


def found_words(spark, rows):
    got = defaultdict(set)
    for r in substring.repeated_passages(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect():
        got[r["doc_id"]].update(range(r["start_word"], r["end_word"]))
    return got


def test_pieces_in_earlier_texts_hide_no_copy(spark):
    rng = random.Random(1)
    p = fresh(rng, 120)
    pieces = lambda order: [w for k in order for w in p[k : k + 45] + fresh(rng, 5)]
    rows = [(0, pieces([75, 0, 38])), (1, fresh(rng, 20) + p + fresh(rng, 20)), (2, pieces([38, 75, 0])), (3, fresh(rng, 20) + p + fresh(rng, 20))]
    rows = [(k, " ".join(w)) for k, w in rows]
    got = [r for r in substring.repeated_passages(spark.createDataFrame(rows, SCHEMA)).collect() if r["doc_id"] == 3]
    assert [(r["start_word"], r["end_word"]) for r in got] == [(20, 140)] and 1 in got[0]["source_ids"]


@pytest.mark.parametrize("seed", range(3))
def test_nothing_of_fifty_equal_words_is_lost(spark, seed):
    """Two to six earlier texts hold parts of a passage, in any order, before a text that holds it, whole or in part."""
    rng, rows = random.Random(seed), []
    for _ in range(60):
        p = fresh(rng, rng.randint(50, 200))
        for _ in range(rng.randint(3, 7)):
            text = fresh(rng, rng.randint(0, 30))
            for _ in range(rng.randint(1, 3)):
                a = rng.randrange(len(p) - 19)
                text += p[a : a + rng.choice([20, 45, 49, 50, 51, 60, 200])] + fresh(rng, rng.choice([0, 1, 30]))
            rows.append(text)
    order = list(range(len(rows)))
    rng.shuffle(order)
    rows = [(k, " ".join(t)) for k, t in zip(order, rows)]
    want, got = exact_words(rows), found_words(spark, rows)
    assert sum(map(len, want.values())) > 1_000
    assert {k: sorted(v - got[k]) for k, v in want.items() if v - got[k]} == {}


def test_recall_of_changed_passages_with_many_earlier_ones(spark):
    """Passages of 100 words in six texts each, words replaced at random with a chance of one in 15: of those still 80 % equal to an earlier text and 50 words or more long, at least nine in ten words are found."""
    rng, rows, held = random.Random(7), [], {}
    for k in range(80):
        p = fresh(rng, 100)
        for i in range(6):
            q = [w if rng.random() > 1 / 15 else "edit" for w in p]
            rows.append((k * 6 + i, " ".join(fresh(rng, 20) + q + fresh(rng, 20))))
            if i:
                held[k * 6 + i] = set(range(20, 120))
    got = found_words(spark, rows)
    hit = sum(len(v & got[k]) for k, v in held.items())
    assert hit >= 0.9 * sum(map(len, held.values()))
    assert all(not got[k * 6] for k in range(80))


def test_chains_follow_the_best_chain_before(spark):
    """Stretches equal those of a table over all pairs of runs, with the same scores."""
    rng = random.Random(3)
    for _ in range(300):
        places = sorted({(rng.randrange(150), rng.randrange(150)) for _ in range(rng.randint(2, 14))})
        runs = [(x0, x1, y0, y0 + x1 - x0) for x0, x1, y0 in substring.diagonal_runs(*zip(*places), 6).tolist()]
        score, total, before = {}, {}, {}
        for i in sorted(range(len(runs)), key=lambda i: (runs[i][0], i)):
            x0, x1, y0, y1 = runs[i]
            score[i], total[i], before[i] = x1 - x0, x1 - x0, -1
            ended = [j for j in score if j != i and runs[j][1] < x0 + 6 and runs[j][3] <= y0 + 6]
            gains = sorted((min(score[j], 40) - 0.5 * (x0 - runs[j][1] + y0 - runs[j][3]) for j in ended), reverse=True)
            if gains and gains[0] > 0:
                if gains[1:2] == gains[:1]:
                    break  # two are as good: either may be followed
                before[i] = next(j for j in ended if min(score[j], 40) - 0.5 * (x0 - runs[j][1] + y0 - runs[j][3]) == gains[0])
                score[i], total[i] = score[i] + gains[0], total[i] + total[before[i]]
        else:
            used, want = set(), []
            for i in sorted(score, key=lambda i: (-total[i], i)):
                if i not in used:
                    chain = [i]
                    while before[chain[-1]] >= 0 and before[chain[-1]] not in used:
                        chain.append(before[chain[-1]])
                    used |= set(chain)
                    want.append((runs[chain[-1]][0], runs[i][1], runs[chain[-1]][2], runs[i][3]))
            assert substring.chains(*map(list, zip(*places)), 6) == sorted(want)


def test_a_fenwick_tree_holds_the_best_of_a_prefix():
    rng = random.Random(6)
    tree, values = substring.PrefixBest(50), []
    for k in range(200):
        values.append((rng.randrange(50), rng.random()))
        tree.put(*values[-1], k)
        places = rng.randrange(51)
        assert tree.best(places) == max(((v, j) for j, (a, v) in enumerate(values) if a < places), default=(float("-inf"), -1))


def test_weak_chains_hide_no_equal_run(spark):
    rng = random.Random(5)
    rows = []
    for k in range(0, 40, 2):
        a, b = fresh(rng, 50), fresh(rng, 12)
        rows += [(k, " ".join(fresh(rng, 9) + a + fresh(rng, 18) + b + fresh(rng, 9))), (k + 1, " ".join(fresh(rng, 9) + a + fresh(rng, 18) + b + fresh(rng, 9)))]
    want, got = exact_words(rows), found_words(spark, rows)
    assert len(want) == 20 and all(v <= got[k] for k, v in want.items())


def test_names_that_clash(spark):
    p = " ".join(fresh(random.Random(2), 60))
    rows = [(1, p, "a", "b", "c"), (2, p + " more", "d", "e", "f"), (2, p, "g", "h", "i")]
    df = spark.createDataFrame(rows, SCHEMA + ", `row key` string, `key of passages` string, cuts string")
    out = substring.cut_passages(df)
    assert out.columns == df.columns
    assert sorted((r["doc_id"], r["row key"], r["cuts"]) for r in out.collect()) == [(1, "a", "c"), (2, "d", "f"), (2, "g", "i")]
    assert sorted(r["text"].strip() for r in out.collect()) == sorted([p, "more", ""])


def test_repeated_rows_make_pairs_and_words_in_proportion(spark, words):
    rng = random.Random(4)
    base = [rng.choice(words) for _ in range(60)]
    near = base[:-1] + ["other"]
    rows = [(1, " ".join(base))] * 300 + [(2, " ".join(near))] * 300 + [(3, " ".join(base + ["x"]))]
    df = spark.createDataFrame(rows, SCHEMA)
    out = minhash.near_duplicates(df, size=2).collect()
    assert len(out) == 601 and {r["component_id"] for r in out} == {1}
    docs = df.select("doc_id", "text")
    some = minhash.sketches(docs, 2, minhash.BANDS, minhash.ROWS)
    reps = some.groupBy("set_id").agg({"doc_id": "min"}).withColumnRenamed("min(doc_id)", "rep")
    assert minhash._one_text(docs, some, reps, 2, minhash.BANDS, minhash.ROWS).count() == 3
    seen = []
    kept = sentencepiece.assemble

    def watch(docs, *rest):
        seen.append(docs.selectExpr("sum(size(rare))").first()[0])
        return kept(docs, *rest)

    sentencepiece.assemble = watch
    try:
        texts = spark.createDataFrame([(1, "zq xk vj qw pz jx")] * 1_000, SCHEMA)
        got = sentencepiece.encode_documents(texts, known_words=0).collect()
    finally:
        sentencepiece.assemble = kept
    assert len(got) == 1_000 and all(r["round_trip"] for r in got) and seen[0] <= 6_000


def test_texts_meet_their_words_compressed_and_as_ids_alone(spark, monkeypatch):
    kept, seen = sentencepiece.assemble, []

    def watch(docs, *rest):
        seen.append((docs.columns, docs.selectExpr("sum(length(data))", "sum(size(rare))", "sum(size(filter(rare, x -> x.word is not null)))").first()))
        return kept(docs, *rest)

    monkeypatch.setattr(sentencepiece, "assemble", watch)
    text = "zq xk 日本 🙂\t▁vj " * 200
    got = sentencepiece.encode_documents(spark.createDataFrame([(1, text), (2, text)], SCHEMA), known_words=0).collect()
    assert len(got) == 2 and all(r["round_trip"] for r in got)
    columns, (n_bytes, n_words, n_told) = seen[0]
    assert "text" not in columns and n_bytes < len(text) / 10 and n_words > 4 and n_told == 0


def test_counts_go_to_the_jvm_in_slices():
    counts = {f"w{k}": k for k in range(25_000)}
    sizes = [batch.num_rows for batch in sentencepiece._counts(counts)]
    assert sum(sizes) == 25_000 and max(sizes) <= 10_000


@pytest.mark.parametrize("way", ["changed", "parted"])
def test_frequent_seeds_hide_no_changed_passage(spark, way):
    """Each piece of a passage occurs in six earlier texts, that lie before and after the one that holds the passage; a text that has it with words changed, or one more, is found."""
    rng, rows, held = random.Random(11), [], {}
    for k in range(0, 200, 10):
        p = fresh(rng, 66)
        cuts = [p[i : i + 11] for i in range(0, 66, 11)]
        for i in (0, 1, 2, 4, 5, 6):
            rng.shuffle(cuts)
            rows.append((k + i, " ".join(w for c in cuts for w in c + fresh(rng, 40))))
        rows.append((k + 3, " ".join(fresh(rng, 20) + p + fresh(rng, 20))))
        q = [w if i % 11 else "edit" for i, w in enumerate(p)] if way == "changed" else p[:33] + ["more"] + p[33:]
        rows.append((k + 7, " ".join(fresh(rng, 30) + q + fresh(rng, 30))))
        held[k + 7] = set(range(31, 96))
    got = {r["doc_id"]: r for r in substring.repeated_passages(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()}
    assert set(got) == set(held)
    assert all(r["source_ids"] == [k - 4] and held[k] <= set(range(r["start_word"], r["end_word"])) for k, r in got.items())


def test_the_longest_common_subsequence_is_that_of_a_table():
    rng = random.Random(12)
    for _ in range(200):
        x, y = ([rng.randrange(6) for _ in range(rng.randrange(40))] for _ in range(2))
        row = [0] * (len(y) + 1)
        for w in x:
            last = row[:]
            for j, v in enumerate(y):
                row[j + 1] = last[j] + 1 if v == w else max(row[j], last[j + 1])
        assert substring.aligned(x, y) == row[-1]


def test_occurrences_meet_by_what_lies_beyond_a_difference():
    """Rows meet exactly if they have a witness in common with something else between, and the later one is open."""
    rng = np.random.default_rng(13)
    for _ in range(50):
        n = 40
        of, key, between = np.sort(rng.integers(0, n, 150)), rng.integers(0, 20, 150).astype(np.uint32), rng.integers(0, 3, 150).astype(np.uint32)
        group, asks = np.sort(rng.integers(0, 3, n)).astype(np.uint64), rng.random(n) < 0.7
        want = {(i, j) for i, k, b in zip(of, key, between) for j, m, c in zip(of, key, between) if i > j and k == m and b != c and group[i] == group[j] and asks[i]}
        got = {(i, j) for a, b in substring.met_witnesses(group, asks, of, key, between) for i, j in zip(a, b)}
        assert got == want
