import random
import zlib

import numpy as np
import pytest

from attestra.llm import langid
from attestra.llm.langid import Model, best_paths, detect, languages, learn, spans, words_of

SYLLABLES = {"aa": "the on er re ing ly".split(), "bb": "der ung ä lich ein ver".split(), "cc": "que é ou la ment eau".split(), "dd": "при вет мир как да".split()}


def text_of(lang, n, rng):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="module")
def labelled():
    rng = random.Random(8)
    return [(k, text_of(lang, rng.randint(5, 40), rng), lang) for k, lang in enumerate(list(SYLLABLES) * 60)]


@pytest.fixture(scope="module")
def model(spark, labelled):
    return learn(spark.createDataFrame([x[1:] for x in labelled], "text string, lang string"))


def slow_path(scores, priors, switch):
    """Viterbi for one text, word by word."""
    best, back = priors + scores[0], []
    for row in scores[1:]:
        top = int(best.argmax())
        came = [top if best[top] - switch > best[k] else k for k in range(len(best))]
        best = np.array([best[c] - switch * (c != k) for k, c in enumerate(came)]) + row
        back.append(came)
    path = [int(best.argmax())]
    for came in reversed(back):
        path.append(came[path[-1]])
    return path[::-1]


def test_paths_equal_those_of_one_text_after_another():
    rng = np.random.default_rng(2)
    sizes = np.array([3, 0, 17, 1, 40, 17])
    scores = rng.normal(0, 4, (sizes.sum(), 3))
    priors = np.log([0.5, 0.3, 0.2])
    ends = np.cumsum(sizes)
    want = [k for n, end in zip(sizes, ends) if n for k in slow_path(scores[end - n : end], priors, 6.0)]
    assert best_paths(scores, sizes, priors, 6.0).tolist() == want


def test_words_split_at_scripts_and_keep_marks():
    words = words_of(langid.code_points("Ab1c миrд नमस्ते x"))
    assert words.starts.tolist() == [0, 3, 5, 7, 8, 10, 17]
    assert words.sizes.tolist() == [2, 1, 2, 1, 1, 6, 1]
    assert words.scripts.tolist() == [1, 1, 3, 1, 3, 7, 1]
    same = words_of(langid.code_points("AB ab ba")).buckets
    assert same[0] == same[1] != same[2]


def test_pieces_are_cut_where_no_word_is(monkeypatch):
    rng = random.Random(3)
    texts = [text_of("aa", 50, rng), "", "x" * 90, text_of("bb", 2, rng)]
    whole = [list(zip(w.starts.tolist(), w.sizes.tolist())) for w in (words_of(langid.code_points(t)) for t in texts)]
    monkeypatch.setattr(langid, "PIECE", 37)
    found = [[] for _ in texts]
    for codes, of, place in langid.pieces(texts):
        w = words_of(codes)
        for k in range(len(w.starts)):
            found[of[w.starts[k]]].append((int(place[w.starts[k]]), int(w.sizes[k])))
    assert found == whole


def test_held_out_texts_get_their_language(spark, labelled):
    out = {r["doc_id"]: r for r in languages(spark.createDataFrame(labelled, "doc_id long, text string, lang string").repartition(3)).collect()}
    held = [x for x in labelled if zlib.crc32(str(x[0]).encode()) % 4 == 2]
    assert len(out) == len(labelled) and {k for k, r in out.items() if r["held_out"]} == {x[0] for x in held}
    assert sum(out[k]["lang_pred"] == lang for k, _, lang in held) >= 0.97 * len(held)


def test_what_is_held_out_is_not_learned(spark, labelled):
    rows = [(k, t, "zz" if zlib.crc32(str(k).encode()) % 4 == 2 else lang) for k, t, lang in labelled]
    assert {r["lang_pred"] for r in languages(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()} == set(SYLLABLES)


def test_counts_do_not_depend_on_partitions(spark, labelled, model):
    other = learn(spark.createDataFrame([x[1:] for x in labelled], "text string, lang string").repartition(7))
    assert other.languages == model.languages and np.array_equal(other.scores, model.scores) and np.array_equal(other.allowed, model.allowed)


def test_spans_of_mixed_texts(spark, model):
    rng = random.Random(11)
    parts = [text_of("aa", 30, rng), text_of("bb", 20, rng), text_of("dd", 9, rng)]
    text = "\n".join(parts)
    got = spans(spark.createDataFrame([(1, text), (2, "12 3"), (3, None)], "doc_id long, text string"), model).orderBy("span").collect()
    assert [(r["doc_id"], r["lang"]) for r in got] == [(1, "aa"), (1, "bb"), (1, "dd")]
    assert [text[r["start"] : r["end"]] for r in got] == parts and [r["n_words"] for r in got] == [30, 20, 9]


def test_scripts_narrow_the_candidates(spark, model):
    rows = {r["doc_id"]: r for r in detect(spark.createDataFrame([(1, "пи та"), (2, "xyz qq"), (3, "日本"), (4, "мир the on er ing")], "doc_id long, text string"), model).collect()}
    assert rows[1]["lang_pred"] == "dd" and rows[2]["lang_pred"] != "dd"
    assert rows[3]["lang_pred"] in SYLLABLES and rows[3]["score"] == 0.0
    assert rows[4]["lang_pred"] == "aa" and 0.7 < rows[4]["score"] < 0.9 and rows[4]["n_spans"] == 2


def test_odd_rows(spark, labelled, empty):
    more = [(None, "the on", None), (9, None, "aa"), (9, "", "bb"), (9, "...", "aa"), (9, "the onthe er", None), (9, "the onthe er", None)]
    df = spark.createDataFrame([(*x, 1.5) for x in labelled + more], "doc_id long, text string, lang string, score double")
    out = languages(df)
    assert out.columns == ["doc_id", "held_out", "lang_pred", "score", "n_spans"]
    rows = out.collect()
    assert len(rows) == len(labelled) + 6 and all(0 <= r["score"] <= 1 for r in rows)
    assert [(r["held_out"], r["lang_pred"]) for r in rows if r["doc_id"] is None] == [(False, "aa")]
    assert sorted(r["lang_pred"] for r in rows if r["doc_id"] == 9)[-3:] == ["und"] * 3
    assert languages(empty).count() == 0
    nothing = languages(spark.createDataFrame([(1, "word", None)], "doc_id long, text string, lang string")).collect()
    assert [(r["lang_pred"], r["score"]) for r in nothing] == [("und", 0.0)]


def test_a_very_long_text(spark, model):
    rng = random.Random(12)
    text = text_of("cc", 150_000, rng)
    row = detect(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).first()
    assert (row["lang_pred"], row["n_spans"], row["score"]) == ("cc", 1, 1.0)
