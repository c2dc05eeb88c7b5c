"""The training-data operators against brute force, and their defined results in odd cases."""

import random
import re
import zlib
from collections import Counter, defaultdict
from math import log10

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from attestra.llm import components, decontaminate, gru, licenses, lm, minhash, quality, sentencepiece, sharding, substring, token_counts, token_files
from attestra.llm.encoding import encoder, load_tokenizer

BPE = "byte_bpe_50k.json"


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def true_ids(text):
    return load_tokenizer(BPE).encode(text or "", add_special_tokens=False).ids


ODD_TEXTS = ["a\tb c\n\nd  e \n f", " x y", "x <|endoftext|> y\n<|endoftext|>z", "\n", "", " ", "it's they'll 12 3", "a b　c", "é\x85 x", "x\x1c y", "日本 語\nテキスト", "🙂 🙂\n🙂"]


@pytest.mark.parametrize("kept", [12_000, 1 << 20])
def test_stretches_give_the_ids_of_whole_texts(words, kept):
    enc = encoder(BPE)
    enc.kept = kept  # few, so that what is known is set aside again and again
    rng = random.Random(1)
    texts = ODD_TEXTS + [" ".join(rng.choices(words, k=60)).replace(" a", "\na") for _ in range(60)] + [" ".join(f"n{rng.random()}" for _ in range(3000)), "x" * 5000 + " y", "z"]
    for at in (*range(0, len(texts), 7), *range(0, len(texts), 11)):
        part = texts[at : at + 7]
        counts, ids = enc.encode(pa.array(part, pa.string()))
        got = np.split(ids, np.cumsum(counts)[:-1])
        assert [x.tolist() for x in got] == [true_ids(t) for t in part]
    assert [len(x) for x in enc.encode(pa.array([], pa.string()))] == [0, 0]


def test_token_counts(docs, corpus):
    got = by_id(token_counts.token_counts(docs, huge_chars=2000, chunk=1000, overlap=200))
    assert {k: r["n_tokens"] for k, r in got.items()} == {k: len(true_ids(t)) for k, t, *_ in corpus}
    assert {k: r["n_bytes"] for k, r in got.items()} == {k: len((t or "").encode()) for k, t, *_ in corpus}
    assert max(r["n_chunks"] for r in got.values()) > 3
    assert all(r["over_limit"] == (r["n_tokens"] > 1024) for r in got.values())


@pytest.mark.parametrize("text", ["a" * 9000, "ab c\n" * 2000, ("x" * 700 + " ") * 12, "hi " + " " * 7000 + "y", "<|endoftext|>" * 700, "é🙂 " * 1500])
def test_overlaps_widen_until_they_align(spark, text):
    df = spark.createDataFrame([("k", text)], "key string, text string")
    assert token_counts.count_huge(df, chunk=512, overlap=128).first()["n_tokens"] == len(true_ids(text))


def test_token_counts_of_odd_tables(empty, odd):
    assert token_counts.token_counts(empty).count() == 0
    assert sorted((r["doc_id"] or 0, r["n_tokens"]) for r in token_counts.token_counts(odd).collect()) == [(0, 4), (1, 4), (1, 4), (2, 0)]


def test_licenses_against_brute_force(spark):
    rng = random.Random(2)
    bag = ["mit", "license", "apache", "general", "public", "gnu", "affero", "x", "cc", "by", "nc"]
    texts = [" ".join(rng.choices(bag, k=40)) for _ in range(60)] + ["MIT License. Apache-License", "général public license", None, ""]
    texts.append("Permission is hereby granted, free of charge, to any person obtaining a copy of THIS software and associated documentation")
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    phrases = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
    for k, r in by_id(licenses.license_scan(df)).items():
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in texts[k] or "")
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        places = [(i, label) for p, label in phrases.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        at = [i for i, _ in places]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(w), len(at), min(at, default=None), max(at, default=None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in places}))
        own = {label for label, phrase in (("agpl", ["gnu", "affero", "general", "public", "license"]), ("cc-by-nc", ["cc", "by", "nc"])) if any(w[i : i + len(phrase)] == phrase for i in range(len(w)))}
        assert own <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
    cut = by_id(licenses.license_scan(df))[len(texts) - 1]
    assert cut["labels"] == "mit" and cut["n_base"] == 0 and 0.08 <= cut["score"] < 1


def test_notices_with_words_more_or_fewer(spark, empty, odd):
    notices = {t.label: " ".join(w.decode() for w in t.words) for t in licenses.NOTICE_TEMPLATES}
    rng, rows = random.Random(51), []
    for label, text in notices.items():
        w, key = text.split(), next(t for t in licenses.NOTICE_TEMPLATES if t.label == label)
        safe = [i for i in range(len(w)) if i not in key.mandatory]
        more, fewer = w[:], w[:]
        more.insert(max(safe), "inserted")
        del fewer[rng.choice(safe)]
        broken = w[:]
        broken[min(key.mandatory) + 1] = "broken"
        rows += [(label, x) for x in (w, more, fewer)] + [("", broken)]
    df = spark.createDataFrame([(k, f"a b {' '.join(w)} c") for k, (_, w) in enumerate(rows)], "doc_id long, text string")
    got = by_id(licenses.license_scan(df))
    for k, (label, _) in enumerate(rows):
        labels = set(got[k]["labels"].split(",")) - {""}
        assert (label in labels and got[k]["score"] > 0.9) if label else not labels & {"isc", "zlib", "unlicense", "bsd"}, (k, label, labels)
    exact = [got[k]["score"] for k in range(0, len(rows), 4)]
    assert exact == [1.0] * len(notices)
    assert licenses.license_scan(empty).count() == 0
    assert sorted((r["doc_id"] or 0, r["n_words"], r["n_base"], r["labels"], r["score"]) for r in licenses.license_scan(odd).collect()) == [(0, 4, 0, "", 0.0), (1, 4, 0, "", 0.0), (1, 4, 0, "", 0.0), (2, 0, 0, "", 0.0)]


def test_only_the_rarest_words_of_a_file_are_looked_up():
    index = licenses.PositionalIndex(licenses.TEMPLATES, {b"the": 900, b"license": 500, b"public": 300, b"general": 100, b"mit": 5}, 1000)
    assert sum(map(len, index.postings.values())) == sum(len(t.words) for t in licenses.TEMPLATES)
    asked = []
    index.postings = type("Spy", (dict,), {"__getitem__": lambda self, w: asked.append(w) or dict.__getitem__(self, w)})(index.postings)
    words = b"the general public license of the mit license".split()
    found = [(licenses.TEMPLATES[k].label, at) for k, at, _ in index.matches(words)]
    assert sorted(found) == [("gpl", 1), ("mit", 6)] and b"the" not in asked


def jaccard_components(texts, size):
    sets = {}
    for k, t in texts:
        w = (t or "").encode().lower().split()
        sets[k] = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
    name = {k: k for k in sets}
    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                old, new = max(name[a], name[b]), min(name[a], name[b])
                name = {k: new if v == old else v for k, v in name.items()}
    return {k: len(s) for k, s in sets.items()}, name


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates_against_brute_force(docs, corpus, size):
    sizes, name = jaccard_components([(k, t) for k, t, *_ in corpus], size)
    got = by_id(minhash.near_duplicates(docs, size))
    assert {k: r["n_shingles"] for k, r in got.items()} == sizes
    assert {k: r["component_id"] for k, r in got.items()} == name
    assert all(r["kept"] == (k == r["component_id"]) for k, r in got.items())


def test_a_family_whose_members_are_not_all_alike(spark, words):
    """A chain of edits: neighbours are similar, the ends are not, so one bucket holds more than its least member links."""
    rng = random.Random(3)
    text, rows = [rng.choice(words) for _ in range(200)], []
    for k in range(30):
        rows.append((k, " ".join(text)))
        text = text[:]
        for _ in range(6):
            text[rng.randrange(200)] = f"new{rng.random()}"
    _, name = jaccard_components(rows, 2)
    got = by_id(minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2))
    assert {k: r["component_id"] for k, r in got.items()} == name


def families(words, n_families, members, share, seed):
    """Families of texts that keep ``share`` of a common text; what differs is each text's own."""
    rng, rows = random.Random(seed), []
    for _ in range(n_families):
        common = [rng.choice(words) for _ in range(120)]
        for _ in range(members):
            keep = rng.uniform(*share)
            rows.append((len(rows), " ".join(w if rng.random() < keep else f"own{rng.random()}" for w in common)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("size, share", [(2, (0.75, 0.9)), (2, (0.86, 0.97)), (5, (0.9, 0.99))])
def test_families_about_the_threshold(spark, words, size, share):
    rows = families(words, 4, 60, share, size)
    _, name = jaccard_components(rows, size)
    got = by_id(minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), size))
    assert {k: r["component_id"] for k, r in got.items()} == name


def test_the_prefix_filter_loses_no_pair_and_makes_few_others(spark, words):
    rows = families(words, 3, 80, (0.8, 0.97), 9)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    held = spark.createDataFrame([(1, k, 0, k, -1) for k, _ in rows], "bucket long, rep long, n long, component long, top long")
    pairs = {(r["a"], r["b"]) for r in minhash._by_prefix(held, df, 2, 80).collect()}
    sets = {k: set(zip(t.split(), t.split()[1:])) for k, t in rows}
    similar = {(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    assert similar and similar <= pairs and len(pairs) < 0.1 * 3 * 80 * 79 / 2


def test_shared_bands_find_similar_pairs():
    """Recall of circulant signatures, at the threshold, over pairs of sets."""
    rng, missed, n = np.random.default_rng(71), 0, 3000
    for _ in range(n):
        size = int(rng.integers(20, 400))
        differ = size // 9  # similarity (size - differ) / (size + differ) is 0.8
        base = rng.integers(0, 2**63, size + differ, dtype=np.uint64)
        a, b = np.unique(base[:size]), np.unique(np.concatenate([base[differ:size], base[size:]]))
        bands = [set(minhash.band_hashes(minhash.signature(x, minhash.BANDS * minhash.ROWS)).tolist()) for x in (a, b)]
        missed += not bands[0] & bands[1]
    assert missed <= n // 1000


def test_near_duplicates_of_odd_tables(empty, odd):
    assert minhash.near_duplicates(empty, 2).count() == 0
    got = sorted(((r["doc_id"] or 0), r["component_id"], r["kept"]) for r in minhash.near_duplicates(odd, 2).collect())
    assert got == [(0, None, True), (1, 1, True), (1, 1, True), (2, 2, True)]


def test_components_of_long_paths_and_stars(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 160)] + [(7, 7)]
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(41)}, **{k: 100 for k in range(100, 160)}}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_token_files(spark, docs, corpus, empty, tmp_path):
    path = str(tmp_path / "files")
    token_files.write_token_files(docs, path, n_files=4, row_group_bytes=1 << 20, page_bytes=1 << 12)
    got, start = by_id(token_files.token_file_digest(spark, path)), 0
    for k, t, *_ in sorted(corpus):
        ids = np.array([*true_ids(t), 0], dtype="<u4")
        assert (got[k]["start"], got[k]["n_tokens"], got[k]["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    import pyarrow.parquet as pq

    meta = [pq.ParquetFile(p).metadata.row_group(0) for p in sorted((tmp_path / "files").glob("*.parquet")) if pq.ParquetFile(p).metadata.num_rows]
    column = {meta[0].column(i).path_in_schema: meta[0].column(i) for i in range(meta[0].num_columns)}
    assert "RLE_DICTIONARY" in column["ids.list.element"].encodings and "DELTA_BINARY_PACKED" in column["doc_id"].encodings
    assert column["doc_id"].has_offset_index and column["doc_id"].has_column_index
    none = str(tmp_path / "none")
    token_files.write_token_files(empty, none, n_files=2)
    assert token_files.token_file_digest(spark, none).count() == 0


def test_token_files_of_odd_rows(spark, odd, tmp_path):
    token_files.write_token_files(odd, str(tmp_path / "f"), n_files=3)
    got = sorted(((r["doc_id"] or 0), r["start"], r["n_tokens"]) for r in token_files.token_file_digest(spark, str(tmp_path / "f")).collect())
    assert got == [(0, 0, 5), (1, 5, 5), (1, 10, 5), (2, 15, 1)]


def test_very_long_texts(spark, words):
    """One text of two million characters, one without a space, and one line again and again."""
    rng = random.Random(81)
    texts = [" ".join(rng.choice(words) for _ in range(400_000)), "x" * 200_000, "the same line\n" * 40_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    ids = {k: true_ids(t) for k, t in enumerate(texts)}
    assert {k: r["n_tokens"] for k, r in by_id(token_counts.token_counts(df)).items()} == {k: len(x) for k, x in ids.items()}
    assert {k: r["n_words"] for k, r in by_id(licenses.license_scan(df)).items()} == {k: len(t.split()) for k, t in enumerate(texts)}
    assert {k: r["n_words"] for k, r in by_id(quality.quality_rules(df)).items()} == {k: len(t.split()) for k, t in enumerate(texts)}
    near = by_id(minhash.near_duplicates(df, 2))
    assert all(near[k]["component_id"] == k for k in near) and near[2]["n_shingles"] == 3
    import public_tokenizers
    import sentencepiece as library

    sp = library.SentencePieceProcessor(model_file=public_tokenizers.path(sentencepiece.MODEL))
    assert all(list(r["ids"]) == sp.encode(texts[k]) and r["round_trip"] for k, r in by_id(sentencepiece.encode_documents(df, known_words=100)).items())
    bench = spark.createDataFrame([(1, " ".join(texts[0].split()[9000:9040]))], "item_id long, text string")
    assert [(r["doc_id"], r["start_word"], r["similarity"]) for r in decontaminate.contaminated(df, bench).collect()] == [(0, 9000, 1.0)]


def test_recurrent_scores(docs, corpus, empty, odd):
    got = by_id(lm.lm_scores(docs, gru.Shape(8, 8, 8), known_words=50))
    tokens = {k: (t or "").encode().lower().split() + [b"\n"] for k, t, *_ in corpus}
    held = {k: zlib.crc32(str(k).encode()) % 5 == 1 for k in tokens}
    c = Counter(w for k in tokens if not held[k] for w in tokens[k])
    n, v = sum(c.values()), len(c)
    for k, w in tokens.items():
        r = got[k]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[k], len(w), sum(c[x] > 0 for x in w), n)
        assert r["base_score"] == pytest.approx(sum(log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w))
        assert r["score"] < 0
    assert lm.lm_scores(empty, gru.Shape(8, 8, 8)).count() == 0
    rows = sorted(((r["doc_id"] or 0), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) for r in lm.lm_scores(odd, gru.Shape(8, 8, 8)).collect())
    out = {k: zlib.crc32(x) % 5 == 1 for k, x in ((0, b""), (1, b"1"), (2, b"2"))}
    n = sum(0 if out[k] else t for k, t in ((0, 5), (1, 5), (1, 5), (2, 1)))
    known = {w for k, text in ((0, "same text here again"), (1, "same text here again"), (2, "")) if not out[k] for w in [*text.split(), "end"]}
    assert rows == [(k, out[k], t, sum(w in known for w in [*"same text here again".split(), "end"][-t:]), n) for k, t in ((0, 5), (1, 5), (1, 5), (2, 1))]


def test_held_out_texts_are_told_better_than_by_counts(spark):
    """Texts in which a word says which few may follow: the network learns them from other texts."""
    rng = random.Random(61)
    words = [f"w{k}" for k in range(300)]
    after = {w: rng.sample(words, 4) for w in words}
    rows = []
    for k in range(2500):
        w = [rng.choice(words)]
        while len(w) < 60:
            w.append(rng.choice(after[w[-1]]) if rng.random() < 0.9 else rng.choice(words))
        rows.append((k, " ".join(w)))
    got = [r for r in lm.lm_scores(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r["held_out"]]
    gain = [(r["score"] - r["base_score"]) / r["n_tokens"] for r in got]
    assert len(got) > 400 and sum(gain) / len(gain) > 0.1 and sum(g < 0 for g in gain) < 0.02 * len(gain)


def test_the_inputs_partitions_do_not_change_what_is_learned(docs):
    one, many = (by_id(lm.lm_scores(docs.repartition(n), gru.Shape(8, 8, 8), known_words=50)) for n in (1, 13))
    assert all(one[k]["score"] == pytest.approx(many[k]["score"], rel=1e-6) for k in one)


def test_the_driver_gets_the_mean_of_networks_in_blocks(spark, monkeypatch):
    rng, got = np.random.default_rng(4), []
    copies = [(rng.normal(size=10_000).astype(np.float32), n) for n in (3, 5, 11)]
    models = spark.createDataFrame([(bytearray(flat.tobytes()), n) for flat, n in copies], "flat binary, tokens long").repartition(3)
    collect = type(models).collect
    monkeypatch.setattr(type(models), "collect", lambda self: got.append(collect(self)) or got[-1])
    mean = lm.average(models, np.zeros(10_000, dtype=np.float32), 2)
    assert mean == pytest.approx(sum(n * flat for flat, n in copies) / 19, abs=1e-5) and sum(map(len, got)) <= 10
    assert (lm.average(models.limit(0), copies[0][0], 2) == copies[0][0]).all()


def test_the_network_learns_and_its_gradients_are_right():
    shape = gru.Shape(4, 3, 3)
    rng = np.random.default_rng(0)
    texts = [np.array([*([2, 5, 7, 3] * 8), 1], dtype=np.int32) for _ in range(40)]
    flat = gru.initial(shape, np.ones(9))
    before, squares = gru.score(flat, shape, texts).sum(), np.full_like(flat, 1e-4)
    for _ in range(30):
        gru.train(flat, squares, shape, texts)
    assert gru.score(flat, shape, texts).sum() > 0.5 * before
    # state runs over windows, and a text's score does not depend on its neighbours
    long = [rng.integers(0, 9, 200).astype(np.int32), rng.integers(0, 9, 3).astype(np.int32)]
    assert gru.score(flat, shape, long)[0] == pytest.approx(gru.score(flat, shape, long[:1])[0], rel=1e-4)
    # probabilities of all words after a state sum to 1
    p, h = gru.unpack(flat, shape), rng.normal(size=(1, 4)).astype(np.float32)
    assert sum(np.exp(gru.predict(p, shape, h, np.array([k]))[0][0]) for k in range(9)) == pytest.approx(1, rel=1e-4)


def brute_quality(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = defaultdict(list)
    for i in range(len(w) - 4):
        windows[tuple(w[i : i + 5])].append(i)
    covered = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(5)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def test_quality_against_brute_force(spark, corpus):
    rng = random.Random(4)
    texts = [t for _, t, *_ in corpus] + [" ".join(rng.choices("abc", k=60)) for _ in range(20)] + ["a b\n" * 9, "#x % $ & |" * 9, "é ü　x\x1cy " * 9, "LOUD WORDS " * 30, "a! b! c! " * 7, "one one one two " * 9, f"{'x' * 40} " * 12, "w x\n" * 3 + "y z\n" * 2]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = by_id(quality.quality_rules(df))
    for k, t in enumerate(texts):
        r = got[k]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == brute_quality(t), repr(t)
        assert r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"])
        assert r["kept"] == (not r["base_failed"] and not brute_own_rules(t)), repr(t)
    assert got[4]["kept"] and {brute for t in texts for brute in brute_own_rules(t)} == {"symbols", "exclamation", "capitals", "repeated_words", "repeated_lines", "word_length"}


def brute_own_rules(text):
    """Names of the own rules that reject a text, counted character by character."""
    text = text or ""
    w, (n_words, word_chars, n_symbols, n_dup, _) = re.findall(r"[^\x20\x09-\x0D]+", text), brute_quality(text)
    upper, letters = [c for c in text if c.isupper()], [c for c in text if c.isalpha()]
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    found = {
        "symbols": n_symbols > 0.08 * word_chars, "exclamation": text.count("!") > n_words / 2, "capitals": len(upper) > 20 and len(upper) > 0.6 * len(letters),
        "repeated_words": n_words >= 20 and sum(a == b for a, b in zip(w, w[1:])) > 0.35 * n_words, "repeated_lines": len(lines) >= 4 and n_dup > len(lines) / 2, "word_length": word_chars > 25 * n_words,
    }
    return {k for k, v in found.items() if v}


def test_cascade_order_changes_no_verdict(docs, empty, odd):
    kept = {r["doc_id"] for r in quality.cascade(docs, quality.RULES).collect()}
    assert kept == {r["doc_id"] for r in quality.cascade(docs, quality.RULES[::-1]).collect()} == {r["doc_id"] for r in quality.keep_quality(docs).collect()}
    rules = [quality.Rule(x, None) for x in "abc"]
    # b rejects most per cost; of what it leaves, c rejects one text and a none
    e = [quality.Estimate("a", 1.0, (True, True, False, False)), quality.Estimate("b", 1.0, (True, True, True, False)), quality.Estimate("c", 5.0, (False, False, False, True))]
    assert [r.name for r in quality.ordered(rules, e)] == ["b", "c", "a"]
    assert {r.name for r in quality.plan_cascade(docs)} == {r.name for r in quality.RULES} == {r.name for r in quality.plan_cascade(empty)}
    assert quality.quality_rules(empty).count() == 0 and quality.keep_quality(empty).columns == empty.columns
    got = sorted((r["doc_id"] or 0, r["n_words"], r["base_failed"], r["kept"]) for r in quality.quality_rules(odd).collect())
    assert got == [(0, 4, True, False), (1, 4, True, False), (1, 4, True, False), (2, 0, True, False)] and quality.keep_quality(odd).count() == 0


def test_passages_against_brute_force(docs, corpus, empty, odd):
    words, seen, want = {k: (t or "").encode().lower().split() for k, t, *_ in corpus}, {}, defaultdict(set)
    for k in sorted(words):
        w = words[k]
        for i in range(len(w) - 49):
            first = seen.setdefault(tuple(w[i : i + 50]), (k, i))
            if first != (k, i):
                want[k].update(range(i, i + 50))
    got = defaultdict(set)
    for r in substring.repeated_passages(docs).collect():
        got[r["doc_id"]].update(range(r["start_word"], r["end_word"]))
        assert all(s <= r["doc_id"] for s in r["source_ids"])
    assert all(want[k] <= got[k] for k in want)
    clean = [k for k in words if k not in want and k not in (34,)]
    assert not any(got[k] for k in clean)
    assert substring.repeated_passages(empty).count() == 0 and substring.repeated_passages(odd).count() == 0


def test_fuzzy_passage_is_found(spark, words):
    rng = random.Random(8)
    p = [rng.choice(words) for _ in range(120)]
    q = p[:40] + ["new"] + p[40:80] + p[81:]
    text = lambda n: [rng.choice(words) for _ in range(n)]
    df = spark.createDataFrame([(1, " ".join(text(30) + p + text(30))), (2, " ".join(text(20) + q + text(10)))], "doc_id long, text string")
    (r,) = substring.repeated_passages(df).collect()
    assert r["doc_id"] == 2 and r["source_ids"] == [1] and r["start_word"] <= 22 and r["end_word"] >= 138


def test_passages_with_an_edit_every_few_words_are_found(spark):
    rng = random.Random(21)
    text = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    rows, shared = [], {}
    for k in range(120):
        p, step = text(60), 10 + k % 6
        q = [w if (i + k) % step else "edit" for i, w in enumerate(p)]
        rows += [(k, " ".join(text(40) + p + text(40))), (1000 + k, " ".join(text(40) + q + text(40)))]
        shared[1000 + k] = {i for i, w in enumerate(q, 40) if w != "edit"}
    found = defaultdict(set)
    for r in substring.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        assert r["source_ids"] == [r["doc_id"] - 1000]
        found[r["doc_id"]].update(range(r["start_word"], r["end_word"]))
    assert {k: len(s - found[k]) for k, s in shared.items() if len(s - found[k]) > 5} == {}


@pytest.mark.parametrize("partitions", [1, 40])
def test_a_run_of_a_passage_in_an_earlier_text_hides_no_source(spark, partitions):
    rng = random.Random(22)
    text = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    rows = []
    for k in range(0, 300, 3):
        ends = 1 + k % 8
        p = text(49 + 2 * ends)
        rows += [(k, " ".join(text(30) + p[ends:-ends] + text(30))), *((k + i, " ".join(text(30) + p + text(30))) for i in (1, 2))]
    a, b = text(30), text(25)
    rows += [(900, " ".join(text(20) + a + text(20))), (901, " ".join(text(20) + b + text(20))), (902, " ".join(text(20) + a + b + text(20)))]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = by_id(substring.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sorted(got) == list(range(2, 300, 3)) and all(r["source_ids"] == [k - 1] for k, r in got.items())


def test_cut_passages_keeps_rows_columns_and_first_occurrences(docs, corpus, odd, empty):
    got = by_id(substring.cut_passages(docs))
    assert len(got) == len(corpus) and got[0]["text"] == corpus[0][1] and got[31]["text"] == ""
    assert substring.cut_passages(docs).columns == docs.columns and substring.cut_passages(empty).count() == 0
    assert sorted(map(str, substring.cut_passages(odd).collect())) == sorted(map(str, odd.collect()))
    passage = set(corpus[35][1].encode().lower().split()[31:99])
    assert got[35]["text"] == corpus[35][1] and len(passage & set((got[36]["text"] or "").encode().lower().split())) < 30


def test_rows_that_share_an_id_or_have_none_are_searched(spark):
    rng = random.Random(23)
    text = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    a, b, end = text(70), text(70), text(20)
    rows = [(5, a), (5, a), (9, f"{text(30)} {a} {end}"), (None, f"{b} {text(10)}"), (7, b)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r["doc_id"], r["end_word"] - r["start_word"], r["source_ids"]) for r in substring.repeated_passages(df).collect()]
    assert sorted(got, key=str) == [(5, 70, [5]), (9, 70, [5]), (None, 70, [7])]
    left = sorted((r["doc_id"] or 0, len(r["text"].split())) for r in substring.cut_passages(df).collect())
    assert left == [(0, 10), (5, 0), (5, 70), (7, 70), (9, 50)]


@pytest.mark.parametrize("partitions", [1, 5, 60])
def test_seed_matches_against_brute_force(spark, partitions):
    rng = random.Random(91)
    rows = sorted({(rng.randrange(40), rng.randrange(60)) for _ in range(900)})
    seeds = {k: rng.choice([7, 7, 7, -3, rng.randrange(-99, 99)]) for k in rows}
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = spark.createDataFrame([(*k, s) for k, s in seeds.items()], "doc_id long, at int, seed long")
        got = sorted(tuple(r) for r in substring.seed_matches(found).filter(f"kind = {substring.MATCH}").select("doc_id", "source_id", "x", "y").collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])
    want = set()
    for seed in set(seeds.values()):
        places = [k for k in rows if seeds[k] == seed]
        for i, (d, x) in enumerate(places[1:], 1):
            want |= {(d, places[0][0], x, places[0][1]), (d, places[i - 1][0], x, places[i - 1][1])}
    assert got == sorted(want)


def test_chains_against_all_chains():
    rng = random.Random(9)
    for _ in range(60):
        x = sorted(rng.sample(range(60), 6))
        y = [rng.randrange(60) for _ in x]
        for a, b, c, d in substring.chains(x, y):
            assert a in x and b - substring.K in x and c in y and d - substring.K in y and a < b and c < d
    assert substring.chains([0, 8, 20], [5, 13, 25]) == [(0, 28, 5, 33)]
    assert substring.chains([0, 8], [20, 5]) == [(0, 8, 20, 28), (8, 16, 5, 13)]
    assert substring.aligned([b"a", b"b", b"c"], [b"a", b"x", b"c"]) == 2


def test_a_long_chain_hides_no_chain_after_it():
    first = [(x, x) for x in range(0, 192, 8)]
    second = [(x, x + 300) for x in (250, 258, 266, 275, 283)]
    x, y = zip(*first, *second)
    assert substring.chains(list(x), list(y), k=8) == [(0, 192, 0, 192), (250, 291, 550, 591)]
    second = [(x, x) for x in (250, 258, 266, 275, 283)]
    x, y = zip(*first, *second)
    assert substring.chains(list(x), list(y), k=8) == [(0, 192, 0, 192), (250, 291, 250, 291)]


def test_sentencepiece_matches_the_library(spark, docs, corpus, empty, odd):
    import public_tokenizers
    import sentencepiece as library

    sp = library.SentencePieceProcessor(model_file=public_tokenizers.path(sentencepiece.MODEL))
    odd_texts = ["  a  b\n\n c ", "\n", "日本語テキスト 🙂🙂 ñ", "▁x ▁▁y", "    " * 9 + "z", "a\tb\r\nc", "<s> </s> <unk> <0x0A>", " "]
    rows = spark.createDataFrame(list(enumerate(odd_texts)), "doc_id long, text string")
    for known in (100_000, 3, 0):
        for k, r in by_id(sentencepiece.encode_documents(rows, known_words=known)).items():
            assert list(r["ids"]) == sp.encode(odd_texts[k]) and r["round_trip"], (known, odd_texts[k])
    got = by_id(sentencepiece.encode_documents(docs, known_words=200))
    for k, t, *_ in corpus:
        assert list(got[k]["ids"]) == sp.encode(t or "") and got[k]["n_pieces"] == len(got[k]["ids"]) and got[k]["round_trip"]
    assert sentencepiece.encode_documents(empty).count() == 0
    own = sp.encode("same text here again")
    rows = sorted(((r["doc_id"] or 0), list(r["ids"]), r["n_pieces"], r["round_trip"]) for r in sentencepiece.encode_documents(odd, known_words=2).collect())
    assert rows == [(0, own, len(own), True), (1, own, len(own), True), (1, own, len(own), True), (2, [], 0, True)]


def test_viterbi_fold_finds_the_best_path(spark):
    rng = random.Random(10)
    rows = [(p, k, -rng.random() * 5) for k, p in enumerate(["▁", "a", "b", "▁a", "ab", "ba", "aba", "bb", "▁ab", "bab"])]
    pieces = sentencepiece.Pieces(sentencepiece.UNIGRAM, tuple(rows), None, 99, "", 3)
    words = ["▁" + "".join(rng.choices("abc", k=rng.randint(1, 8))) for _ in range(40)]
    table = {p: (s, k) for p, k, s in rows}

    def best(w):
        if not w:
            return 0.0, []
        options = []
        for n in range(1, 4):
            if w[:n] in table and len(w) >= n:
                s, ids = best(w[n:])
                options.append((table[w[:n]][0] + s, [table[w[:n]][1], *ids]))
        if w[0] not in table:
            s, ids = best(w[1:])
            options.append((min(s for s, _ in table.values()) - 10 + s, [99, *ids]))
        return max(options)

    df = spark.createDataFrame([(w,) for w in set(words)], "word string")
    long = sentencepiece.LongWords(pieces)
    for r in sentencepiece.encode_words(df, pieces).collect():
        assert r["ids"] == best(r["word"])[1] == long.ids(r["word"])


def test_folds_and_long_words_give_the_library_ids(spark, monkeypatch):
    import public_tokenizers
    import sentencepiece as library

    sp = library.SentencePieceProcessor(model_file=public_tokenizers.path(sentencepiece.MODEL))
    pieces, rng = sentencepiece.load_pieces(sentencepiece.MODEL), random.Random(31)
    texts = ["".join(rng.choices("abcdeéñ日ßtionmntheou", k=rng.randint(1, 59))) for _ in range(300)] + ["a" * 59, "a" * 60, "ab" * 400, "日本語" * 60, "x"]
    df = spark.createDataFrame([(sentencepiece.SPACE + t,) for t in set(texts)], "word string")
    for chars in (sentencepiece.FOLD_CHARS, 3):
        monkeypatch.setattr(sentencepiece, "FOLD_CHARS", chars)
        for r in sentencepiece.encode_words(df, pieces).collect():
            assert r["ids"] == sp.encode(r["word"][1:]), r["word"]


def test_words_end_where_no_piece_goes_on(spark):
    import public_tokenizers
    import sentencepiece as library

    sp = library.SentencePieceProcessor(model_file=public_tokenizers.path(sentencepiece.MODEL))
    pieces = sentencepiece.load_pieces(sentencepiece.MODEL)
    texts = ["these, these. these! these$$$ these%%% (these)", "these1 these22 日本語日本語 theseñ", "x" * 70 + "," + "y" * 70 + "\r\n\t  these"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["word"] for r in sentencepiece.distinct_words(df, pieces).collect()}
    assert {w for w in found if "these" in w} <= {"▁these", "▁(these", "these", "▁theseñ", "▁▁these"} and "日" in found and max(map(len, found)) <= 71
    together = [set(p.lstrip("▁")) for p, _, _ in pieces.rows]
    groups = sentencepiece.joined_characters(pieces)
    assert all(len(t) < 2 or any(t <= set(g) for g in groups) for t in together)
    for known in (0, 1_000):
        assert [list(r["ids"]) for r in sentencepiece.encode_documents(df, known_words=known).orderBy("doc_id").collect()] == [sp.encode(t) for t in texts]


def test_frequent_words_are_cut_within_a_count(spark):
    df = spark.createDataFrame([(f"w{k}", 7 if k else 9) for k in range(5000)], "word string, c long")
    got = lm.frequent(df, 1000).collect()
    assert 990 <= len(got) <= 1000 and any(r["c"] == 9 for r in got)
    assert lm.frequent(df, 5000).count() == 5000 and lm.frequent(df, 0).count() == 0


def test_decontamination_against_brute_force(spark, words, empty):
    rng = random.Random(11)
    text = lambda n: [rng.choice(words) for _ in range(n)]
    items = [(k, text(n)) for k, n in enumerate([14, 20, 45, 45, 3, 5])]
    docs = [(k, text(60)) for k in range(12)]
    for k in range(6):
        docs[k] = (k, text(7) + items[k][1] + text(4))
    docs[6] = (6, items[2][1][:20] + ["zzz"] + items[2][1][21:])
    docs[7] = (7, text(5) + items[2][1][:43] + text(5))
    rows = [(k, " ".join(w).upper() if k % 2 else ", ".join(w)) for k, w in docs] + [(90, None), (91, ""), (92, "one")]
    shingles = lambda w, s: Counter(tuple(w[i : i + s]) for i in range(len(w) - s + 1))
    want = {}
    for d, w in docs:
        for i, item in items:
            s = min(5, len(item))
            b = shingles(item, s)
            for at in range(max(1, len(w) - len(item) + 1)):
                a = shingles(w[at : at + len(item)], s)
                if a and (x := sum((a & b).values()) / sum((a | b).values())) >= 0.8:
                    want[d, i] = max(x, want.get((d, i), 0))
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in items] + [(50, None), (51, "")], "item_id long, text string")
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontaminate.contaminated(df, bench).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    assert (7, 2) in got and (6, 2) not in got or want.get((6, 2), 0) >= 0.8
    left = {r["doc_id"] for r in decontaminate.drop_contaminated(df, bench).collect()}
    assert left == {k for k, _ in rows} - {d for d, _ in want}
    assert decontaminate.contaminated(empty, bench).count() == 0 and decontaminate.contaminated(df, bench.limit(0)).count() == 0


def test_the_best_window_may_lie_between_two_diagonals(spark):
    rng = random.Random(41)
    text = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    shingles = lambda w: Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    items, docs, want = [], [], set()
    for k in range(150):
        item = text(rng.randint(60, 110))
        items.append((k, " ".join(item)))
        w = item[:]
        for _ in range(rng.randint(1, 3)):  # insertions and deletions move the diagonal
            at, n = rng.randrange(5, len(w) - 5), rng.randint(1, 4)
            w[at:at] = text(n) if rng.random() < 0.5 else []
            del w[at + n : at + n + rng.randint(0, 3)]
        doc, b = text(20) + w + text(20), shingles(item)
        docs.append((k, " ".join(doc)))
        for at in range(max(1, len(doc) - len(item) + 1)):
            a = shingles(doc[at : at + len(item)])
            if sum((a & b).values()) >= 0.8 * sum((a | b).values()):
                want.add((k, k))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()}
    assert len(want) > 50 and got == want


def test_decontamination_judges_rows_one_by_one(spark, odd, empty, words):
    item = " ".join(words[:30])
    rows = [(None, f"x {item} y", 1), (None, "clean text of no item", 2), (7, "clean too", 3), (7, item, 4), (8, item, 5), (8, item, 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, hashes int")
    bench = spark.createDataFrame([(1, item, "a"), (1, item, "b"), (None, item, "c")], "item_id long, text string, fingerprint string")
    got = sorted(str((r["doc_id"], r["item_id"], r["start_word"], r["n_words"])) for r in decontaminate.contaminated(df, bench).collect())
    assert got == sorted(str((d, i, at, 30)) for d, at in ((None, 1), (7, 0), (8, 0)) for i in (1, None))
    assert sorted(r["hashes"] for r in decontaminate.drop_contaminated(df, bench).collect()) == [2, 3]
    assert decontaminate.drop_contaminated(odd, bench).count() == 4 and decontaminate.drop_contaminated(empty, bench).columns == empty.columns


def test_simhash_and_blocks(spark):
    rng = random.Random(12)
    rows = [(k, [rng.getrandbits(64) - 2**63 for _ in range(rng.randint(1, 40))]) for k in range(50)]
    df = spark.createDataFrame(rows, "k int, h array<long>").select("k", "h", decontaminate.simhash(F.col("h")).alias("f"))
    for r in df.collect():
        bits = sum(1 << b for b in range(64) if 2 * sum((h >> b) & 1 for h in r["h"]) > len(r["h"]))
        assert r["f"] % 2**64 == bits
    assert decontaminate.RADIUS == 23


def test_sharding_law_places_and_versions(spark, docs, corpus, empty, odd, tmp_path):
    got = sharding.shard_documents(docs, 5, map_path=str(tmp_path / "map")).collect()
    held = defaultdict(list)
    for r in got:
        held[r["shard"]].append(r)
        text = dict((k, t) for k, t, *_ in corpus)[r["doc_id"]] or ""
        assert (r["size"], r["text_crc32"]) == (len(text.encode()) + 8, zlib.crc32(text.encode())) and r["grown_shard"] is None
    assert len(got) == len(corpus) and all(sorted(x["slot"] for x in rows) == list(range(len(rows))) for rows in held.values())
    slot_map = sharding.read_map(spark, str(tmp_path / "map"))
    sizes = {r["virtual_slot"]: r["n_bytes"] for r in sharding.slot_sizes(sharding.records(docs)).collect()}
    grown = sharding.rebalance(slot_map, sizes, 6)
    moved = [s for s in range(sharding.N_SLOTS) if slot_map.shards[s] != grown.shards[s]]
    assert grown.version == 2 and {grown.shards[s] for s in moved if sizes.get(s)} <= {5}
    sharding.write_map(spark, grown, str(tmp_path / "map"))
    assert sharding.read_map(spark, str(tmp_path / "map")) == grown and sharding.read_map(spark, str(tmp_path / "map"), 1) == slot_map
    shrunk = sharding.rebalance(grown, sizes, 4)
    assert set(shrunk.shards) <= set(range(4))
    assert sharding.shard_documents(empty, 3).count() == 0
    rows = sharding.shard_documents(odd, 3).collect()
    text = b"same text here again"
    assert sorted(((r["doc_id"] or 0), r["size"], r["text_crc32"]) for r in rows) == [(0, 28, zlib.crc32(text)), (1, 28, zlib.crc32(text)), (1, 28, zlib.crc32(text)), (2, 8, 0)]
    assert all(sorted(r["slot"] for r in rows if r["shard"] == k) == list(range(sum(r["shard"] == k for r in rows))) for k in range(3))


def test_bytes_are_near_equal(spark):
    rng = random.Random(13)
    df = spark.createDataFrame([(k, "x" * rng.randint(10, 400)) for k in range(3000)], "doc_id long, text string")
    sums = [r["s"] for r in sharding.shard_documents(df, 24).groupBy("shard").agg(F.sum("size").alias("s")).collect()]
    assert len(sums) == 24 and max(sums) - min(sums) < 0.02 * max(sums)


def test_words_are_merged_and_packed_in_one_pass(spark):
    pieces = sentencepiece.load_pieces(sentencepiece.MODEL)
    words = spark.createDataFrame([(sentencepiece.SPACE + "merged",), ("x" * 100,), ("\U0001f98a",)], "word string")
    listed = {r["word"]: r["ids"] for r in sentencepiece.encode_words(words, pieces).collect()}
    got = sentencepiece.encode_words(words, pieces, as_bytes=True)
    # each more pass holds one more Python worker for every core
    assert got._jdf.queryExecution().toString().split("== Physical Plan ==")[1].count("MapInArrow") == 1
    assert {r["word"]: np.frombuffer(r["ids"], dtype=sentencepiece.id_type(pieces)).tolist() for r in got.collect()} == listed


def test_texts_that_share_a_key_get_their_own_words(spark, monkeypatch):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    import sentencepiece as library

    sp = library.SentencePieceProcessor(model_file=public_tokenizers.path(sentencepiece.MODEL))
    texts = ["one xqzzv more", "two wvkkj ▁ less", "", None, "one xqzzv more"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(sentencepiece.F, "xxhash64", lambda *x: sentencepiece.F.lit(7 << 32))
    got = {r["doc_id"]: r for r in sentencepiece.encode_documents(df, known_words=0).collect()}
    assert [list(got[k]["ids"]) for k in range(5)] == [sp.encode(t or "") for t in texts] and all(r["round_trip"] for r in got.values())


def test_packs_keep_no_words_that_counts_tell():
    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2], "text": ["a b a", "c c"], "held_out": [True, False]})
    known = {b"a": 0, b"b": 1}
    ((rows, ids),) = lm._packs(iter([batch]), 1, known, 1)
    assert [(k, n, seen.tolist(), dict(others)) for _, k, n, seen, others in rows] == [(0, 3, [0, 1, 0], {}), (1, 2, [], {b"c": 2})]
    assert all("text" not in held.schema.names for held, *_ in rows)
    assert [x.tolist() for x in ids] == [[2, 0, 2, 1], [0, 0, 1]]
    ((rows, again),) = lm._packs(iter([batch]), 1, known, 1, scored=False)
    assert rows == [] and all((x == y).all() for x, y in zip(ids, again))


def test_copies_leave_a_task_in_blocks(spark):
    flat = np.arange(2.5 * lm.BLOCK_BYTES // 4, dtype=np.float32)
    batches = list(lm.blocks_of(flat, 3))
    assert b"".join(x for b in batches for x in b.column(1).to_pylist()) == flat.tobytes() and max(len(x) for b in batches for x in b.column(1).to_pylist()) == lm.BLOCK_BYTES
    rows = [(r["block"], r["data"], r["tokens"]) for b in batches for r in b.to_pylist()]
    assert (lm.average_blocks(spark.createDataFrame(rows, lm.BLOCKS), flat * 0, 2) == flat).all()


def test_large_logits_are_held_and_steps_do_not_depend_on_unused_words():
    shape, rng = gru.Shape(4, 3, 3), np.random.default_rng(3)
    flat = gru.initial(shape, np.ones(9))
    p = gru.unpack(flat, shape)
    p["wb"][0, 0] = 500.0
    assert np.isfinite(gru.score(flat, shape, [np.array([0, 1, 2])])).all()
    unused, own = p["x"][8].copy(), flat.copy()
    gru.train(own, np.full_like(own, 1e-4), shape, [rng.integers(0, 8, 50).astype(np.int32)])
    assert (gru.unpack(own, shape)["x"][8] == unused).all() and np.isfinite(own).all()
